"""Licence scan: TF-IDF cosine to templates, then inheritance along directories.

Files are cut into lines at tags and line ends.  A segment is a line, or two to ``LINES``
lines that follow one another and all hold telling words of a template: a notice may be
wrapped.  A segment's words, weighted by term frequency and by inverse frequency among
all files, are compared with each template; a file whose best segment reaches
``threshold`` states that licence, for itself.  A file that states none takes that of
the nearest ancestor directory holding a licence file: one that states a licence and
whose name says what it is (``LICENCE_FILE``), unless the caller tells another way.  Everything is DataFrame functions; Python code runs on the driver alone.

A first pass keeps a file's template terms, for their frequencies, and the segments
that hold a template term outside ``PLAIN``.  Afterwards the driver knows the weights
of template terms and can tell whether, by Cauchy-Schwarz, a segment with plain terms
alone could reach the threshold; only if it could are all segments read again.  Any
other term weighs 1 at least, which bounds a segment's score from above; segments that
could reach the threshold stay.  If they hold terms that no template has, another pass
counts the files of those terms (a broadcast side, as large as the words of such
segments), so every term has its weight among all files.

Null or empty texts state nothing; a null path has no directory; ties go to the
better score, then the licence's name, then the path; repeated rows are all
reported; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import settle

#: Statements that headers and licence files carry.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
)
#: Lines of one notice that are read together.
LINES = 4
#: Names of files that speak for their directory.
LICENCE_FILE = r"(?i)(^|/)((un)?licen[cs]es?|copying|copyright|notice)([-_][^/.]*)?(\.(lesser|md|rst|txt|html?))?$"
_CUT = r"<[^>]*>|[\r\n]+"
_GAP = r"[^a-z0-9.]+"
#: Everyday words of the templates, most likely too common to carry a cosine.
PLAIN = frozenset("the of and to in is with or that are by this you any may a an it not for from on can and either at your option any all as above use into who no".split())


def terms(text: Column) -> Column:
    """Words and version numbers of a lower-case text."""
    return F.filter(F.transform(F.split(text, _GAP), lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")


def _terms(text: str) -> list[str]:
    return [w for w in (w.strip(".") for w in re.split(_GAP, text.lower())) if w]


def _weights(files: int, df: dict[str, int]) -> tuple[dict[str, float], float]:
    """Weights of terms by the files that have them, and that of a term that no file has."""
    rarest = math.log(1 + files) + 1
    return {t: math.log((1 + files) / (1 + n)) + 1 for t, n in df.items()}, rarest


def _can_carry(words: frozenset[str], vectors: list[dict[str, float]], threshold: float) -> bool:
    """Whether a segment that shares only these words with a template can reach the threshold."""
    share = (sum(w * w for u, w in v.items() if u in words) / sum(w * w for w in v.values()) for v in vectors)
    return any(math.sqrt(x) >= threshold - 1e-6 for x in share)


def _in_a_row(n: int) -> Column:
    """Words of n told lines that follow one another, for each place in ``lines`` (i, s) where they begin."""
    last = lambda j: F.get(F.col("lines"), j + (n - 1))["i"]
    start = F.filter(F.transform("lines", lambda e, j: F.struct(j.alias("j"), (last(j) - e["i"] == n - 1).alias("run"))), lambda e: e["run"])
    return F.transform(start, lambda e: F.flatten(F.transform(F.slice("lines", e["j"] + 1, n), lambda x: x["s"])))


def statements(files: DataFrame, threshold: float, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """path, licence, score of files whose best segment reaches the threshold."""
    spark = files.sparkSession
    words = [_terms(t) for _, t in templates]
    vocabulary = sorted({w for ws in words for w in ws})
    named = F.array(*[F.lit(w) for w in vocabulary])

    def read(wanted: list[str]) -> DataFrame:
        """path, met (template terms of the file), near (segments with a wanted term)."""
        cut = files.select("path", F.transform(F.split(F.lower("text"), _CUT), terms).alias("segments"))
        # the lines that hold a wanted term, with their numbers
        told = F.filter(F.transform("segments", lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda e: F.arrays_overlap(e["s"], F.array(*[F.lit(w) for w in wanted])))
        lines = cut.select("path", F.array_intersect(F.flatten("segments"), named).alias("met"), told.alias("lines"))
        several = [_in_a_row(n) for n in range(2, LINES + 1)]
        return settle(lines.select("path", "met", F.concat(F.transform("lines", lambda e: e["s"]), *several).alias("near")))

    table = read([w for w in vocabulary if w not in PLAIN])
    # a file counts once for a term however many segments have it
    counts = table.select("path", F.explode("met").alias("term")).distinct().groupBy("term").count()
    total = files.agg(F.countDistinct("path")).first()[0]
    df = dict.fromkeys(vocabulary, 0) | {r["term"]: r["count"] for r in counts.collect()}  # as many rows as template terms
    idf, _ = _weights(total, df)
    vectors = []
    for ws in words:
        v: dict[str, float] = defaultdict(float)
        for w in ws:
            v[w] += idf[w]
        vectors.append(dict(v))
    if _can_carry(PLAIN, vectors, threshold):
        table = read(vocabulary)
    rows = [(i, licence, w, x / math.sqrt(sum(y * y for y in v.values()))) for i, ((licence, _), v) in enumerate(zip(templates, vectors, strict=True)) for w, x in v.items()]
    template = spark.createDataFrame(rows, "template int, licence string, term string, part double")
    weight = F.create_map(*[x for w in vocabulary for x in (F.lit(w), F.lit(idf[w]))])
    parts: dict[int, list[Column]] = defaultdict(list)
    for i, _, w, part in rows:
        parts[i] += [F.lit(w), F.lit(part)]
    near = table.select("path", F.explode("near").alias("words")).withColumn("own", F.array_intersect("words", named))
    near = near.withColumn("others", F.size(F.array_distinct("words")) - F.size("own"))
    near = near.withColumn("own", F.transform("own", lambda t: F.struct(t.alias("term"), (F.size(F.filter("words", lambda w: w == t)) * F.element_at(weight, t)).alias("w"))))
    add = lambda of: F.aggregate("own", F.lit(0.0), lambda sum_, t: sum_ + of(t))
    dots = [add(lambda t, m=F.create_map(*p): t["w"] * F.coalesce(F.try_element_at(m, t["term"]), F.lit(0.0))) for p in parts.values()]
    most = F.array_max(F.array(*dots)) / F.sqrt(add(lambda t: t["w"] * t["w"]) + F.col("others"))
    near = settle(near.filter(most >= threshold - 1e-6).select("path", "words", F.monotonically_increasing_id().alias("segment")))
    each = near.select("path", "segment", F.explode("words").alias("term")).groupBy("path", "segment", "term").agg(F.count("*").alias("tf"))
    other = settle(near.select(F.explode(F.array_except("words", named)).alias("term")).distinct())
    if other.limit(1).count():
        held = files.select("path", F.explode(F.array_distinct(F.flatten(F.transform(F.split(F.lower("text"), _CUT), terms)))).alias("term"))
        often = held.join(F.broadcast(other), "term").distinct().groupBy("term").agg(F.count("*").alias("n"))
        each = each.join(settle(often), "term", "left")
    else:
        each = each.withColumn("n", F.lit(0))
    each = each.withColumn("w", F.col("tf") * F.coalesce(F.try_element_at(weight, F.col("term")), F.log((1 + total) / (1 + F.col("n"))) + 1))
    length = each.groupBy("path", "segment").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dot = each.join(F.broadcast(template), "term").groupBy("path", "segment", "template", "licence").agg(F.sum(F.col("w") * F.col("part")).alias("dot"))
    found = dot.join(length, ["path", "segment"]).select("path", "licence", F.round(F.col("dot") / F.col("length"), 6).alias("score")).filter(F.col("score") >= threshold)
    order = F.struct(-F.col("score"), F.col("licence"))
    return found.groupBy("path").agg(F.min_by("licence", order).alias("licence"), F.max("score").alias("score"))


#: A key of more than one in so many rows is joined by broadcast; there are fewer than this many of them.
HOT = 1000


def _join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """left join right, whose keys are unique; rows of crowded keys don't travel to one task.

    Crowded keys are fewer than HOT, so their rows of ``right`` are a broadcast side of
    a known size; the others are joined by a shuffle.
    """
    often = settle(left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")))
    least = (often.agg(F.sum("_n")).first()[0] or 0) / HOT
    hot = often.filter(F.col("_n") > least).select(key, F.lit(True).alias("_hot"))
    marked = left.join(F.broadcast(hot), key, "left")
    crowded = F.broadcast(right.join(F.broadcast(hot.select(key)), key, "left_semi"))
    none = F.col(key).isNull()
    warm = marked.filter(F.col("_hot") | none).drop("_hot").join(crowded, key, how)
    return marked.filter(F.col("_hot").isNull() & ~none).drop("_hot").join(right, key, how).unionByName(warm)


def directory(path: Column) -> Column:
    """The directory of a path, without its last step; empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, threshold: float = 0.7, licence_file: Column | None = None) -> DataFrame:
    """path, licence, score, origin ('own', 'inherited' or 'none'), directory it comes from.

    ``licence_file`` tells which stating files speak for their directory; those that
    LICENCE_FILE names, if None.
    """
    if licence_file is None:
        licence_file = F.col("path").rlike(LICENCE_FILE)
    rows = files.select("path")
    own = settle(statements(files.select("path", "text").filter("path is not null and text is not null"), threshold))
    speak = own.filter(licence_file)
    order = F.struct(-F.col("score"), F.col("licence"), F.col("path"))
    held = speak.withColumn("dir", directory(F.col("path"))).groupBy("dir").agg(F.min_by(F.struct("licence", "score"), order).alias("held"))
    # inheritance is settled once for each directory
    dirs = rows.filter("path is not null").select(directory(F.col("path")).alias("dir")).distinct()
    steps = F.split("dir", "/")
    up = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("depth", "above"))
    nearest = _join(up, held.withColumnRenamed("dir", "above"), "above", "inner").groupBy("dir").agg(F.max_by(F.struct("held", "above"), "depth").alias("near"))
    table = _join(_join(rows.withColumn("dir", directory(F.col("path"))), own, "path"), settle(nearest), "dir")
    stated = F.col("licence").isNotNull()
    return table.select(
        "path",
        F.coalesce("licence", "near.held.licence").alias("licence"),
        F.coalesce("score", "near.held.score").alias("score"),
        F.when(stated, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(stated, F.col("dir")).otherwise(F.col("near.above")).alias("directory"),
    )


def url_path(url: Column) -> Column:
    """Host and path of a URL, without scheme, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z]+://|/+$", "")
