"""Thin queries that apply each operator to its whole table.

Each takes (spark, sf_dir) and returns a DataFrame; ``ORACLES`` holds DuckDB SQL
where the result can be expressed in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.frames import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.best_fit import pack

    return pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=0, capacity=2048)


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_files import token_table

    return token_table(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=2)


@query
def op3_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.cube_mix import mix

    return mix(documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, most=2.0).select("doc_id", "size", "source_size", "target", "taken")


@query
def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the mix: sizes and targets of sources, that no row is taken above twice, and that each source comes near its target."""
    from tessera.llm.cube_mix import mix

    rows = mix(documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, most=2.0)
    found = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"), F.round(F.max("target"), 4).alias("target"), F.min("target").alias("_t"), F.max("source_size").alias("_s"), F.sum("taken").alias("_taken"), F.bool_and(F.col("taken").isin(0, F.col("size"), 2 * F.col("size"))).alias("_each"))
    sound = F.col("_each") & (F.col("_s") == F.col("source_size")) & (F.abs(F.col("_t") - F.col("target")) < 1e-3) & (F.abs(F.col("_taken") - F.col("_t")) <= 0.002 * F.col("_t") + 5)
    return found.select("source", "n", "source_size", "target", sound.alias("sound"))


ORACLES["mix_targets"] = r"""
WITH d AS (
  SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+')) AS size FROM documents
), s AS (
  SELECT source, count(*) AS n, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1
), w AS (
  SELECT *, 2.0 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS weight, 1.5 * sum(source_size) OVER () AS goal FROM s
), l AS (
  SELECT *, cap / weight AS rate, (goal - coalesce(sum(cap) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW v AS (ORDER BY cap / weight, source NULLS LAST)
), water AS (
  SELECT max(level) AS level FROM l WHERE level <= rate
)
SELECT source, n, source_size, round(CAST(least(cap, water.level * weight) AS DOUBLE), 4) AS target, true AS sound FROM l, water
"""


@query
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.norm_topk import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, every=20, scale=64.0)


ORACLES["op4_exact_topk"] = """
WITH e AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row AS q, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.row <> c.row WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import quality

    part = quality.remainder(F.col("doc_id"), 5)
    found = quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), part != 0, threshold=0.3)
    return found.select("doc_id", (part == 0).alias("held_out"), "score", "predicted")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import toxicity
    from tessera.llm.quality import remainder

    part = remainder(F.col("doc_id"), 3)
    found = toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), part != 1, threshold=0.7)
    return found.select("doc_id", (part == 1).alias("held_out"), "score", "predicted")


@query
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.voronoi_join import join

    return join(documents(spark, sf_dir), width=5, percent=80)


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.recompression import dedup

    found = dedup(documents(spark, sf_dir).select("doc_id", "text"), k=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stand for files: their URLs are the paths, and any that states a licence speaks for its directory."""
    from tessera.llm.license_scan import scan, url_path

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return scan(pages.select(url_path(F.col("url")).alias("path"), F.col("html").alias("text")), threshold=0.7, licence_file=F.lit(True))


@query
def op6_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images, so every vector of embeddings is painted as one; half of them are edited copies of another."""
    from tessera.llm.image_copies import copies, painted

    return copies(painted(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))).withColumnRenamed("id", "vec_id")


ORACLES["op1_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0b\f\r]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.y FROM reach JOIN link ON reach.b = link.x
)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) r USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM link GROUP BY 1) l USING (doc_id)
"""

ORACLES["op2_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\f\r]+') AS w FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM win) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, p + o AS p FROM later, range(20) t(o)
), word AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id)
"""


def _license_sql(threshold: float) -> str:
    from tessera.llm.license_scan import LINES, PLAIN, TEMPLATES, _terms

    values = ", ".join(f"({i}, '{licence}', '{text}')" for i, (licence, text) in enumerate(TEMPLATES))
    words = r"list_filter(list_transform(regexp_split_to_array({}, '[^a-z0-9.]+'), lambda w: trim(w, '.')), lambda w: w <> '')"
    telling = ", ".join(f"'{w}'" for w in sorted({w for _, text in TEMPLATES for w in _terms(text)} - PLAIN))
    ahead = ", ".join(f"lead(ws, {n}) OVER v AS w{n}, coalesce(lead(hit, {n}) OVER v, false) AS h{n}" for n in range(1, LINES))
    several = "".join(
        f" UNION ALL SELECT path, list_concat(ws, {', '.join(f'w{m}' for m in range(1, n))}) FROM ahead WHERE hit AND {' AND '.join(f'h{m}' for m in range(1, n))}" if n == 2
        else f" UNION ALL SELECT path, flatten([ws, {', '.join(f'w{m}' for m in range(1, n))}]) FROM ahead WHERE hit AND {' AND '.join(f'h{m}' for m in range(1, n))}"
        for n in range(2, LINES + 1)
    )
    return rf"""
WITH f AS (
  SELECT row_number() OVER () AS fid, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z]+://|/+$', '', 'g') AS path, lower(html) AS text FROM pages
), total AS (
  SELECT count(DISTINCT path) AS n FROM f
), line AS (
  SELECT fid, path, generate_subscripts(s, 1) AS i, unnest(s) AS s FROM (SELECT fid, path, regexp_split_to_array(text, '<[^>]*>|[
]+') AS s FROM f)
), told AS (
  SELECT fid, path, i, ws, list_has_any(ws, [{telling}]) AS hit FROM (SELECT fid, path, i, {words.format("s")} AS ws FROM line)
), ahead AS (
  SELECT path, ws, hit, {ahead} FROM told WINDOW v AS (PARTITION BY fid ORDER BY i)
), seg AS (
  SELECT path, row_number() OVER () AS sid, ws FROM (SELECT path, ws FROM ahead{several})
), word AS (
  SELECT path, sid, unnest(ws) AS term FROM seg
), tw AS (
  SELECT t, licence, term, count(*) AS tf FROM (SELECT t, licence, unnest({words.format("lower(text)")}) AS term FROM (VALUES {values}) v(t, licence, text)) GROUP BY 1, 2, 3
), held_by AS (
  SELECT term, count(DISTINCT path) AS files FROM word GROUP BY 1
), idf AS (
  SELECT term, ln((1 + any_value(total.n)) / (1 + coalesce(any_value(files), 0))) + 1 AS idf FROM (SELECT term FROM tw UNION SELECT term FROM held_by) LEFT JOIN held_by USING (term), total GROUP BY 1
), tmpl AS (
  SELECT t, licence, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY t)) AS length FROM tw JOIN idf USING (term)
), tf AS (
  SELECT path, sid, term, count(*) AS tf FROM word WHERE sid IN (SELECT sid FROM word WHERE term IN (SELECT term FROM tw)) GROUP BY 1, 2, 3
), wt AS (
  SELECT path, sid, term, tf * idf AS w FROM tf JOIN idf USING (term)
), best AS (
  SELECT path, licence, round(dot / length, 6) AS score FROM (SELECT path, sid, t, licence, sum(wt.w * tmpl.w / tmpl.length) AS dot FROM wt JOIN tmpl USING (term) GROUP BY 1, 2, 3, 4)
  JOIN (SELECT path, sid, sqrt(sum(w * w)) AS length FROM wt GROUP BY 1, 2) USING (path, sid) WHERE round(dot / length, 6) >= {threshold}
), own AS (
  SELECT path, licence, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, licence) AS r FROM best) WHERE r = 1
), held AS (
  SELECT dir, licence, score FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence, path) AS r FROM (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir FROM own)) WHERE r = 1
), files AS (
  SELECT path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM f
), up AS (
  SELECT dir, n, array_to_string(string_split(dir, '/')[1:n], '/') AS above FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS n FROM (SELECT DISTINCT dir FROM files))
), near AS (
  SELECT dir, licence, score, above FROM (SELECT up.dir, held.licence, held.score, above, row_number() OVER (PARTITION BY up.dir ORDER BY n DESC) AS r FROM up JOIN held ON held.dir = up.above) WHERE r = 1
)
SELECT files.path, coalesce(own.licence, near.licence) AS licence, coalesce(own.score, near.score) AS score,
  CASE WHEN own.licence IS NOT NULL THEN 'own' WHEN near.above IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN own.licence IS NOT NULL THEN files.dir ELSE near.above END AS directory
FROM files LEFT JOIN own USING (path) LEFT JOIN near ON near.dir = files.dir
"""


ORACLES["op9_license_scan"] = _license_sql(0.7)
