"""Operators against brute force, and the edge cases each docstring defines."""

import itertools
import operator
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import best_fit, cube_mix, dac, image_copies, license_scan, norm_topk, quality, recompression, token_files, toxicity, voronoi_join
from tessera.llm import wordkernel as wk
from tessera.llm.queries import ORACLES, mix_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n, k=400):
    return " ".join(f"w{rng.randrange(k)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Nulls, empties, ties, copies, near copies, runs, odd white space and one long text."""
    rng = random.Random(3)
    base = [sentence(rng, 60) for _ in range(6)]
    out = [None, "", " \n\t ", "one", "one two three", "ONE two Three", "a " * 70, "a b " * 50, "é x y \x0b z", "it's <|endoftext|> O'Neil\r\n"]
    out += base + base[:3]
    for b in base[:4]:
        w = b.split()
        out += [" ".join(w[:1] + ["changed"] + w[2:]), " ".join(w[5:] + ["more", "words"]), "intro " + b + " outro"]
    out += [sentence(rng, 30) + " " + base[5] + " " + sentence(rng, 30) for _ in range(4)]
    out.append(sentence(rng, 30_000, 10**6))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Extra columns clash with names the operators use inside."""
    rows = [(i, t, "en", ("b", "a", None)[i % 3], 1, 2, 3, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, k long, n long, _id long, kept string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# --- word kernel ---------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0bé ß.", max_size=40)), max_size=8))
def test_words_as_the_pattern_has_them(texts):
    data, bounds = wk.text_bytes(pa.array(texts, pa.string()))
    found = wk.split_words(data, bounds)
    raw = data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(found.starts[i:j], found.ends[i:j])] for i, j in zip(found.first[:-1], found.first[1:])]
    assert got == [words(t) for t in texts]
    h = wk.word_hashes(found, lower=True)
    flat = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for ws in got for w in ws]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat))


def test_word_hash_across_pieces(monkeypatch):
    column = pa.array(["abc " * 50 + "x" * 300 + " tail", "abc tail"])
    one = wk.word_hashes(wk.split_words(*wk.text_bytes(column)))
    monkeypatch.setattr(wk, "PIECE", 7)
    assert (one == wk.word_hashes(wk.split_words(*wk.text_bytes(column)))).all()


# --- 1: Jaccard join -----------------------------------------------------------------------------
def jaccard(rows):
    sets = []
    for doc_id, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((doc_id, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    links = Counter()
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i][1] & sets[j][1])
        if both and 100 * both >= 80 * len(sets[i][1] | sets[j][1]):
            links[i] += 1
            links[j] += 1
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d, links[i]) for i, (d, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize(("leaf", "tile"), [(3000, 3000), (16, 3000), (3, 8), (2, 3)])
def test_jaccard_join(docs, texts, leaf, tile):
    got = [tuple(r) for r in voronoi_join.join(docs, leaf=leaf, tile=tile).collect()]
    assert sorted(got, key=str) == jaccard(list(enumerate(texts)))


def test_jaccard_join_hot_and_repeated(spark, monkeypatch):
    """A group of near copies larger than a leaf, hot shingles, repeated rows and a null id."""
    monkeypatch.setattr(voronoi_join, "HOT", 4)
    rng = random.Random(5)
    base = sentence(rng, 40).split()
    rows = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(40)] = f"new{i % 25}"
        rows.append((i, " ".join(w)))
    rows += [(3, rows[3][1]), (None, rows[0][1]), (None, "quite alone here with six words"), (None, " ".join(base + ["tail"])), (None, " ".join(base + ["tail"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for leaf, tile in ((6, 6), (6, 3000), (3000, 3000), (16, 20)):
        got = sorted((tuple(r) for r in voronoi_join.join(df, leaf=leaf, tile=tile).collect()), key=str)
        assert got == jaccard(rows)


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_join_chains(spark, seed):
    """Chains of edits in which neighbours link and ends don't, so that pivots split regions and cores don't hold all."""
    rng = random.Random(seed)
    rows = []
    for _ in range(3):
        w = sentence(rng, 60, 5000).split()
        for _ in range(40):
            rows.append((len(rows), " ".join(w)))
            for _ in range(rng.randrange(1, 3)):
                w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for leaf in (4, 16):
        got = sorted((tuple(r) for r in voronoi_join.join(df, leaf=leaf, tile=24).collect()), key=str)
        assert got == jaccard(rows)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_core_pairs_link(seed):
    """What the triangle inequality takes for linked is linked."""
    rng = np.random.default_rng(seed)
    base = rng.choice(10**6, 50, replace=False)
    sets = [np.unique(np.concatenate([rng.choice(base, 50 - int(rng.integers(0, 8)), replace=False), rng.integers(10**6, 10**7, int(rng.integers(0, 6)))])) for _ in range(30)]
    n = np.array([len(s) for s in sets])
    both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    want = 100 * both >= 80 * (n[:, None] + n[None, :] - both)
    assert (voronoi_join._linked(sets, 80, 4) == want).all() and (voronoi_join._linked(sets, 80, 99) == want).all()


# --- 2: substring dedup --------------------------------------------------------------------------
def dedup(rows, k):
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = words(t)
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            first[key] = min(first.get(key, (d or 0, p)), (d or 0, p)) if d is not None else first.get(key, (-1, p))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < (d if d is not None else -1, p):
                gone.update(range(p, p + k))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def test_substring_dedup(docs, texts):
    found = recompression.dedup(docs)
    assert {"lang", "source", "k", "n", "_id"} <= set(found.columns)
    got = [tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(got, key=str) == dedup(list(enumerate(texts)), 20)


@pytest.mark.parametrize("seed", range(4))
def test_substring_dedup_small_alphabets(spark, seed, monkeypatch):
    """Periodic texts and long runs, with every symbol hot or none."""
    monkeypatch.setattr(recompression, "HOT_LEAST", 1 if seed % 2 else 10**9)
    monkeypatch.setattr(recompression, "SAMPLE", 1)
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        kind = rng.randrange(4)
        if kind == 0:
            t = "x " * rng.randrange(0, 30)
        elif kind == 1:
            t = ("p q " if rng.random() < 0.5 else "p q r ") * rng.randrange(0, 12)
        elif kind == 2 and rows:
            w = (rng.choice(rows)[1] or "").split()
            a = rng.randrange(len(w) + 1)
            t = sentence(rng, 4, 3) + " " + " ".join(w[a : a + 12]) + " " + sentence(rng, 4, 3)
        else:
            t = sentence(rng, rng.randrange(0, 25), 3)
        rows.append((i, t))
    rows += [(7, rows[7][1]), (None, rows[8][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in recompression.dedup(df, k=6).select("doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(got, key=str) == dedup(rows, 6)


def test_substring_dedup_short_periods(spark):
    """Passages that repeat briefly between words that occur nowhere else."""
    rows, new = [], itertools.count()
    unique = lambda n: " ".join(f"u{next(new)}" for _ in range(n))
    for period in (1, 2, 3, 5, 7, 10, 13, 19):
        for length in range(21, 45, 4):
            passage = (unique(period).split() * 45)[:length]
            rows.append((len(rows), " ".join([unique(40), *passage, unique(40)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in recompression.dedup(df).select("doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(got, key=str) == dedup(rows, 20)


@pytest.mark.parametrize("hot", [1, 10**9])
def test_substring_dedup_rows_of_one_id(spark, hot, monkeypatch):
    """Different texts without an id, or with the same one, lose their own repeats only."""
    monkeypatch.setattr(recompression, "HOT_LEAST", hot)
    monkeypatch.setattr(recompression, "SAMPLE", 1)
    rng = random.Random(9)
    part = [sentence(rng, 25) for _ in range(3)]
    rows = [(None, " ".join([sentence(rng, 30), part[0], sentence(rng, 9), part[0]])), (None, sentence(rng, 22)), (None, None)]
    rows += [(5, " ".join([part[0], part[1], "end"])), (5, sentence(rng, 24)), (5, " ".join([part[2], "tail"])), (5, part[2]), (6, "more " + part[2])]
    rows += [(3, part[2]), (7, part[1]), (8, sentence(rng, 21))]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = [tuple(r) for r in recompression.dedup(df).select("doc_id", "n_words", "n_removed", "kept").collect()]
        assert sorted(got, key=str) == dedup(rows, 20)


def test_untouched_texts_keep_their_form(spark):
    df = spark.createDataFrame([(1, "a\n\nb  c")], "doc_id long, text string")
    assert recompression.dedup(df, tidy=False).first()["kept"] == "a\n\nb  c"
    assert recompression.dedup(df).first()["kept"] == "a b c"


# --- 3: mixing -----------------------------------------------------------------------------------
def test_targets_share_the_excess():
    got = cube_mix.targets([("a", 100), ("b", 1000), (None, 100)], (3, 1, 2), 1.5, 2.0)
    assert got["a"] == 200 and got[None] == 200 and got["b"] == pytest.approx(1400)
    assert cube_mix.targets([("a", 0)], (3, 1, 2), 1.5, 2.0) == {"a": 0.0}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=60), st.floats(0.05, 0.95), st.integers(0, 99))
def test_flight_keeps_tokens_and_documents(size, p, seed):
    before = [p] * len(size)
    after = cube_mix.fly([float(s) for s in size], before, random.Random(seed))
    assert sum(after) == pytest.approx(sum(before), abs=1e-6)
    assert sum(s * q for s, q in zip(size, after)) == pytest.approx(p * sum(size), abs=1e-4)
    assert sum(0 < q < 1 for q in after) <= 2
    assert all(q in (0.0, 1.0) for q in cube_mix.land([float(s) for s in size], after))


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, rng.randrange(1, 200)), rng.choice(["x", "y", "z", None])) for i in range(900)] + [(900, None, "x"), (5, "a b", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = cube_mix.mix(df, block=50).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all()
    for _, part in got.groupby("target"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 0.002 * part["target"].iloc[0] + 5
    again = cube_mix.mix(df.repartition(2), block=50).toPandas()
    order = ["doc_id", "size"]
    assert (got.sort_values(order)["taken"].to_numpy() == again.sort_values(order)["taken"].to_numpy()).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 2), st.integers(0, 2)), min_size=1, max_size=5), st.integers(-400, 400), st.sampled_from((1, 10)))
def test_evening_out_comes_nearest(groups, gap, part):
    size, more, less = [part * s for s, _, _ in groups], [m for _, m, _ in groups], [n for _, _, n in groups]
    got = cube_mix.even_out(gap, size, more, less)
    assert all(-n <= u <= m for u, m, n in zip(got, more, less))
    every = itertools.product(*(range(-n, m + 1) for m, n in zip(more, less)))
    assert abs(gap - sum(map(operator.mul, size, got))) == min(abs(gap - sum(map(operator.mul, size, u))) for u in every)


def test_mix_targets_with_documents_that_a_dozen_cannot_make_up_for(spark, tmp_path):
    """A long document among short ones, in one block and in several; a source that only other copies bring near."""
    rng = random.Random(4)
    texts = {
        "a long": [2000] + [rng.randrange(20, 60) for _ in range(400)],
        "b few": [4000, 1, 2, 4, *range(150, 250, 9)],
        "c blocks": [2000] + [rng.randrange(1, 4) for _ in range(5000)],
        None: [0, 700] + [rng.randrange(30, 80) for _ in range(320)],
    }
    rows = [(s, n) for s, sizes in texts.items() for n in sizes]
    # documents of the same id and size are drawn one by one
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(rows)] + [(7, "w " * 31, "a long")] * 3 + [(None, None, "a long")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r for r in con.execute(ORACLES["mix_targets"]).fetchall()}
    assert {r["source"]: tuple(r) for r in mix_targets(spark, str(tmp_path)).collect()} == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first, again = (Counter(tuple(r) for r in cube_mix.mix(d).collect()) for d in (docs, docs.repartition(5)))
    assert first == again and first.total() == len(rows)
    for source in texts:
        taken = sum(r[6] * n for r, n in first.items() if r[1] == source)
        assert abs(taken - next(r[4] for r in first if r[1] == source)) <= 1


# --- 4: top-k ------------------------------------------------------------------------------------
def test_exact_topk(spark, monkeypatch):
    monkeypatch.setattr(norm_topk, "SLAB", 64)
    monkeypatch.setattr(norm_topk, "QUERIES", 8)
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=12) * rng.choice([0.1, 1, 3])).tolist()) for i in range(400)]
    rows += [(400 + i, [1.0] * 12) for i in range(60)]
    rows += [(40, rows[40][1]), (40, [2.0] * 12), (41, [5.0] * 12), (41, [5.0] * 12)]
    rows += [(500, None), (501, [float("nan")] * 12), (502, [None] * 12), (503, [float("inf")] * 12), (504, [1.0] * 5), (505, []), (None, [9.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    used = [(i, np.pad(np.floor(64 * np.array(v)), (0, 12 - len(v)))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (q, u) in enumerate(used):
        if q % 20 == 0:
            order = sorted(((-int(u @ v), i) for b, (i, v) in enumerate(used) if a != b))[:20]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(order)]
    for held in (1, 3):
        monkeypatch.setattr(norm_topk, "HELD", held)
        assert sorted(tuple(r) for r in norm_topk.top_k(df).collect()) == sorted(want)
    assert norm_topk.top_k(df.limit(0)).collect() == []


# --- 5 and 7: classifiers ------------------------------------------------------------------------
def auc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()).item()


@pytest.mark.parametrize("op", ["quality", "toxic"])
def test_held_out_accuracy(spark, op):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    if op == "quality":
        found = quality.classify(docs, labels, quality.remainder(F.col("doc_id"), 5) != 0)
    else:
        found = toxicity.classify(docs, labels, quality.remainder(F.col("doc_id"), 3) != 1)
    t = found.join(labels, "doc_id").toPandas()
    held = t["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0 if op == "quality" else zlib.crc32(str(i).encode()) % 3 == 1)
    t = t[held]
    assert auc(t["score"].to_numpy(), t[op].to_numpy()) > (0.97 if op == "quality" else 0.9)
    assert t["score"].between(0, 1).all() and found.count() == docs.count()


def test_toxic_recall(spark):
    """Of held-out toxic rows nine in ten reach the threshold, of others hardly any."""
    from pyspark.sql import functions as F

    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    part = quality.remainder(F.col("doc_id"), 3)
    t = toxicity.classify(docs, labels, part != 1).filter(part == 1).join(labels, "doc_id").toPandas()
    assert t[t["toxic"] == 1]["predicted"].mean() >= 0.9 and t[t["toxic"] == 0]["predicted"].mean() <= 0.01


def test_toxic_dictionaries_hold_whole_texts():
    """Every word of a sampled text is in the dictionary of its part and side, and remembered votes are those measured."""
    texts = pa.array(["Alpha beta, gamma beta " * 50 + "last", "delta epsilon zeta alpha"])
    codes, first = toxicity.coded(texts)
    sample = [(0, 1, codes[first[0] : first[1]].tobytes()), (0, 0, codes[first[1] : first[2]].tobytes())]
    pair = toxicity.train(sample)[0]
    assert [len(x) // 8 // toxicity.WIDTH for x in pair] == [4, 4] and toxicity.train(sample[:1]) is None
    votes = toxicity.Votes(toxicity.train(sample))
    asked = np.unique(codes)
    again = votes(asked[1:3]), votes(asked)
    assert (again[0] == again[1][1:3]).all()
    word = lambda w: again[1][np.flatnonzero(asked == toxicity.coded(pa.array([w]))[0][0])[0], 0]
    assert [word(w) for w in ("last", "GAMMA", "zeta", "alpha")] == [1, 1, -1, 0]


def test_toxic_repeated_rows(spark):
    """Rows that repeat a doc_id are scored each, a row labelled twice is learnt from."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(i, sentence(rng, 40) + (" vile nasty" if i % 3 == 0 else "")) for i in range(90)] + [(3, "calm words"), (None, "vile nasty"), (None, "calm words")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(3, 1)], "doc_id long, toxic int")
    got = toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string"), labels, F.lit(True)).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] == 3 for r in got) == 2
    of = sorted(r["score"] for r in got if r["doc_id"] is None)
    assert of[1] > 0.5 > of[0]


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_classifier_edges(spark, docs, texts, classify):
    from pyspark.sql import functions as F

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = classify(docs, none, F.lit(True)).toPandas()
    assert len(got) == len(texts) and got["score"].nunique() == 1
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)] + [(3, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = classify(docs, some, F.lit(True)).toPandas()
    assert len(got) == len(texts) and got["score"].between(0, 1).all() and got["score"].notna().all()
    assert classify(docs.limit(0), some, F.lit(True)).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert (np.diff(y) > 0).all() and y[0] == 0 and y[-1] == 1


# --- 6: images -----------------------------------------------------------------------------------
def picture(seed, side=96):
    rng = np.random.default_rng(seed)
    a = np.zeros((side, side))
    for _ in range(60):
        y, x = rng.integers(0, side - 8, 2)
        a[y : y + rng.integers(5, 24), x : x + rng.integers(5, 24)] = rng.integers(0, 255)
    return a


def test_image_copies(spark):
    p, pgm = picture(3), image_copies.to_pgm
    noise = np.random.default_rng(1).normal(0, 4, p.shape)
    rows = [(i, pgm(picture(i))) for i in range(12)]
    rows += [(100, pgm(p)), (101, pgm(p[8:88, 12:92])), (102, pgm(p * 0.8 + 20)), (103, pgm(np.rot90(p))), (104, pgm(np.clip(p + noise, 0, 255))), (105, None), (106, b"nothing"), (107, pgm(np.zeros((64, 64)))), (108, pgm(p[:9, :9]))]
    got = {r["id"]: r for r in image_copies.copies(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert len(got) == len(rows)
    assert {i for i, r in got.items() if r["component_id"] == 3} == {3, 100, 101, 102, 103, 104}
    assert all(got[i]["component_id"] == i and got[i]["n_links"] == 0 for i in (0, 1, 2, 105, 106, 107, 108))
    assert image_copies.copies(spark.createDataFrame([], "id long, image binary")).count() == 0


def test_image_copies_recall(spark):
    """Of planted copies nine in ten are found, for each edit, and pictures of different vectors stay apart."""
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=64) * 0.125).tolist()) for i in range(600)]
    images = image_copies.painted(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r["id"]: r["component_id"] for r in image_copies.copies(images).collect()}
    for digit in image_copies.EDITS:
        assert np.mean([got[i] == i - digit for i in range(600) if i % 10 == digit]) >= 0.9, image_copies.EDITS[digit]
    assert np.mean([got[i] == i for i in range(600) if i % 10 not in image_copies.EDITS]) >= 0.98


def test_image_formats():
    gray = picture(3).astype(np.uint8)
    assert (image_copies.decoded(image_copies.to_png(gray)) == gray).all() and (image_copies.decoded(image_copies.to_pgm(gray)) == gray).all()
    color = np.stack([gray, gray, gray], 2)
    assert (image_copies.decoded(image_copies.to_png(color)) == gray).all()
    # every filter, undone
    pixels = gray[:5, :8].astype(int)
    raw = np.zeros((5, 9), np.uint8)
    for y in range(5):
        for x in range(8):
            left, up, corner = (pixels[y, x - 1] if x else 0), (pixels[y - 1, x] if y else 0), (pixels[y - 1, x - 1] if x and y else 0)
            base = left + up - corner
            paeth = min((abs(base - left), 0, left), (abs(base - up), 1, up), (abs(base - corner), 2, corner))[2]
            raw[y, x + 1] = (pixels[y, x] - (0, left, up, (left + up) // 2, paeth)[y]) & 255
        raw[y, 0] = y
    assert (image_copies._unfiltered(raw, 1) == pixels).all()
    blob = image_copies.to_png(gray)
    for broken in (blob[:30], blob[:8], blob[:60] + b"x" + blob[61:], image_copies.PNG + b"\0" * 40, b"", None):
        assert image_copies.decoded(broken) is None


def test_image_copies_clashing_columns_and_ids(spark):
    """Extra columns are ignored; an id with two pictures is two rows, each with its own copies."""
    p, q = picture(3), picture(4)
    pgm, png = image_copies.to_pgm, image_copies.to_png
    rows = [(1, pgm(p)), (2, png(p.astype(np.uint8))), (2, pgm(q)), (3, pgm(q[4:90, 2:92])), (None, pgm(q)), (4, png(p.astype(np.uint8)[:, :70])), (5, None)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "id long, image binary, digest long, key long, points string")
    got = Counter((r["id"], r["component_id"]) for r in image_copies.copies(df).collect())
    assert got == {(1, 1): 1, (2, 1): 1, (2, 2): 1, (3, 2): 1, (None, 2): 1, (4, 1): 1, (5, 5): 1}


def test_image_copies_all_pairs(spark):
    """Every two crops of one picture link, though they share their keys with all the others."""
    p = picture(3)
    rows = [(i, image_copies.to_pgm(p[2 * i : 2 * i + 80, i : i + 80])) for i in range(8)] + [(i, image_copies.to_pgm(picture(i))) for i in range(8, 12)]
    got = {r["id"]: (r["component_id"], r["n_links"]) for r in image_copies.copies(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert got == {i: (0, 7) if i < 8 else (i, 0) for i in range(12)}


def test_image_copies_small_crop(spark):
    """A crop of a large image without any of its strongest corners."""
    large = 100 + picture(21, 420) * 0.3
    large[:150, :420] = picture(22, 420)[:150]
    pgm = image_copies.to_pgm
    rows = [(1, pgm(large)), (2, pgm(large[283:373, 217:307])), (3, pgm(picture(23)))]
    got = {r["id"]: r["component_id"] for r in image_copies.copies(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


# --- 8: packing ----------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
def test_packing_solution(lengths, capacity):
    s = best_fit.Solution(dict(Counter(lengths)), capacity)
    t = s.table()
    seats = defaultdict(list)
    for length, many in Counter(lengths).items():
        own = np.flatnonzero(t["length"] == length)
        for rank in range(many):
            i = own[t["rank"][own] <= rank][-1]
            w = rank - t["rank"][i]
            seats[int(t["sequence"][i] + w // t["each"][i])].append((int(t["offset"][i] + w % t["each"][i] * length), length))
    assert sorted(seats) == list(range(s.sequences))
    for held in seats.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert s.sequences <= -(-11 * max(1, -(-sum(lengths) // capacity)) // 9) + 6


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = best_fit.pack(docs, vocabulary("word_bpe_49k.json"), 0, 2048).toPandas()
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = got[got["doc_id"] == i].sort_values("piece")
        assert mine["piece"].tolist() == list(range(-(-len(ids) // 2048)))
        assert mine["ids_crc32"].tolist() == [zlib.crc32(ids[a : a + 2048].tobytes()) for a in range(0, len(ids), 2048)]
        assert mine["length"].sum() == len(ids) and mine["start"].tolist() == list(range(0, len(ids), 2048))
    for _, held in got.sort_values("offset").groupby("sequence_id"):
        assert held["offset"].tolist() == [0, *held["length"].cumsum().tolist()[:-1]] and held["length"].sum() <= 2048


def test_packing_equal_lengths_stay_few_segments():
    """Any number of equal pieces is one entry of the table the tasks get."""
    for many in (10, 100_001):
        t = best_fit.Solution({700: many, 1300: 3}, 2048).table()
        assert len(t["length"]) < 12
    assert best_fit.Solution({700: 100_000}, 2048).sequences == 50_000


def test_packing_and_token_files_of_repeated_and_null_ids(spark, monkeypatch):
    """Rows that share an id, or have none, are pieces and documents each, also at the borders of ranges."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "PER_FILE", 300)
    rng = random.Random(6)
    rows = [(i // 9, sentence(rng, rng.randrange(1, 60))) for i in range(180)] + [(None, sentence(rng, 20)), (None, None), (None, ""), (7, rng.choice("ab") * 3)]
    rows += [rows[0]] * 3
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, part int, piece string, length int").repartition(6)
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    got = token_files.token_table(df, vocabulary("byte_bpe_50k.json"), 2).collect()
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((d, crc(t)) for d, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    packed = best_fit.pack(df, vocabulary("byte_bpe_50k.json"), 2, 64, keeps_space=True).toPandas()
    assert packed.groupby("doc_id", dropna=False)["piece"].count().sum() == len(packed) and (packed["piece"] == 0).sum() == len(rows)
    for _, held in packed.sort_values("offset").groupby("sequence_id"):
        assert held["offset"].tolist() == [0, *held["length"].cumsum().tolist()[:-1]] and held["length"].sum() <= 64


def test_token_files_stay_at_a_path(spark, tmp_path):
    df = spark.createDataFrame([(2, "one two"), (1, "three")], "doc_id long, text string")
    at = str(tmp_path / "tokens")
    kept = token_files.write_tokens(df, vocabulary("byte_bpe_50k.json"), 2, path=at)
    again = spark.read.parquet(at)
    assert again.count() == kept.count() > 0
    (name,) = [f for f in (tmp_path / "tokens").iterdir() if f.suffix == ".parquet"][:1]
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(name).metadata
    assert {meta.row_group(0).column(i).compression for i in range(meta.num_columns)} == {"UNCOMPRESSED"}
    blob = again.first()["blob"]
    assert dac.Reader(bytes(blob))[0] == dac.Reader(bytes(blob)).ids()[0]


def test_quality_repeated_rows(spark):
    """Rows that repeat an id are scored by their own texts; a row labelled twice counts twice."""
    from pyspark.sql import functions as F

    rng = random.Random(2)
    good, bad = (lambda: sentence(rng, 60).capitalize() + "."), (lambda: " ".join(rng.choice(["###", "|||", "$$$"]) for _ in range(60)))
    rows = [(i, good() if i % 2 else bad()) for i in range(120)] + [(1, bad()), (1, good()), (None, good()), (None, bad())]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120) if i != 1] + [(3, 1)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = quality.classify(df, labels, F.lit(True)).collect()
    assert len(got) == len(rows)
    assert sorted(r["predicted"] for r in got if r["doc_id"] == 1) == [0, 1, 1] and sorted(r["predicted"] for r in got if r["doc_id"] is None) == [0, 1]
    kept = quality.accepted(df, labels, F.lit(True))
    want = Counter((d, t) for d, t in rows if not t.startswith(("#", "|", "$")))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want


# --- 9: licences ---------------------------------------------------------------------------------
def test_license_scan(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    rows = [
        ("h/a/LICENSE", f"<p>{apache}</p>"), ("h/a/b/one.py", "nothing here"), ("h/a/b/two.py", f"x\n{mit}\ny"), ("h/c/three.py", None), ("h/c/four.py", ""),
        ("top.txt", "plain words"), (None, mit), ("h/a/b/one.py", "nothing here"), ("h/a/bc/five.py", "is licensed"), ("h/a/d/e/six.py", "the of and"),
    ]
    df = spark.createDataFrame(rows, "path string, text string")
    from pyspark.sql import functions as F

    got = license_scan.scan(df).toPandas()
    assert len(got) == len(rows)
    of = {r["path"]: (r["licence"], r["origin"], r["directory"]) for _, r in got.iterrows() if r["path"]}
    assert of["h/a/LICENSE"] == ("Apache-2.0", "own", "h/a") and of["h/a/b/two.py"] == ("MIT", "own", "h/a/b")
    assert of["h/a/b/one.py"] == ("Apache-2.0", "inherited", "h/a") and of["h/a/d/e/six.py"][1] == "inherited"
    assert of["h/c/three.py"][1] == of["h/c/four.py"][1] == of["top.txt"][1] == "none"
    near = license_scan.scan(df, licence_file=F.lit(True)).toPandas()
    assert near[near["path"] == "h/a/b/one.py"]["licence"].tolist() == ["MIT", "MIT"]
    assert license_scan.scan(df.limit(0)).count() == 0


def test_license_files_and_wrapped_notices(spark):
    """A header licenses its own file alone; a notice may be wrapped, and versions are told apart."""
    notice = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#"""
    older = notice.replace("version 3", "version 2").replace("software:", "software;")
    rows = [("r/a/one.py", notice + "\nimport os"), ("r/a/two.py", "import sys"), ("r/b/COPYING", older), ("r/b/c/three.py", "x = 1"), ("r/b/c/LICENSE-MIT.txt", "Released under the MIT License."), ("r/b/c/d/four.py", "y"), ("r/licences.py", "Released under the MIT License.")]
    got = {r["path"]: (r["licence"], r["origin"]) for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["r/a/one.py"] == ("GPL-3.0-or-later", "own") and got["r/a/two.py"] == (None, "none") and got["r/licences.py"] == ("MIT", "own")
    assert got["r/b/COPYING"] == ("GPL-2.0-or-later", "own") and got["r/b/c/three.py"] == ("MIT", "inherited") and got["r/b/c/d/four.py"] == ("MIT", "inherited")


def test_license_crowded_keys(spark, monkeypatch):
    """Crowded directories, repeated and null paths come out as without the broadcast."""
    monkeypatch.setattr(license_scan, "HOT", 8)
    rows = [(f"h/{i % 3}/f{i // 2}", "Released under the MIT License." if i == 4 else "plain words") for i in range(90)] + [(None, "x")] * 20 + [("lone/a", "x"), ("h/LICENSE", "Licensed under CC BY 4.0.")]
    df = spark.createDataFrame(rows, "path string, text string")
    got = Counter(tuple(r) for r in license_scan.scan(df).collect())
    monkeypatch.setattr(license_scan, "HOT", 10**9)
    assert got == Counter(tuple(r) for r in license_scan.scan(df).collect()) and sum(got.values()) == len(rows)
    monkeypatch.setattr(license_scan, "HOT", 0.5)
    assert got == Counter(tuple(r) for r in license_scan.scan(df).collect())


def test_license_scores(spark):
    """Scores as plain Python has them."""
    import math

    sf = spark.read.parquet(SF.replace("0.001", "0.01") + "/pages.parquet").toPandas()
    from pyspark.sql import functions as F

    df = spark.read.parquet(SF.replace("0.001", "0.01") + "/pages.parquet").select(license_scan.url_path(F.col("url")).alias("path"), F.col("html").alias("text"))
    paths = [r["path"] for r in df.select("path").collect()]
    named = [license_scan._terms(t) for _, t in license_scan.TEMPLATES]
    vocabulary = {w for ws in named for w in ws}
    files = [(p, [license_scan._terms(s) for s in re.split(license_scan._CUT, h)]) for p, h in zip(paths, sf["html"])]
    telling = vocabulary - license_scan.PLAIN
    segments = [(p, ws) for p, lines in files for ws in lines]
    for p, lines in files:
        for i, n in itertools.product(range(len(lines)), range(2, license_scan.LINES + 1)):
            if i + n <= len(lines) and all(telling & set(ws) for ws in lines[i : i + n]):
                segments.append((p, [w for ws in lines[i : i + n] for w in ws]))
    seen = defaultdict(set)
    for p, ws in segments:
        for w in vocabulary & set(ws):
            seen[w].add(p)
    idf, rarest = license_scan._weights(len(set(paths)), {w: len(seen[w]) for w in vocabulary})
    best = {}
    for p, ws in segments:
        if not vocabulary & set(ws):
            continue
        v = {w: n * idf.get(w, rarest) for w, n in Counter(ws).items()}
        for (name, _), ts in zip(license_scan.TEMPLATES, named):
            u = {w: n * idf[w] for w, n in Counter(ts).items()}
            c = sum(v.get(w, 0) * x for w, x in u.items()) / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in u.values()))
            if round(c, 6) >= 0.7:
                best[p] = min(best.get(p, (0, "")), (-round(c, 6), name))
    got = {r["path"]: (-r["score"], r["licence"]) for r in license_scan.statements(df, 0.7).collect()}
    assert got == best and got


@pytest.mark.parametrize("size", [60, 1500])
def test_license_words_outside_templates(spark, size):
    """Words that no template has weigh what their frequency among all files gives them."""
    import math

    said = ["was released under the mit license", "page was licensed under cc by 4.0 was", "zebra released under the mit license", "was the mit page"]
    rows = [(f"s/{i}", f"<p>{t}</p>") for i, t in enumerate(said)]
    rows += [(f"f/{i}", ("was was here" if i % 12 < 7 else "is here") + ("\npage" if i % 2 else "")) for i in range(size)]
    rows += [rows[0], rows[5]]
    files = [license_scan._terms(" ".join(re.split(license_scan._CUT, t))) for _, t in dict(rows).items()]
    often = Counter(w for ws in files for w in set(ws))
    idf = lambda w: math.log((1 + len(files)) / (1 + often[w])) + 1
    vector = lambda ws: {w: n * idf(w) for w, n in Counter(ws).items()}
    want = {}
    for i, t in enumerate(said):
        v = vector(license_scan._terms(t))
        for name, text in license_scan.TEMPLATES:
            u = vector(license_scan._terms(text))
            c = sum(x * u.get(w, 0) for w, x in v.items()) / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in u.values()))
            if round(c, 6) >= 0.7:
                want[f"s/{i}"] = min(want.get(f"s/{i}", (0, "")), (-round(c, 6), name))
    got = {r["path"]: (r["score"], r["licence"]) for r in license_scan.statements(spark.createDataFrame(rows, "path string, text string"), 0.7).collect()}
    assert {p: name for p, (_, name) in got.items()} == {p: name for p, (_, name) in want.items()} and {"s/0", "s/1"} <= set(got)
    assert all(score == pytest.approx(-want[p][0], abs=2e-6) for p, (score, _) in got.items())


# --- 10: token files -----------------------------------------------------------------------------
@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=30), max_size=6))
def test_dac_round_trip(lists):
    flat = np.array([i for ids in lists for i in ids], np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(ids) for ids in lists])]).astype(int)
    reader = dac.Reader(dac.pack(flat, bounds))
    assert reader.ids().tolist() == flat.tolist() and [reader[i] for i in range(len(reader))] == flat.tolist()
    assert [reader.document(d).tolist() for d in range(len(lists))] == lists


def test_dac_long():
    ids = np.random.default_rng(0).integers(0, 60_000, 20_000).astype(np.uint32)
    reader = dac.Reader(dac.pack(ids, [0, len(ids)]))
    assert (reader.ids() == ids).all() and all(reader[i] == ids[i] for i in range(0, len(ids), 977))
    with pytest.raises(IndexError):
        reader[len(ids)]
    with pytest.raises(ValueError):
        dac.Reader(b"else")


def test_token_files(docs, texts, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "PER_FILE", 500)
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in token_files.token_table(docs, vocabulary("byte_bpe_50k.json"), 2).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_shared_folder_is_never_one_machine_s_own():
    """On a cluster without a shared folder nothing is written to a temporary one."""
    from types import SimpleNamespace

    from tessera.llm import frames

    kept: dict[str, str] = {}
    conf = SimpleNamespace(get=lambda k, d=None: kept.get(k, d), set=kept.__setitem__)
    session = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None)))
    with pytest.raises(RuntimeError):
        frames.shared_folder(session("spark://host:7077"))
    assert frames.shared_folder(session("local[2]")).startswith("file:///")
    kept["spark.checkpoint.dir"] = "s3://bucket/x/"
    assert frames.shared_folder(session("spark://host:7077")) == "s3://bucket/x"


# --- empty tables and the pipeline ---------------------------------------------------------------
def test_empty_tables(spark, empty):
    path = vocabulary("byte_bpe_50k.json")
    assert voronoi_join.join(empty).count() == 0
    assert recompression.dedup(empty).count() == 0
    assert cube_mix.mix(empty).count() == 0
    assert token_files.token_table(empty, path, 2).count() == 0
    assert best_fit.pack(empty, path, 0, keeps_space=True).count() == 0


def test_pipeline_stages(spark, docs, texts):
    """Extra columns live through the stages; only repeats, copies and bad texts go."""
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "mixing to target weights", "best-fit packing"]
    table = docs.withColumnRenamed("kept", "key").withColumnRenamed("n", "n_words")
    assert cp.good_quality(spark, table, SF).columns == table.columns
    one = cp.one_of_each_group(spark, table, SF)
    groups = {r[2] for r in jaccard(list(enumerate(texts)))}
    assert one.columns == table.columns and {r["doc_id"] for r in one.collect()} == groups
    left = cp.without_repeats(spark, table, SF)
    want = {d: kept for d, n, gone, kept in dedup(list(enumerate(texts)), 20) if not gone or gone < n}
    assert left.columns == table.columns and {r["doc_id"]: " ".join(words(r["text"])) for r in left.collect()} == want
    assert Counter(r["doc_id"] for r in one.collect()) == Counter(groups)
    mixed = cp.mixed(spark, table, SF)
    taken = {r["doc_id"]: r["copies"] for r in cube_mix.mix(table).collect() if r["copies"]}
    assert mixed.columns == table.columns and Counter(r["doc_id"] for r in mixed.collect()) == taken
    for _, stage in cp.STAGES:
        assert stage(spark, table.limit(0), SF).count() == 0


def test_pipeline_stages_decide_by_row(spark):
    """Rows that share an id, or have none, are kept, judged and drawn one by one."""
    import corpus_pipeline as cp

    rng = random.Random(8)
    same = sentence(rng, 30)
    rows = [(1, sentence(rng, 500), "a"), (5, sentence(rng, 500), "a"), (5, "three short words", "a"), (None, sentence(rng, 40), "b"), (None, sentence(rng, 41), "b"), (None, None, "b"), (None, "", None)]
    rows += [(7, same, "b"), (7, same, "b"), (7, same + " end", "b"), (3, same, "c"), (7, "wholly other words here now", "c"), (9, None, "a"), (9, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    one = Counter((r["doc_id"], r["text"]) for r in cp.one_of_each_group(spark, df, SF).collect())
    want = Counter((d, t) for d, t, _ in rows)
    for gone in ((7, same), (7, same), (7, same + " end")):
        want[gone] -= 1
    assert one == +want
    left = cp.without_repeats(spark, df, SF)
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(d for d, _, n, g in ((d, k, n, g) for d, n, g, k in dedup([r[:2] for r in rows], 20)) if not g or g < n)
    drawn = cube_mix.mix(df).collect()
    mixed = cp.mixed(spark, df, SF).collect()
    count = lambda r: len(words(r["text"]))
    want = Counter()
    for r in drawn:
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    assert Counter((r["doc_id"], r["source"], count(r)) for r in mixed) == +want
    assert max(Counter((r["doc_id"], r["text"], r["source"]) for r in mixed).values()) <= 4
    # a row the classifier rejects goes, though its namesake passes
    junk = " ".join(["###", "|||", "$$$"] * 60)
    good = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1"), "doc_id").first()["text"]
    both = spark.createDataFrame([(1, good), (1, junk), (None, good), (None, junk)], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    kept = cp.good_quality(spark, docs.unionByName(both.withColumn("doc_id", F_col("doc_id") - 2)), SF)
    assert Counter((r["doc_id"], r["text"]) for r in kept.filter("doc_id < 0 or doc_id is null").collect()) == {(-1, good): 1, (None, good): 1}


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_pipeline_runs(spark):
    import corpus_pipeline as cp

    got = cp.run(spark, SF).toPandas()
    assert len(got) and got.groupby("sequence_id")["length"].sum().max() <= 2048
