"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def lines(rows, order):
    def text(v):
        return "null" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert lines(got, [df.columns.index(c) for c in names]) == lines(want.fetchall(), range(len(names)))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(ORACLES) <= set(QUERIES)
