"""Every registered query against its SQL, over the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.9g}"
    return "null" if v is None else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    found = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_entry(spark):
    assert {"module", "score", "claims"} == set(entry.entry(spark).columns)
