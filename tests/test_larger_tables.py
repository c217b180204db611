"""Queries over odd and larger tables against their SQL, and how far their plans spread the work."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from plumbline.functions import text
from plumbline.operators import checks, code, drift, evidence, match, retrieval
from plumbline.plans import queries, source_queries


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.9g}"
    return "null" if v is None else str(v)


def tables(folder, **columns):
    for name, of in columns.items():
        pq.write_table(of if isinstance(of, pa.Table) else pa.table(of), folder / f"{name}.parquet")
    return str(folder)


def same_as_sql(spark, folder, name):
    """The rows of a query, which are those of its SQL over the tables in the folder."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    found = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    got = sorted(tuple(map(plain, r)) for r in entry.queries()[name](spark, str(folder)).select(*[f"`{c}`" for c in columns]).collect())
    assert got == want
    return got


ODD_TEXTS = ["", " ", "\n\n", "a b", " a", "a ", "a\x0bb c", "\x0b", "x y", "\x85 z", None, " ".join(map(str, range(100))), "w " * 40, "\x0b " * 90]


@pytest.mark.parametrize("name", ["chunks_40_10", "symbol_chunks"])
def test_chunks_of_blank_and_odd_texts(spark, tmp_path, name):
    texts = ODD_TEXTS * 21
    tables(tmp_path, documents={"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    assert same_as_sql(spark, tmp_path, name)


def test_nearest_vectors_leave_most_pairs_to_single_precision(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 16))
    x[1000:1500] = x[:500]
    x[7] = 0
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    score = np.round(unit @ unit.T, 9)
    scored = []
    best = retrieval._Best(unit, 5)
    for at in range(0, 3000, 500):
        scored += [len(r) for r, *_ in best.add(unit[at : at + 500], unit[at : at + 500].astype(np.float32))]
    assert sum(scored) < 3000 * 30
    vectors = spark.createDataFrame(list(zip(range(3000), x.tolist())), "id long, vec array<double>")
    monkeypatch.setattr(retrieval, "BLOCK", 512)
    got = retrieval.cosine(vectors.withColumnRenamed("id", "query_id"), vectors, 5)
    # One task does not hold all queries.
    assert "CartesianProduct" in got._jdf.queryExecution().toString()
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], round(r["score"], 9))
    for i in range(3000):
        assert [found[i][n][0] for n in range(1, 6)] == np.argsort(-score[i], kind="stable")[:5].tolist()


def test_overlaps_join_on_more_than_the_path(spark):
    rng = np.random.default_rng(3)

    def ranges(n, names):
        low = rng.integers(-40, 3000, n)
        high = low + rng.choice([-2, 0, 0, 1, 3, 40, 700], n)
        return spark.createDataFrame([(f"s{i}", f"p{i % 2}", int(a), int(b)) for i, (a, b) in enumerate(zip(low, high))], names)

    hunks, bodies = ranges(300, "x string, path string, lo long, hi long"), ranges(400, "symbol string, path string, start long, end long")
    got = match.overlaps(hunks, bodies)
    want = hunks.alias("h").join(bodies.alias("b"), "path").where("lo <= end AND start <= hi").select("symbol", "path", "lo", "hi")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(got) == rows(want)
    # 2e5 ranges against 2e5 in one path: 4e10 pairs, of which 4e5 meet.
    many = spark.range(200_000)
    n = match.overlaps(many.selectExpr("'p' AS path", "id * 10 AS lo", "id * 10 + 1 AS hi"), many.selectExpr("CAST(id AS STRING) AS symbol", "'p' AS path", "id * 10 AS start", "id * 10 + 10 AS end"))
    keys = n._jdf.queryExecution().sparkPlan().toString()
    assert "__cell" in keys.split("Join")[1].split("]")[0]
    assert n.count() == 399_999


SF = "/root/testdata/sf0.001"


def passes(df):
    """How often the Arrow pass over texts is in a plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_texts_of_one_file_are_made_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "SPREAD_ROWS", 100)
    tables(tmp_path, part={"p_partkey": pa.array(range(1000), pa.int64()), "p_size": pa.array([7] * 1000, pa.int32()), "p_brand": ["Brand#1"] * 1000})
    assert queries.doc_lines(spark, str(tmp_path)).rdd.getNumPartitions() == 10
    assert queries.constant_claims(spark, str(tmp_path)).rdd.getNumPartitions() == 10


def test_variables_are_found_in_one_pass(spark):
    assert passes(text.env_variables(queries.doc_lines(spark, SF))) == 1


def test_flags_are_found_once_and_before_their_join(spark):
    lines = queries.doc_lines(spark, SF)
    bins = spark.createDataFrame([("partctl",)], "name string")
    assert passes(checks.check_flags(text.flags(text.commands(lines), bins), queries.code_tokens(spark, SF))) == 0
    plan = text.flags(text.commands(lines), bins)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi") < plan.index("regexp_extract(tok")


def test_rules_are_taken_from_texts_once(spark):
    assert passes(queries.forbid_symbol(spark, SF)) == passes(queries.forbid_symbol_indirect(spark, SF)) == 0


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_source_files_of_one_table_are_made_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "SPREAD_ROWS", 100)
    tables(tmp_path, part={"p_partkey": pa.array(range(1000), pa.int64()), "p_size": pa.array([7] * 1000, pa.int32())})
    assert source_queries.code_symbols(spark, str(tmp_path)).rdd.getNumPartitions() == 10


def test_modules_of_a_small_file_are_not_sent_to_the_driver(spark):
    raw = spark.createDataFrame([("lib/a", "python", "lib.m1")], "from_module string, language string, raw string")
    few = spark.read.parquet(f"{SF}/part.parquet").selectExpr("'lib/m' || CAST(p_partkey AS STRING) AS module")
    assert "Broadcast" not in executed(code.module_edges(raw, few))
    assert [tuple(r) for r in code.module_edges(raw, few).collect()] == [("lib/a", "lib/m1")]


def test_claims_that_share_tokens_or_anchors_are_not_sorted_by_them(spark):
    claims = spark.createDataFrame([(i, "`f1` of `x`") for i in range(9)], "claim_id long, text string")
    symbols = spark.createDataFrame([("lib/a::f1", "f1", "lib/a", "lib/a.py", 1)], "qualified_name string, name string, module string, path string, idx int")
    grounded = evidence.ground(claims, symbols, symbols.select("module"))
    assert "ShuffledHashJoin" in executed(grounded) and grounded.count() == 9
    held = drift.claim_modules(claims.selectExpr("claim_id AS id", "'v' AS verdict", "array('f1', 'docs/1.md', 'a.py') AS anchors"), symbols)
    plan = executed(held)
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan
    assert {tuple(sorted(r["modules"])) for r in held.collect()} == {("docs/1.md", "lib/a")}


def test_claims_of_equal_words_are_ranked_once(spark, monkeypatch):
    claims = spark.createDataFrame([(i, "it is made of steel") for i in range(50)], "claim_id long, text string")
    symbols = spark.createDataFrame([("lib/a::steel", "steel", "lib/a", "public", "lib/a.py", 1, 1, 1, None, None)], "qualified_name string, name string, module string, visibility string, path string, idx int, start int, end int, signature string, doc string")
    files = spark.createDataFrame([("lib/a.py", "steel = 1")], "path string, text string")
    asked = []
    ranked = evidence.lexical
    monkeypatch.setattr(evidence, "lexical", lambda q, *rest: asked.append(q.count()) or ranked(q, *rest))
    got = evidence.gather(claims, evidence.ground(claims, symbols, symbols.select("module")), symbols, files)
    assert got.where("text = 'steel = 1' AND rank = 1").count() == 50 and asked == [1]


def test_entries_are_cut_into_tokens_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    entries = spark.range(200).selectExpr("id", "array('w' || CAST(id % 20 AS STRING), 'all') AS tokens", "array('all') AS names").mapInArrow(counted, "id long, tokens array<string>, names array<string>")
    asked = spark.createDataFrame([(1, ["w3", "all"])], "query_id long, tokens array<string>")
    assert [r["id"] for r in retrieval.lexical(asked, entries, 3).orderBy("rank").collect()] == [3, 23, 43]
    # Once for their number, once for their tokens.
    assert seen.value == 400
