"""Operators one by one on small rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars, text
from plumbline.operators import checks, code, diagrams, drift, evidence, history, match, retrieval, rules
from plumbline.sources.repo import parse_ddl
from plumbline.streaming import incremental


def lines_of(spark, body):
    return text.doc_lines(spark.createDataFrame([("d.md", body)], "doc_path string, text string"))


def test_lines_and_fences(spark):
    got = lines_of(spark, "a\r\n```\nb\n~~~\nc\n").orderBy("line_no").collect()
    assert [(r["line"], r["fenced"]) for r in got] == [("a", False), ("```", True), ("b", True), ("~~~", True), ("c", False)]


def test_line_marks_of_many_documents_equal_a_loop(spark):
    rng = np.random.default_rng(4)
    said = ["plain", "```sh", "  ~~~", "It was removed", "`removed` only", "", "\t```", "x\r"]
    docs = [(f"d{i}", None if i % 50 == 7 else "\n".join(rng.choice(said, rng.integers(0, 14)))) for i in range(700)]
    want = []
    for path, body in docs:
        if body is None:
            continue
        inside, cues = False, []
        lines = body.split("\n")
        for k, line in enumerate(lines[:-1] if lines[-1] == "" else lines, 1):
            line = line.removesuffix("\r")
            mark = line.lstrip().startswith(("```", "~~~"))
            inside ^= mark
            cues.append(line == "It was removed")
            want.append((path, k, line, mark or inside, any(cues[-5:])))
    frame = spark.createDataFrame(docs, "doc_path string, text string")
    df = text.doc_lines(frame)
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert text.doc_lines(frame.where("false")).count() == 0 and text.logical_lines(frame.where("false")).count() == 0


def test_folded_lines(spark):
    body = "# Title\nOne\n  goes on\n\n- item\n  more\n* two\n| a | b |\nlast\n```\ncode\n```\n1. three\n"
    got = text.logical_lines(spark.createDataFrame([("e", ""), ("d", body), ("n", None), ("f", "x")], "doc_path string, text string")).collect()
    assert sorted((r["doc_path"], r["start_line"], r["text"]) for r in got) == [("d", 2, "One goes on"), ("d", 5, "- item more"), ("d", 7, "* two"), ("d", 9, "last"), ("d", 13, "1. three"), ("f", 1, "x")]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("`src/a.rs`", {"src/a.rs"}), ("`dict.get`", set()), ("`app.css`", set()), ("`package.json`", {"package.json"}), ("`a/Makefile`", {"a/Makefile"}),
        ("`read/write`", set()), ("`../x/a.py`", set()), ("`/etc/a.conf`", set()), ("`x/*`", set()),
    ],
)
def test_path_claims(spark, line, want):
    assert {r["raw"] for r in text.path_claims(lines_of(spark, line)).collect()} == want


@pytest.mark.parametrize(
    ("cmd", "kind", "target"),
    [
        ("npm run x", "npm", "x"), ("npm test", None, None), ("yarn build", None, None), ("yarn lint", "npm", "lint"), ("pnpm run dev", "npm", "dev"),
        ("cargo run --bin a", "cargo", "a"), ("cargo run --bin=b", "cargo", "b"), ("cargo new --bin c", None, None),
        ("make -C sub -j4 V=1 all x", "make", "all"), ("make -f -x y", "make", "y"), ("make", None, None),
    ],
)
def test_commands(spark, cmd, kind, target):
    got = text.classify_commands(spark.createDataFrame([("d", 1, cmd)], "doc_path string, line_no int, cmd string")).collect()
    assert [(r["kind"], r["target"]) for r in got] == ([(kind, target)] if kind else [])


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("`port` defaults to 8080", [("port", "int", "8080")]), ("`a` = `0x`", [("a", "int", "0")]), ("Default is 5", []), ("max_n is set to 007", [("max_n", "int", "7")]),
        ('`mode` is "fast"', [("mode", "str", '"fast"')]), ("`x` = 1.5", []), ("`on` default: True", []), ("`on` default: true", [("on", "bool", "true")]), ("maxN = -3", [("maxN", "int", "-3")]),
    ],
)
def test_constant_claims(spark, line, want):
    assert [(r["symbol"], r["vtype"], r["vkey"]) for r in text.constant_claims(lines_of(spark, line)).collect()] == want


def test_flag_spellings(spark):
    got = spark.range(1).select(text.flag_spellings(F.lit("no-type-not")).alias("s")).first()["s"]
    assert {"no_type_not", "notypenot", "NoTypeNot", "noTypeNot", "type_not", "typeNot"} <= set(got)


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("`a` must not import `b`", [("forbid_edge", "a", "b")]), ("`a` module never uses the `b`", [("forbid_edge", "a", "b")]),
        ("`a` must not indirectly depend on `b`", [("forbid_reach", "a", "b")]), ("`db` must not be imported by `api`", [("forbid_edge", "api", "db")]),
        ("`a` and `b` are fine", []), ("`a` must not import `b` or `c` must not touch `d`", [("forbid_edge", "a", "b"), ("forbid_edge", "c", "d")]),
        ("`a` is independent of `b`", [("forbid_edge", "a", "b"), ("forbid_edge", "b", "a")]), ("`a` depends on nothing", [("layer", "a", None)]),
        ("`a` only depends on `b` and `c`", [("layer", "a", None)]), ('We say "`a` must not import `b`"', []), ("Never use `eval` outside `core`", [("forbid_symbol", "eval", None)]),
    ],
)
def test_rules(spark, line, want):
    assert sorted((r["kind"], r["a"], r["b"] or "") for r in rules.extract_rules(lines_of(spark, line)).collect()) == sorted((k, a, b or "") for k, a, b in want)


def test_rules_are_found_in_one_pass(spark):
    plan = rules.extract_rules(lines_of(spark, "`a` must not import `b`"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_operand_means_whole_segments(spark):
    mods = spark.createDataFrame([("src/api/v1",), ("src/apis",), ("api",)], "module string")
    got = match.modules_of(spark.createDataFrame([("api/",), ("api/v1",), ("ap",)], "operand string"), mods).collect()
    assert {(r["operand"], r["module"]) for r in got} == {("api/", "src/api/v1"), ("api/", "api"), ("api/v1", "src/api/v1")}


def test_reach_takes_the_nearest(spark):
    e = spark.createDataFrame([("a", "m"), ("m", "n"), ("n", "b/x"), ("m", "b/y"), ("b/y", "a")], "src string, dst string")
    r = spark.createDataFrame([("forbid_reach", "a", "b", [])], "kind string, a string, b string, items array<string>")
    assert [tuple(x) for x in rules.forbidden_reach(r, e).select("src", "hit", "depth", "chain").collect()] == [("a", "b/y", 2, ["a", "m", "b/y"])]
    assert rules.audit(r, e).first()["status"] == "Violated"
    none = spark.createDataFrame([("forbid_reach", "a", "zz", [])], "kind string, a string, b string, items array<string>")
    assert rules.forbidden_reach(none, e).count() == 0
    assert [tuple(x) for x in rules.audit(none, e).select("rule", "status", "operand").collect()] == [("`a` ✗⇢ `zz` (transitive)", "Ungrounded", "zz")]


RULES = "kind string, a string, b string, items array<string>"
EDGES = "src string, dst string"


def test_each_rule_has_its_own_exceptions(spark):
    told = spark.createDataFrame([("forbid_symbol", "eval", None, ["app"]), ("forbid_symbol", "eval", None, ["lib"]), ("layer", "app", None, ["lib"]), ("layer", "app", None, ["db"])], RULES)
    lines = spark.createDataFrame([("app", 1, "eval(x)"), ("lib", 2, "evaluate(x)"), ("lib", 3, "x.eval()")], "module string, line_no int, line string")
    edges = spark.createDataFrame([("app", "lib"), ("app", "db")], EDGES)
    got = {(r["kind"], *r["items"]): (r["status"], r["n"]) for r in rules.audit(told, edges, lines).collect()}
    assert got == {("forbid_symbol", "app"): ("Violated", 1), ("forbid_symbol", "lib"): ("Violated", 1), ("layer", "lib"): ("Violated", 1), ("layer", "db"): ("Violated", 1)}


def test_rules_on_symbols_are_audited_without_a_graph(spark):
    told = spark.createDataFrame([("forbid_symbol", "eval", None, ["app"]), ("forbid_symbol", "os.environ", None, [])], RULES)
    lines = spark.createDataFrame([("app", 1, "eval(x)"), ("lib", 2, "y = os.environ['A']")], "module string, line_no int, line string")
    got = {r["a"]: (r["rule"], r["status"], r["n"]) for r in rules.audit(told, spark.createDataFrame([], EDGES), lines).collect()}
    assert got == {"eval": ("forbid symbol `eval` (except `app`)", "Holds", None), "os.environ": ("forbid symbol `os.environ`", "Violated", 1)}
    assert rules.audit(told, spark.createDataFrame([], EDGES)).count() == 0
    scanned = {r["symbol"]: r["scanned"] for r in rules.scanned_modules(told, lines).collect()}
    assert scanned == {"eval": ["lib"], "os.environ": ["app", "lib"]}


def test_callers_of_a_forbidden_symbol(spark):
    told = spark.createDataFrame([("forbid_symbol", "raw::load", None, ["app"]), ("forbid_symbol", "twice", None, [])], RULES)
    symbols = spark.createDataFrame([("db/raw::load", "load", "db/raw.rs", 1), ("x::twice", "twice", "x.rs", 1), ("y::twice", "twice", "y.rs", 1)], "qualified_name string, name string, path string, idx int")
    refs = spark.createDataFrame([(f, t) for f in ("web::run", "app::go", "db/raw::other") for t in ("db/raw::load", "x::twice")], "from_symbol string, to_symbol string")
    direct = spark.createDataFrame([("raw::load", ["app"], "db/raw", 7)], "symbol string, items array<string>, module string, line_no int")
    # app is excepted, db/raw named it already, and two symbols are called "twice".
    assert [tuple(r) for r in rules.indirect_symbols(told, direct, symbols, refs).collect()] == [("raw::load", ["app"], "web", "web::run")]


def test_fnv(spark):
    def one(b):
        h = scalars.FNV_OFFSET
        for x in b:
            h = (h ^ x) * scalars.FNV_PRIME % 2**64
        return h

    texts = [b"", b"a", "é漢".encode(), b"hello world" * 9, b"b"]
    assert scalars.fnv1a_of(texts).tolist() == [one(t) for t in texts]
    df = spark.createDataFrame([("a",), (None,), ("",)], "t string").select(scalars.fnv1a_hex("t").alias("h"))
    assert [r["h"] for r in df.collect()] == [f"{one(b'a'):016x}", None, f"{scalars.FNV_OFFSET:016x}"]


@pytest.mark.parametrize(
    ("glob", "path", "want"),
    [("*.md", "a/b.md", True), ("docs/*.md", "docs/x/b.md", False), ("docs/**", "docs/x/b.md", True), ("**/x.md", "x.md", True), ("a?.md", "ab.md", False), ("x.md", "ax.md", False)],
)
def test_globs(spark, glob, path, want):
    assert spark.range(1).select(scalars.excluded(F.lit(path), [glob]).alias("x")).first()["x"] is want


@pytest.mark.parametrize(
    ("scores", "want"),
    [
        ([(0.65, 0.5, 0.1)], "contradicted"), ([(0.64, 0.5, 0.1)], "supported"), ([(0.8, 0.1, 0.9)], "unverifiable"), ([(0.7, 0.1, 0.2), (0.0, 0.7, 0.3)], "contradicted"),
        ([(0.4, 0.1, 0.2)], "unverifiable"), ([(0.1, 0.9, 0.0), (0.6, 0.1, 0.3)], "supported"),
    ],
)
def test_decision(spark, scores, want):
    df = spark.createDataFrame([(1, *s) for s in scores], "claim_id int, contra float, entail float, neutral float")
    assert retrieval.decide(df).first()["verdict"] == want


def test_judge_takes_any_scorer(spark):
    claims = spark.createDataFrame([(3, "a.md", 2, "x"), (2, "a.md", 10, "y"), (1, "b.md", 1, "z")], "claim_id int, path string, line_no int, text string")
    ev = spark.createDataFrame([(3, "x"), (2, "n"), (1, "z")], "claim_id int, text string")
    same = F.when(F.col("text") == F.col("evidence"), 0.9).otherwise(0.1).cast("float")
    scorer = lambda p: p.select("claim_id", (1 - same).cast("float").alias("contra"), same.alias("entail"), F.lit(0.0).alias("neutral"))
    assert {r["claim_id"]: r["verdict"] for r in retrieval.judge(claims, ev, scorer, cap=2).collect()} == {3: "supported", 2: "contradicted"}
    assert retrieval.judge(claims, ev, scorer, cap=0).count() == 3


def test_nearest_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[7] = x[3]  # a tie
    x[11] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None)]
    both = [spark.createDataFrame(rows, f"{n} long, vec array<float>").repartition(5) for n in ("query_id", "id")]
    unit = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-300)
    score = np.round(unit @ unit.T, 9)
    got = {}
    for r in retrieval.cosine(*both, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {i: sorted(range(300), key=lambda j: (-score[i][j], j))[:4] for i in range(300)}
    least = lambda pairs: pairs.withColumn("score", -F.col("id").cast("double"))
    again = {r["query_id"]: r["id"] for r in retrieval.nearest(*both, 1, least).collect()}
    assert again == {i: min(sorted(range(300), key=lambda j: (-score[i][j], j))[:4]) for i in range(300)}


def test_embedding_cache(spark):
    asked = []

    def embed(df):
        asked.extend(r["text"] for r in df.collect())
        return df.select("key", F.array(F.length("text").cast("float")).alias("vec"))

    texts = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "text string")
    first = retrieval.embedded(texts, embed, model="m")
    assert sorted(asked) == ["a", "bb"] and {r["model"] for r in first.collect()} == {"m"}
    asked.clear()
    more = retrieval.embedded(texts.union(spark.createDataFrame([("ccc",)], "text string")), embed, first, "m")
    assert asked == ["ccc"] and sorted(r["vec"][0] for r in more.collect()) == [1, 2, 3]
    asked.clear()
    retrieval.embedded(texts, embed, first, "other")
    assert sorted(asked) == ["a", "bb"]


def test_embedding_cache_on_disk(spark, tmp_path):
    asked = []

    def embed(df):
        asked.extend(r["text"] for r in df.collect())
        return df.select("key", F.array(F.length("text").cast("float")).alias("vec"))

    path = str(tmp_path / "cache")
    one, two = spark.createDataFrame([("a",), ("bb",)], "text string"), spark.createDataFrame([("bb",), ("ccc",), (None,)], "text string")
    for texts, model, new, want in ((one, "m", ["a", "bb"], [1, 2]), (two, "m", ["ccc"], [2, 3]), (two, "m", [], [2, 3]), (one, "other", ["a", "bb"], [1, 2])):
        asked.clear()
        assert sorted(r["vec"][0] for r in retrieval.embedded_at(texts, embed, path, model).collect()) == want
        assert sorted(asked) == new


def test_subwords(spark):
    got = spark.range(1).select(retrieval.subwords(F.lit("JSONSchema model_construct v2Beta the")).alias("t")).first()["t"]
    assert set(got) == {"json", "schema", "jsonschema", "model", "construct", "beta", "v2beta"}


def test_alignment_is_optimal():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = list(rng.choice(list("xyz"), rng.integers(0, 6))), list(rng.choice(list("xyz"), rng.integers(0, 6)))
        ops = diagrams.align_ops(a, b)
        got = sum(2 if k == "supported" else -1 if s and c else -2 for k, s, c in ops)

        def best(i, j, memo={}):
            key = (tuple(a), tuple(b), i, j)
            if key not in memo:
                options = []
                if i and j:
                    options.append(best(i - 1, j - 1) + (2 if a[i - 1] == b[j - 1] else -1))
                options += [best(i - 1, j) - 2] if i else []
                options += [best(i, j - 1) - 2] if j else []
                memo[key] = max(options) if options else 0
            return memo[key]

        assert got == best(len(a), len(b))
        assert [s for _, s, _ in ops if s is not None] == a and [c for *_, c in ops if c is not None] == b
    assert list(itertools.chain(diagrams.align_ops([], []))) == []


def test_mutated_diagrams(spark):
    """A right diagram is silent; each edge left out or added, and each box that isn't there, is found."""
    real = [("m/a", "m/b"), ("m/b", "m/c"), ("m/a", "m/c"), ("m/c", "m/d")]
    edges = spark.createDataFrame(real, "src string, dst string")
    mods = spark.createDataFrame([(f"m/{x}",) for x in "abcd"], "module string")
    drawn = [(f"full{i}", a, b) for i in range(1) for a, b in real]
    drawn += [(f"drop{i}", a, b) for i in range(4) for j, (a, b) in enumerate(real) if j != i]
    drawn += [("add", a, b) for a, b in [*real, ("m/d", "m/a")]]
    drawn += [("box", a, b) for a, b in [*real, ("m/a", "m/zz")]]
    got = diagrams.check_graph(spark.createDataFrame([(*d, True) for d in drawn], "origin string, src string, dst string, directed boolean"), edges, mods).where("verdict <> 'supported'").collect()
    by = {}
    for r in got:
        by.setdefault(r["origin"], []).append((r["verdict"], r["src"], r["dst"]))
    assert "full0" not in by and by["add"] == [("contradicted", "m/d", "m/a")] and by["box"] == [("stale", "m/zz", None)]
    assert by["drop0"] == [("undocumented", "m/a", "m/b")] and by["drop2"] == [("undocumented", "m/a", "m/c")]
    assert "drop3" not in by  # m/d isn't drawn then


def test_fuzzy_labels(spark):
    mods = spark.createDataFrame([("src/auth",), ("src/auth/token",), ("src/store",), ("lib/store",), ("src/apiGateway",)], "module string")
    labels = spark.createDataFrame([("Auth Service",), ("store",), ("API Gateway",), ("src/auth.py",), ("ui",), ("Tokens",)], "label string")
    got = {r["label"]: (r["how"], r["module"]) for r in diagrams.resolve_labels(labels, mods).collect()}
    assert got["Auth Service"] == ("fuzzy", "src/auth") and got["store"] == ("ambiguous", None) and got["API Gateway"] == ("fuzzy", "src/apiGateway")
    assert got["src/auth.py"] == ("exact", "src/auth") and got["ui"] == ("none", None) and got["Tokens"] == ("fuzzy", "src/auth/token")


def test_parsers():
    labels, edges = diagrams.parse_mermaid("flowchart LR\n A[web/ui] --> B(api) --- C; %% no\n subgraph x\n end\n C -.->|yes| A")
    assert labels == {"A": "web/ui", "B": "api", "C": "C"} and edges == [("A", "B", True), ("B", "C", False), ("C", "A", True)]
    labels, edges = diagrams.parse_dot('digraph { a -> b -> c; // x\n d [label="src/d"]; }')
    assert edges == [("a", "b", True)] and labels["d"] == "src/d"
    labels, edges = diagrams.parse_plantuml('component "Web UI" as ui\n[api] as A\nui --> A\nA -- db')
    assert labels["ui"] == "Web UI" and edges == [("ui", "A", True), ("A", "db", False)]
    assert diagrams.parse_plantuml("A -> B : go()") is None
    assert diagrams.parse_sequence("mermaid", "%% x\nsequenceDiagram\nactor A as B\nnote over A: b\nA->>C: go(1)\nC--)A: 1 back\nend->>A: no()") == (["B", "A", "C"], [("A", "C", "go"), ("C", "A", "1 back")])
    assert diagrams.parse_sequence("mermaid", "stateDiagram-v2\nA --> B : go") is None and diagrams.parse_sequence("dot", "A -> B : go") is None


def test_each_diagram_is_read_as_one_kind():
    kinds = {
        ("mermaid", "graph TD\nA --> B"): "graph", ("mermaid", "sequenceDiagram\nA->>B: go()"): "sequence", ("mermaid", "stateDiagram-v2\nIdle --> Running : start"): "declarations",
        ("mermaid", "classDiagram\nFoo --> Bar : uses()"): "declarations", ("plantuml", "participant A\nA -> B : go()"): "sequence", ("plantuml", "[a] --> [b]"): "graph",
        ("plantuml", "class Foo {\n +go()\n}"): "declarations", ("mermaid", "erDiagram\nA ||--o{ B : has"): "declarations",
    }
    assert {k: diagrams.kind_of(*k) for k in kinds} == kinds


def test_diagram_sources():
    body = "x\n@startuml\nA --> B\n@enduml\n```Mermaid\ngraph TD\n```\n```text\n@startuml\n@enduml\n```\n```mermaid x\ngraph TD\n```\n```dot \ndigraph{}\n"
    assert list(diagrams.sources_of(body)) == [(2, "plantuml", "@startuml\nA --> B\n@enduml"), (5, "mermaid", "graph TD")]
    assert list(diagrams.sources_of("@startuml\nA --> B")) == []
    assert parse_ddl("create table `s`.`T` (a int, b decimal(3,2), primary key (a)); CREATE TABLE x(y text)") == [("t", ["a", "b"]), ("x", ["y"])]


def test_score_counts_every_module(spark):
    f = spark.createDataFrame([("supported", ["a", "b"]), ("stale", ["a"]), ("unverifiable", ["c"]), ("contradicted", [])], "verdict string, modules array<string>")
    assert drift.score(f).first()["score"] == pytest.approx(1 / 6)
    assert {r["module"]: r["score"] for r in drift.module_scores(f).collect()} == {"a": pytest.approx(1 / 3), "b": 1.0, "(unscoped)": 0.0}
    assert drift.score(f.where("false")).first()["score"] == 1.0


def test_coupling(spark):
    rows = [(i, p) for i, ps in enumerate([["c.rs"], ["c.rs"], ["c.rs"], ["d.md", "c.rs"], ["d.md", "c.rs", "e.rs"]]) for p in ps]
    got = history.stale_documents(spark.createDataFrame(rows, "commit_idx int, path string")).collect()
    assert [tuple(r) for r in got] == [("d.md", "c.rs", 2, 3)]


def test_coupling_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    files = [f"f{i}{'.md' if i % 3 == 0 else '.rs'}" for i in range(9)]
    rows = {(int(c), str(f)) for c in range(60) for f in rng.choice(files, rng.integers(1, 5))}
    at = {f: {c for c, g in rows if g == f} for f in files}
    want = {(d, c, len(at[d] & at[c]), sum(i < min(at[d]) for i in at[c])) for d in files[::3] for c in files if not c.endswith(".md") and at[d] & at[c]}
    got = history.coupled(spark.createDataFrame(sorted(rows), "commit_idx int, path string"))
    assert {tuple(r) for r in got.collect()} == want


def test_moved_table_rows_are_silent(spark):
    body = "| `old/a.py` | `new/a.py` |\n\nSee `old/a.py`."
    paths = spark.createDataFrame([("new/a.py",)], "path string")
    got = {(r["line_no"], r["raw"]): r["verdict"] for r in checks.check_paths(text.path_claims(lines_of(spark, body)), paths).collect()}
    assert got == {(1, "new/a.py"): "supported", (3, "old/a.py"): "stale"}


def test_stream_keeps_the_last_state(spark, tmp_path):
    for i, rows in enumerate([[("1", "m", "stale", "2024-01-01 00:00:00")], [("1", "m", "supported", "2024-01-02 00:00:00"), ("2", "m", "stale", "2024-01-01 10:00:00")]]):
        spark.createDataFrame(rows, "id string, module string, verdict string, t string").selectExpr("id", "module", "verdict", "CAST(t AS TIMESTAMP) AS seen_at").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(incremental.SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.follow(stream, str(tmp_path / "ledger"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert {r["id"]: r["verdict"] for r in incremental.read(spark, str(tmp_path / "ledger")).collect()} == {"1": "supported", "2": "stale"}
    assert incremental.windowed_counts(spark.read.parquet(str(tmp_path / "in" / "1"))).count() == 2


def test_bare_rules(spark):
    mods = spark.createDataFrame([("src/Station",), ("src/evse",), ("lib/core/db",)], "module string")
    body = "The EVSE module must not depend on the Station module.\n**Station** layer cannot indirectly reach core/db.\nHigh-level modules should not depend on details.\nEvse must not use evse."
    got = {(r["kind"], r["a"], r["b"]) for r in rules.extract_bare_rules(lines_of(spark, body), mods).collect()}
    assert got == {("forbid_edge", "evse", "Station"), ("forbid_reach", "Station", "core/db")}


LIBRARY = {
    "src/cache.py": "class Cache:\n    \"\"\"Holds rows that were read.\"\"\"\n\n    def evict(self, limit):\n        return limit\n\n\ndef warm_cache(rows):\n    return rows\n",
    "src/retry.py": "def retry_with_backoff(call, delay):\n    \"\"\"Calls again after a growing delay.\"\"\"\n    return call()\n\n\nMAX_ATTEMPTS = 3\n",
    "src/store/disk.py": "def open_disk(path):\n    return path\n\n\ndef flush_pages(disk):\n    return disk\n",
    "src/store/index.py": "class BTree:\n    def insert(self, key):\n        return key\n",
    "src/http.py": "def parse_headers(raw):\n    return raw\n\n\ndef send_response(status):\n    return status\n",
    "tests/test_http.py": "def parse_headers_test():\n    pass\n",
}
ASKED = [
    ("The `Cache` keeps what was read before.", "src/cache.py"), ("Call `warm_cache` before the first request.", "src/cache.py"), ("Use `retry_with_backoff` for flaky calls.", "src/retry.py"),
    ("At most `MAX_ATTEMPTS` calls are made.", "src/retry.py"), ("Everything in `store/disk` is written in pages.", "src/store/disk.py"), ("Keys go into a `BTree` in order.", "src/store/index.py"),
    ("`parse_headers` takes raw bytes.", "src/http.py"), ("The `x` says: parse headers, then send a response.", "src/http.py"), ("A `y` calls again after a growing delay.", "src/retry.py"), ("The `z` will flush all pages.", "src/store/disk.py"),
]


def test_evidence_finds_the_right_file(spark):
    rows = [(p, p.removesuffix(".py"), "python", t) for p, t in LIBRARY.items()]
    files = spark.createDataFrame(rows, "path string, module string, language string, text string")
    symbols = code.symbols(files).cache()
    claims = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ASKED)], "claim_id int, text string")
    grounded = evidence.ground(claims, symbols, symbols.select("module").distinct())
    means = {r["claim_id"]: (r["qualified_name"], r["module"]) for r in grounded.collect()}
    assert means[0] == ("src/cache::Cache", None) and means[4] == (None, "src/store/disk") and 7 not in means
    found = evidence.gather(claims, grounded, symbols, files).cache()
    gold = spark.createDataFrame([(i, p) for i, (_, p) in enumerate(ASKED)], "claim_id int, path string")
    r = evidence.recall(found, gold).first()
    assert r["recall_at_k"] >= 0.85 and r["recall_at_1"] >= 0.7
    of_module = [(x["rank"], x["start_line"], x["score"]) for x in found.where("claim_id = 4").orderBy("rank").collect()]
    assert of_module == [(1, 1, 2.0), (2, 5, 2.0)]
    assert found.where("claim_id = 1").first()["text"] == "def warm_cache(rows):\n    return rows"


def test_chunks_follow_symbols(spark):
    long = "\n".join(f"line {i}" for i in range(1, 151)) + "\n"
    files = spark.createDataFrame([("src/a.py", long), ("src/b.py", long), ("tests/c.py", long), ("src/d.py", "\n \n")], "path string, text string")
    spans = spark.createDataFrame([("src/a.py", 3, 10), ("src/a.py", 4, 6), ("src/a.py", 20, 110), ("src/d.py", 1, 2)], "path string, start int, end int")
    got = sorted((r["path"], r["start_line"], r["n_lines"]) for r in evidence.symbol_chunks(files, spans).collect())
    windows = lambda first, last: [(first + k * 30, min(40, last - first - k * 30 + 1)) for k in range(-(-(last - first - 39) // 30) + 1)]
    assert got == sorted([("src/a.py", 3, 8), *(("src/a.py", *w) for w in windows(20, 110)), *(("src/b.py", *w) for w in windows(1, 150))])


@pytest.mark.parametrize(
    ("path", "want"),
    [("src/a.py", True), ("tests/a.py", False), ("a/Test/b.rs", False), ("contest/a.py", True), ("a/test_b.py", False), ("a/b_test.go", False), ("a/b.spec.ts", False), ("conftest.py", False), ("a/b.test.py", True)],
)
def test_library_files(spark, path, want):
    assert spark.range(1).select(evidence.is_library(F.lit(path)).alias("x")).first()["x"] is want


@pytest.mark.parametrize("hot_least", [1000, 3])
def test_lexical_ranks_equal_brute_force(spark, hot_least):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(30)]
    chance = 1 / np.arange(1, 31)
    chance /= chance.sum()
    some = lambda n: [str(w) for w in rng.choice(words, n, replace=False, p=chance)]
    entries = [(i, t := some(rng.integers(0, 9)), t[: rng.integers(0, 3)]) for i in range(120)]
    queries = [(i, some(rng.integers(0, 6))) for i in range(60)] + [(60 + i, ["w0", "w1"]) for i in range(5)]
    df = {w: sum(w in t for _, t, _ in entries) for w in words}
    idf = {w: np.log(1 + len(entries) / (1 + df[w])) for w in words}
    want = {}
    for q, asked in queries:
        scored = [(sum(idf[w] * (2 if w in names else 1) for w in set(asked) & set(t)), i) for i, t, names in entries]
        want[q] = [i for s, i in sorted(((-round(s, 9), i) for s, i in scored if s >= 0.5))[:4]]
    e = spark.createDataFrame(entries, "id int, tokens array<string>, names array<string>")
    q = spark.createDataFrame(queries, "query_id int, tokens array<string>")
    got = {x: [] for x, _ in queries}
    for r in retrieval.lexical(q, e, 4, hot_least=hot_least).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["id"])
    assert got == want
