"""Registered queries over source text written from the tables: manifests, diffs, code, facts and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import checks, code, diagrams, drift, rules
from plumbline.plans import repository
from plumbline.plans.queries import query, spread, table
from plumbline.sources import repo

_S = "CAST(s_suppkey AS STRING)"
_N = "CAST(s_nationkey AS STRING)"


def manifests(spark, sf_dir) -> DataFrame:
    """(path, text): a package.json, a Makefile and a Cargo.toml for each supplier, some of which don't parse."""
    npm = f"CASE WHEN s_suppkey % 11 = 0 THEN '{{\"scripts\": {{' ELSE '{{\"name\": \"p' || {_S} || '\", \"scripts\": {{\"build\": \"x\", \"s' || CAST(s_suppkey % 9 AS STRING) || '\": \"y\"}}' || CASE WHEN s_suppkey % 2 = 0 THEN ', \"bin\": {{\"b' || {_S} || '\": \"x.js\"}}' ELSE '' END || '}}' END"
    make = f"'X := 1' || chr(10) || '.PHONY: all t' || CAST(s_suppkey % 5 AS STRING) || chr(10) || 'all one/' || {_S} || ': dep' || chr(10) || chr(9) || 'cmd: x' || chr(10) || '# c: d'"
    cargo = f"'[package]' || chr(10) || 'name = \"k' || {_S} || '\"' || chr(10) || '[dependencies]' || chr(10) || 'name = \"no\"' || chr(10) || ' [[bin]]' || chr(10) || 'path = \"x\"' || chr(10) || 'name = \"b' || CAST(s_suppkey % 6 AS STRING) || '\"'"
    rows = ", ".join(f"named_struct('path', 'd' || {_N} || '/s' || {_S} || '/{name}', 'text', {text})" for name, text in (("package.json", npm), ("Makefile", make), ("Cargo.toml", cargo)))
    return table(spark, sf_dir, "supplier").selectExpr(f"explode(array({rows})) AS f").select("f.*")


def _entries(spark, sf_dir) -> DataFrame:
    texts = manifests(spark, sf_dir)
    mains = table(spark, sf_dir, "supplier").selectExpr(f"explode(array('d' || {_N} || '/s' || {_S} || CASE WHEN s_suppkey % 3 = 0 THEN '/src/main.rs' ELSE '/src/lib.rs' END, 'd' || {_N} || '/s' || {_S} || '/src/bin/tool' || CAST(s_suppkey % 4 AS STRING) || '.rs')) AS path")
    return repo.npm_manifests(texts)[0].union(repo.make_targets(texts)).union(repo.cargo_bins(texts, mains))


_ENTRIES_CTE = """f AS (SELECT 'd' || s_nationkey || '/s' || s_suppkey AS dir, s_suppkey AS k FROM supplier),
entries AS (SELECT dir, 'npm' AS kind, unnest(['build', 's' || (k % 9)]) AS name FROM f WHERE k % 11 <> 0
 UNION ALL SELECT dir, 'make', unnest(['.PHONY', 'all', 't' || (k % 5), 'one/' || k]) FROM f
 UNION ALL SELECT dir, 'cargo', unnest(CASE WHEN k % 3 = 0 THEN ['k' || k, 'b' || (k % 6), 'tool' || (k % 4)] ELSE ['b' || (k % 6), 'tool' || (k % 4)] END) FROM f)"""


@query(f"WITH {_ENTRIES_CTE} SELECT * FROM entries")
def manifest_entries(spark, sf_dir):
    return _entries(spark, sf_dir)


@query("SELECT 'd' || s_nationkey || '/s' || s_suppkey AS dir, CASE WHEN s_suppkey % 2 = 0 THEN 'b' ELSE 'p' END || s_suppkey AS name FROM supplier WHERE s_suppkey % 11 <> 0")
def npm_binaries(spark, sf_dir):
    return repo.npm_manifests(manifests(spark, sf_dir))[1]


@query(
    """WITH d AS (SELECT p_partkey, 'd' || (p_partkey % 25) || CASE p_partkey % 3 WHEN 0 THEN '/s' || (p_partkey % 120) || '/docs/x.md' WHEN 1 THEN '/readme.md' ELSE '/s' || (p_partkey % 120) || '/' || p_partkey || '.md' END AS doc_path FROM part),
m AS (SELECT DISTINCT 'd' || s_nationkey || '/s' || s_suppkey AS dir, 'npm' AS kind FROM supplier WHERE s_suppkey % 11 <> 0 UNION SELECT DISTINCT 'd' || s_nationkey, 'make' FROM supplier UNION SELECT '', 'cargo'),
j AS (SELECT DISTINCT doc_path, kind, dir FROM d JOIN m ON dir = '' OR doc_path LIKE dir || '/%')
SELECT doc_path, kind, arg_max(dir, length(dir)) AS dir FROM j GROUP BY ALL"""
)
def nearest_manifest(spark, sf_dir):
    k = "CAST(p_partkey % 120 AS STRING)"
    docs = table(spark, sf_dir, "part").selectExpr(f"'d' || CAST(p_partkey % 25 AS STRING) || CASE p_partkey % 3 WHEN 0 THEN '/s' || {k} || '/docs/x.md' WHEN 1 THEN '/readme.md' ELSE '/s' || {k} || '/' || CAST(p_partkey AS STRING) || '.md' END AS doc_path").distinct()
    s = table(spark, sf_dir, "supplier")
    found = s.where("s_suppkey % 11 <> 0").selectExpr(f"'d' || {_N} || '/s' || {_S} AS dir", "'npm' AS kind").union(s.selectExpr(f"'d' || {_N}", "'make'"))
    return repo.nearest(docs, found.union(spark.createDataFrame([("", "cargo")], "dir string, kind string")))


def diffs(spark, sf_dir) -> DataFrame:
    """A diff for each order, with a file for each line of it: edited, deleted from, or renamed."""
    k = "CAST(l_partkey AS STRING)"
    head = f"'diff --git a/p' || {k} || '.py b/p' || {k} || '.py'"
    q = "CAST(CAST(l_quantity AS INT) AS STRING)"
    body = f"CASE l_linenumber % 3 WHEN 0 THEN array({head}, 'rename from p' || {k} || '.py', 'rename to q' || {k} || '.py') WHEN 1 THEN array({head}, '--- a/p' || {k} || '.py', '+++ b/p' || {k} || '.py', '@@ -1,2 +' || {q} || ',3 @@ f', '+++ x', '@@ -9 +90 @@') ELSE array({head}, '@@ -7,2 +5,0 @@', '@@ -9,2 +' || {q} || ' @@') END"
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").distinct()
    each = li.selectExpr("l_orderkey AS diff", "l_linenumber * 100000000000 + l_partkey * 100000 + CAST(l_quantity AS INT) * 100 AS at", f"posexplode({body}) AS (i, line)")
    return each.selectExpr("diff", "at + i AS pos", "line")


@query(
    """WITH l AS (SELECT l_orderkey AS diff, l_linenumber % 3 AS m, 'p' || l_partkey || '.py' AS path, l_quantity::INT AS q FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem))
SELECT diff, path, unnest([q, 90]) AS lo, unnest([q + 2, 90]) AS hi FROM l WHERE m = 1 UNION ALL SELECT diff, path, q, q FROM l WHERE m = 2"""
)
def diff_hunks(spark, sf_dir):
    return repo.parse_diff(diffs(spark, sf_dir))[1]


@query("SELECT l_orderkey AS diff, CASE WHEN l_linenumber % 3 = 0 THEN 'q' ELSE 'p' END || l_partkey || '.py' AS path, CASE WHEN l_linenumber % 3 = 0 THEN 'p' || l_partkey || '.py' END AS renamed_from FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem)")
def diff_files(spark, sf_dir):
    return repo.parse_diff(diffs(spark, sf_dir))[0]


_PATH = "'src/' || CASE p_partkey % 8 WHEN 0 THEN 'CHANGELOG.md' WHEN 1 THEN 'changes/' || CAST(p_partkey AS STRING) || '.md' WHEN 2 THEN 'a.b/' || CAST(p_partkey AS STRING) || '.pyi' WHEN 3 THEN 'x.' || CAST(p_partkey AS STRING) || '.TSX' WHEN 4 THEN 'Makefile' WHEN 5 THEN 'm' || CAST(p_partkey AS STRING) || '.cts' WHEN 6 THEN 'go/' || CAST(p_partkey AS STRING) || '.go' ELSE 'r' || CAST(p_partkey AS STRING) || '.rs' END"


@query(
    f"""WITH f AS (SELECT p_partkey, p_partkey % 8 AS m, {_PATH} AS path, p_size * 50000 AS size FROM part)
SELECT p_partkey, m IN (0, 1) AS changelog, CASE m WHEN 2 THEN 'python' WHEN 3 THEN 'tsx' WHEN 5 THEN 'typescript' WHEN 7 THEN 'rust' END AS language,
 CASE m WHEN 0 THEN 'src/CHANGELOG' WHEN 1 THEN 'src/changes/' || p_partkey WHEN 2 THEN 'src/a.b/' || p_partkey WHEN 3 THEN 'src/x.' || p_partkey WHEN 4 THEN 'src/Makefile' WHEN 5 THEN 'src/m' || p_partkey WHEN 6 THEN 'src/go/' || p_partkey ELSE 'src/r' || p_partkey END AS module,
 m IN (3, 6, 7) AND size <= 2097152 AS code FROM f"""
)
def source_kinds(spark, sf_dir):
    path = F.expr(_PATH)
    is_code = repo.is_code(path, F.col("p_size") * 50000)
    return table(spark, sf_dir, "part").select("p_partkey", repo.is_changelog(path).alias("changelog"), repo.language_of(path).alias("language"), repo.module_of(path).alias("module"), is_code.alias("code"))


def modules(spark, sf_dir) -> DataFrame:
    """(path, module, language, text): a source file for each part, in Python, Rust or TypeScript by turns."""
    k, size = "CAST(p_partkey AS STRING)", "CAST(p_size AS STRING)"
    near = "CAST(p_partkey - p_partkey % 30 + p_size % 30 AS STRING)"
    python = f"'import os, lib.m' || {near} || ' as m' || chr(10) || chr(10) || 'LIMIT_' || {k} || ' = ' || {size} || chr(10) || chr(10) || 'def go' || {k} || '(a, b):' || chr(10) || '    if a > ' || {size} || ':' || chr(10) || '        stop(b)' || chr(10) || '    return a.run(\"x\")' || chr(10) || chr(10) || 'class _Kind' || {k} || '(Enum):' || chr(10) || '    RED = 1' || chr(10) || '    BLUE = 2' || chr(10)"
    rust = f"'use crate::m' || {near} || '::{{' || chr(10) || '  go,' || chr(10) || '}};' || chr(10) || 'pub fn go' || {k} || '(a: u32) -> u32 {{' || chr(10) || '    while a > ' || {size} || ' {{' || chr(10) || '        stop(b);' || chr(10) || '    }}' || chr(10) || '    run(7)' || chr(10) || '}}' || chr(10) || 'enum Kind' || {k} || ' {{' || chr(10) || '    Red,' || chr(10) || '    Blue(u8),' || chr(10) || '}}' || chr(10)"
    script = f"'import {{' || chr(10) || '  go,' || chr(10) || '}} from \"./m' || {near} || '\";' || chr(10) || 'export function go' || {k} || '(a) {{' || chr(10) || '  if (a > ' || {size} || ') return stop(b);' || chr(10) || '  return run(7);' || chr(10) || '}}' || chr(10)"
    kind = "CASE p_partkey % 3 WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE {2} END"
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).selectExpr(
        "'lib/m' || CAST(p_partkey AS STRING) || " + kind.format("'.py'", "'.rs'", "'.ts'") + " AS path", "'lib/m' || CAST(p_partkey AS STRING) AS module",
        kind.format("'python'", "'rust'", "'typescript'") + " AS language", kind.format(python.replace("{{", "{").replace("}}", "}"), rust.replace("{{", "{").replace("}}", "}"), script.replace("{{", "{").replace("}}", "}")) + " AS text",
    )


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size AS z, p_partkey % 3 AS m FROM part)
SELECT 'lib/m' || k || '::' || name AS qualified_name, kind, visibility, lo AS start, hi AS "end", constants, predicates, calls, members, returns AS return_shape FROM (
 SELECT k, 'LIMIT_' || k AS name, 'const' AS kind, 'public' AS visibility, 3 AS lo, 3 AS hi, z::VARCHAR AS constants, '' AS predicates, '' AS calls, '' AS members, NULL AS returns FROM p WHERE m = 0
 UNION ALL SELECT k, 'go' || k, 'function', 'public', 5, 8, '"x",' || z, 'a > ' || z, 'stop,run', '', NULL FROM p WHERE m = 0
 UNION ALL SELECT k, '_Kind' || k, 'enum', 'private', 10, 12, '1,2', '', '', 'RED,BLUE', NULL FROM p WHERE m = 0
 UNION ALL SELECT k, 'go' || k, 'function', 'public', 4, 9, CASE WHEN z = 7 THEN '7' WHEN z::VARCHAR < '7' THEN z || ',7' ELSE '7,' || z END, 'a > ' || z, 'stop,run', '', 'u32' FROM p WHERE m = 1
 UNION ALL SELECT k, 'Kind' || k, 'enum', 'private', 10, 13, '', '', 'Blue', 'Red,Blue', NULL FROM p WHERE m = 1
 UNION ALL SELECT k, 'go' || k, 'function', 'public', 4, 7, CASE WHEN z = 7 THEN '7' WHEN z::VARCHAR < '7' THEN z || ',7' ELSE '7,' || z END, 'a > ' || z, 'stop,run', '', NULL FROM p WHERE m = 2)"""
)
def code_symbols(spark, sf_dir):
    """Definitions with their facts, calls and members in three languages."""
    listed = [F.array_join(c, ",").alias(c) for c in ("constants", "predicates", "calls", "members")]
    return code.symbols(modules(spark, sf_dir)).select("qualified_name", "kind", "visibility", "start", "end", *listed, "return_shape")


@query(
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 3 AS m, p_partkey - p_partkey % 30 + p_size % 30 AS near FROM part)
SELECT 'lib/m' || p.k AS src, 'lib/m' || p.near AS dst FROM p JOIN p AS q ON q.k = p.near WHERE p.near <> p.k"""
)
def import_edges(spark, sf_dir):
    """Imports over several lines, resolved by the rules of each language."""
    found = modules(spark, sf_dir)
    return code.module_edges(code.imports(found), found.select("module"))


@query(
    r"""WITH e AS (SELECT event_id, user_id % 40 AS name, CASE event_id % 7 WHEN 0 THEN '"' || event_type || '"' WHEN 1 THEN 'b''x' || (event_id % 5) || '''' WHEN 2 THEN '0' || (event_id % 90) || '_000' WHEN 3 THEN 'True' WHEN 4 THEN '"has space"' WHEN 5 THEN '-0' ELSE 'null' END AS raw FROM events)
SELECT DISTINCT 'c' || name AS name, CASE event_id % 7 WHEN 0 THEN 'str' WHEN 1 THEN 'str' WHEN 2 THEN 'int' WHEN 3 THEN 'bool' ELSE 'int' END AS vtype,
 CASE event_id % 7 WHEN 0 THEN raw WHEN 1 THEN '"x' || (event_id % 5) || '"' WHEN 2 THEN (event_id % 90 * 1000)::VARCHAR WHEN 3 THEN 'true' ELSE '-0' END AS vkey FROM e WHERE event_id % 7 NOT IN (4, 6) AND NOT (event_id % 7 = 2 AND event_id % 90 = 0)
UNION SELECT 'c' || name, 'int', '0' || '000' FROM e WHERE false UNION SELECT 'c' || name, 'int', '0' FROM e WHERE event_id % 7 = 2 AND event_id % 90 = 0"""
)
def constant_literals(spark, sf_dir):
    """Literals of code as values that can be compared; strings with white space and null are none."""
    raw = "CASE event_id % 7 WHEN 0 THEN '\"' || event_type || '\"' WHEN 1 THEN 'b\\'x' || CAST(event_id % 5 AS STRING) || '\\'' WHEN 2 THEN '0' || CAST(event_id % 90 AS STRING) || '_000' WHEN 3 THEN 'True' WHEN 4 THEN '\"has space\"' WHEN 5 THEN '-0' ELSE 'null' END"
    ev = table(spark, sf_dir, "events").selectExpr("'c' || CAST(user_id % 40 AS STRING) AS name", f"{raw} AS raw")
    return checks.literals(ev.groupBy("name").agg(F.collect_set("raw").alias("constants")))


@query(
    """WITH e AS (SELECT user_id AS id, event_id AS pos, event_type AS c, CASE WHEN event_id % 5 > 0 THEN 'f' || (event_id % 3) END AS sig, 'x > ' || (event_id % 4) AS p FROM events),
f AS (SELECT id, 'C:' || array_to_string(list_sort(list(DISTINCT c)), ',') || '|S:' || coalesce(arg_min(sig, pos), '') || '|P:' || array_to_string(list_sort(list(DISTINCT p)), ',') || '|R:' AS s FROM e GROUP BY id)
SELECT id, printf('%016x', list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, octet_length(encode(s)) + 1), lambda i: ('0x' || substr(hex(encode(s)), 2 * i::BIGINT - 1, 2))::UHUGEINT)),
  lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT) AS facts_hash FROM f"""
)
def fact_hashes(spark, sf_dir):
    """The facts of all that a claim is anchored to as one fingerprint."""
    e = table(spark, sf_dir, "events").selectExpr("user_id AS id", "event_id AS pos", "array(event_type) AS constants", "array('x > ' || CAST(event_id % 4 AS STRING)) AS predicates", "CASE WHEN event_id % 5 > 0 THEN 'f' || CAST(event_id % 3 AS STRING) END AS signature", "CAST(NULL AS STRING) AS return_shape")
    return drift.merged_facts(e).select("id", scalars.fact_fingerprint(F.col("constants"), F.col("signature"), F.col("predicates"), F.col("return_shape")).alias("facts_hash"))


@query(
    """WITH sym AS (SELECT 'n' || p_partkey AS name, 'lib/g' || (p_partkey % 20) || '/m' || p_partkey AS module FROM part),
c AS (SELECT o_orderkey AS id, o_orderstatus AS verdict, unnest(['n' || (o_custkey % 3000), 'm' || (o_custkey % 2500) || '.py', 'docs/' || (o_custkey % 7) || '.md']) AS anchor FROM orders WHERE o_orderkey % 9 <> 0),
one AS (SELECT id, verdict, coalesce(a.module, b.module, anchor) AS module FROM c LEFT JOIN sym a ON a.name = anchor LEFT JOIN sym b ON anchor = string_split(b.module, '/')[3] || '.py')
SELECT id, verdict, array_to_string(list_sort(list(DISTINCT module)), ' ') AS modules FROM one GROUP BY ALL UNION ALL SELECT o_orderkey, o_orderstatus, '' FROM orders WHERE o_orderkey % 9 = 0"""
)
def claim_modules(spark, sf_dir):
    """Where claims count: by symbol, by the end of a path, else under what they name."""
    k = "CAST(p_partkey AS STRING)"
    sym = table(spark, sf_dir, "part").selectExpr(f"'n' || {k} AS name", f"'lib/g' || CAST(p_partkey % 20 AS STRING) || '/m' || {k} AS module", f"'x::n' || {k} AS qualified_name", f"'lib/g' || CAST(p_partkey % 20 AS STRING) || '/m' || {k} || '.py' AS path")
    anchors = "array('n' || CAST(o_custkey % 3000 AS STRING), 'm' || CAST(o_custkey % 2500 AS STRING) || '.py', 'docs/' || CAST(o_custkey % 7 AS STRING) || '.md')"
    claims = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS verdict", f"CASE WHEN o_orderkey % 9 <> 0 THEN {anchors} ELSE array() END AS anchors")
    return drift.claim_modules(claims, sym).select("id", "verdict", F.array_join(F.array_sort("modules"), " ").alias("modules"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 'new and undocumented: ' ELSE 'undocumented: ' END || 'public function `f' || p_partkey || '`' || CASE WHEN p_size % 4 + p_size % 3 + p_size % 2 = 0 THEN '' ELSE ' (' || array_to_string(list_filter([
 CASE WHEN p_size % 4 = 1 THEN '1 caller' WHEN p_size % 4 > 1 THEN (p_size % 4) || ' callers' END, CASE WHEN p_size % 3 = 1 THEN '1 branch' WHEN p_size % 3 > 1 THEN (p_size % 3) || ' branches' END, CASE WHEN p_size % 2 = 1 THEN '1 commit' END], lambda x: x IS NOT NULL), ', ') || ')' END AS said FROM part"""
)
def gap_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    said = repository.gap_text(F.lit("function"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")), F.col("p_size") % 4, F.col("p_size") % 3, F.col("p_size") % 2, F.col("p_partkey") % 2)
    return p.select("p_partkey", said.alias("said"))


_LABEL = "CASE p_partkey % 6 WHEN 0 THEN 'The Unit' || CAST(p_size AS STRING) || ' Service' WHEN 1 THEN 'unit' || CAST(p_size AS STRING) WHEN 2 THEN 'src/unit' || CAST(p_size AS STRING) || '.rs' WHEN 3 THEN 'Units' || CAST(p_size AS STRING) || ' Module' WHEN 4 THEN 'StoreRooms Lot' || CAST(p_size % 4 AS STRING) ELSE 'server' END"


@query(
    f"""WITH l AS (SELECT DISTINCT {_LABEL} AS label, p_partkey % 6 AS m, p_size AS z FROM part), one AS (SELECT label, any_value(m) AS m, any_value(z) AS z FROM l GROUP BY label),
have AS (SELECT DISTINCT s_suppkey % 40 AS z FROM supplier)
SELECT label, CASE WHEN m IN (1, 2) AND have.z IS NOT NULL THEN 'exact' WHEN m = 0 AND have.z IS NOT NULL THEN 'fuzzy' WHEN m = 4 THEN 'fuzzy' ELSE 'none' END AS how,
 CASE WHEN m IN (0, 1, 2) AND have.z IS NOT NULL THEN 'src/unit' || one.z WHEN m = 4 THEN 'src/storeRoom/lot' || (one.z % 4) END AS module FROM one LEFT JOIN have USING (z)"""
)
def label_resolution(spark, sf_dir):
    """Labels of boxes: the module itself, the one it means, or by its words without filler, in any case and number."""
    labels = table(spark, sf_dir, "part").selectExpr(f"{_LABEL} AS label")
    mods = table(spark, sf_dir, "supplier").selectExpr("'src/unit' || CAST(s_suppkey % 40 AS STRING) AS module").union(spark.range(4).selectExpr("'src/storeRoom/lot' || CAST(id AS STRING)"))
    return diagrams.resolve_labels(labels, mods.distinct())


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ['a::b' || p_size, 'b' || p_size] ELSE ['x' || p_partkey] END AS ends FROM part")
def qualified_ends(spark, sf_dir):
    name = "CASE WHEN p_partkey % 2 = 0 THEN 'a::b' || CAST(p_size AS STRING) ELSE 'x' || CAST(p_partkey AS STRING) END"
    return table(spark, sf_dir, "part").select("p_partkey", rules.ends(F.expr(name)).alias("ends"))
