"""The registered queries over whole tables, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import checks, drift, rules
from plumbline.operators.lineage import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A document for each part, the same expression in both engines.
_K = "CAST(p_partkey AS STRING)"
_KNOWN = " ".join([*text.SYSTEM_VARIABLES, *text.PLACEHOLDERS])
_ROWS = [
    f"'# Part ' || {_K}",
    "CASE WHEN p_size % 17 = 0 THEN 'It was removed from the list, see `src/legacy.rs` for more.' ELSE 'It is on the list.' END",
    f"'See `src/p' || {_K} || '.rs` and `docs/part_' || CAST(p_size AS STRING) || '.md` for the'",
    "'whole story, or `typing.Deque` and `package.json` instead.'",
    f"'| `old/q' || {_K} || '.py` | `src/q' || CAST(p_partkey % 100 AS STRING) || '.py` |'",
    "''",
    f"'- Run `npm run s' || CAST(p_partkey % 50 AS STRING) || '` or `make -j 4 V=1 t' || CAST(p_partkey % 30 AS STRING) || ' && cargo run --bin b' || CAST(p_partkey % 20 AS STRING) || '`,'",
    "'  or `yarn build` and `cargo new --bin tool` first.'",
    "'```sh'",
    f"'$ yarn s' || CAST(p_partkey % 60 AS STRING) || ' ; partctl --part-' || lower(substr(p_brand, 1, 5)) || ' --size' || CAST(p_size AS STRING) || ' --no-color --help'",
    "'export PART_LOCAL_' || CAST(p_size AS STRING) || '=1'",
    "'``` '",
    f"'Set `PART_' || CAST(p_partkey % 100 AS STRING) || '_MODE` or $SUPP_' || CAST(p_partkey % 40 AS STRING) || ' before, not $PART_LOCAL_' || CAST(p_size AS STRING) || ' or $HOME.'",
    f"'The `size_' || {_K} || '` defaults to ' || CAST(p_size AS STRING) || ', and maxRetries = `0' || CAST(p_size AS STRING) || '`; Default is 5.'",
    f"'See `crate::m' || CAST(p_partkey % 7 AS STRING) || '::part' || CAST(p_partkey % 90 AS STRING) || '` and `Kind' || CAST(p_size % 5 AS STRING) || '::Variant` or `std::io`.'",
    "'The `lib/n' || CAST(p_partkey % 25 AS STRING) || '` module must not depend on `n' || CAST(p_partkey * 7 % 25 AS STRING) || '`.'",
    "'`n' || CAST(p_partkey % 25 AS STRING) || '` should never use the `n' || CAST(p_partkey * 3 % 25 AS STRING) || '` and \"`x` must not use `y`\" is an example.'",
    "'`n' || CAST(p_size % 25 AS STRING) || '` only depends on `n' || CAST(p_partkey % 25 AS STRING) || '` or `n' || CAST(p_size % 7 AS STRING) || '`.'",
    "'`n' || CAST(p_partkey % 24 AS STRING) || '` must not transitively reach `n' || CAST(p_partkey * 11 % 25 AS STRING) || '`.'",
    "'Please don''t call `eval' || CAST(p_partkey % 15 AS STRING) || '` outside `lib/n' || CAST(p_partkey % 5 AS STRING) || '`.'",
    f"'It needs $' || split_part('{_KNOWN}', ' ', CAST(p_partkey % {len(_KNOWN.split())} + 1 AS INT)) || ' and `' || split_part('{_KNOWN}', ' ', CAST(p_size % {len(_KNOWN.split())} + 1 AS INT)) || '` or $MY_' || CAST(p_size AS STRING) || ', `A_YOUR_KEY`, `PART_' || CAST(p_size AS STRING) || '_PLACEHOLDER`.'",
    "'`n' || CAST(p_partkey % 23 AS STRING) || '` must not be imported by `n' || CAST(p_size % 24 AS STRING) || '`.'",
    "'The `lib/n' || CAST(p_size % 21 AS STRING) || '` package is independent of the `lib/n' || CAST(p_partkey * 13 % 25 AS STRING) || '`.'",
    "'The `n' || CAST(p_partkey % 22 AS STRING) || '` layer has no dependencies.'",
    "'No raw use of `os.environ' || CAST(p_size % 9 AS STRING) || '` except in `n' || CAST(p_partkey % 6 AS STRING) || '`.'",
]
DOC_TEXT = " || chr(10) || ".join(f"({r})" for r in _ROWS)
_DOC_CTE = f"docs AS (SELECT 'part_' || {_K} || '.md' AS doc_path, {DOC_TEXT} AS text FROM part)"
_LINES_CTE = (
    _DOC_CTE
    + """, raw AS (SELECT doc_path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM docs),
marks AS (SELECT *, (ltrim(line) LIKE '```%' OR ltrim(line) LIKE '~~~%') AS mark FROM raw),
l AS (SELECT doc_path, line_no::INT AS line_no, line, mark, (mark OR sum(mark::INT) OVER (PARTITION BY doc_path ORDER BY line_no) % 2 = 1) AS fenced FROM marks)"""
)


#: Rows of a narrow table from which one task makes texts.
SPREAD_ROWS = 20_000


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows of a table's file dealt to tasks of at most about SPREAD_ROWS, and to all cores, before long texts are made of
    them: the file may be of few partitions, whatever its rows. Its footer has their number."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SPREAD_ROWS)))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"))
    return parts.selectExpr(f"'part_' || {_K} || '.md' AS doc_path", f"{DOC_TEXT} AS text")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.doc_lines(docs(spark, sf_dir))


@query(f"WITH {_LINES_CTE} SELECT doc_path, line_no, fenced, length(line)::INT AS n FROM l")
def fence_flags(spark, sf_dir):
    return doc_lines(spark, sf_dir).select("doc_path", "line_no", "fenced", F.length("line").alias("n"))


_EXT = "'" + "','".join(text.PATH_EXTENSIONS) + "'"
_MAN = "'" + "','".join(text.ROOT_MANIFESTS) + "'"
_CLAIMS_CTE = (
    _LINES_CTE
    + rf""", cued AS (SELECT *, max(regexp_matches(regexp_replace(line, '`[^`]*`', ' ', 'g'),
  '(?i)\b(as-built|deleted?|deletes|deprecated|former(ly)?|legacy|moved|no longer|old path|original plan|previously|removal|removed?|removes|renamed?|replaced?|used to)\b')::INT)
  OVER (PARTITION BY doc_path ORDER BY line_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 1 AS historical FROM l),
claims AS (SELECT doc_path, line_no, raw, historical, contains(line, '|') AS table_row FROM (
  SELECT *, unnest(regexp_extract_all(line, '`([-./\w]+/[-./\w]+|[-\w]+[.]\w{{1,5}})`', 1)) AS raw FROM cued WHERE NOT fenced)
  WHERE NOT (raw LIKE '/%' OR raw LIKE '../%' OR raw LIKE '*%' OR raw LIKE '%/*' OR contains(raw, '://'))
  AND CASE WHEN lower(regexp_extract(raw, '\.([^./]*)$', 1)) IN ({_EXT}) THEN contains(raw, '/') OR lower(raw) IN ({_MAN}) ELSE false END)"""
)


@query(f"WITH {_CLAIMS_CTE} SELECT doc_path, line_no, raw, historical, table_row FROM claims")
def path_claims(spark, sf_dir):
    return text.path_claims(doc_lines(spark, sf_dir))


def repo_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the parts that were sold, three parts to a file."""
    sold = table(spark, sf_dir, "lineitem").selectExpr("l_partkey - l_partkey % 3 AS k", "l_partkey % 70 AS m").distinct()
    return sold.selectExpr("explode(array('crates/core/src/p' || CAST(k AS STRING) || '.rs', 'src/q' || CAST(m AS STRING) || '.py')) AS path").distinct()


_PATHS_CTE = """paths AS (SELECT DISTINCT unnest(['crates/core/src/p' || (l_partkey - l_partkey % 3) || '.rs', 'src/q' || (l_partkey % 70) || '.py']) AS path FROM lineitem),
needles AS (SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), i, 99), '/') AS needle FROM paths, range(1, 9) AS t(i) WHERE i <= len(string_split(path, '/')))"""
_FINDINGS_CTE = (
    f"{_CLAIMS_CTE}, {_PATHS_CTE}"
    + """, seen AS (SELECT c.*, n.needle IS NOT NULL AS found FROM claims c LEFT JOIN needles n ON regexp_replace(regexp_replace(c.raw, '^(\\./)+', ''), '/+$', '') = n.needle),
grp AS (SELECT *, count(*) OVER w >= 2 AND bool_and(table_row) OVER w AND bool_or(found) OVER w AS moved FROM seen WINDOW w AS (PARTITION BY doc_path, line_no)),
findings AS (SELECT doc_path, line_no, raw, CASE WHEN found THEN 'supported' ELSE 'stale' END AS verdict FROM grp WHERE found OR NOT (historical OR moved))"""
)


@query(f"WITH {_FINDINGS_CTE} SELECT * FROM findings")
def path_findings(spark, sf_dir):
    return checks.check_paths(text.path_claims(doc_lines(spark, sf_dir)), repo_paths(spark, sf_dir))


_SCORE = "coalesce(sum(CASE verdict WHEN 'supported' THEN 1 ELSE 0 END) / nullif(sum(CASE verdict WHEN 'supported' THEN 1 WHEN 'contradicted' THEN 3 WHEN 'stale' THEN 2 WHEN 'undocumented' THEN 1 ELSE 0 END), 0), 1.0)"


@query(
    f"""WITH {_FINDINGS_CTE}, per AS (SELECT p_brand AS module, verdict FROM findings JOIN part ON doc_path = 'part_' || p_partkey || '.md')
SELECT module, round({_SCORE}, 9) AS score, count(*) AS claims FROM per GROUP BY module"""
)
def alignment_of_paths(spark, sf_dir):
    """The flagship: which documented paths exist, as an alignment score for each brand."""
    brand = table(spark, sf_dir, "part").selectExpr(f"'part_' || {_K} || '.md' AS doc_path", "p_brand AS module")
    found = path_findings(spark, sf_dir).join(brand, "doc_path")
    scores = drift.module_scores(found.withColumn("modules", F.array("module")).drop("module"))
    return scores.select("module", F.round("score", 9).alias("score"), "claims")


_CMDS_CTE = (
    _LINES_CTE
    + r""", spans AS (SELECT doc_path, line_no, unnest(CASE WHEN fenced THEN [line] ELSE regexp_extract_all(line, '`([^`]+)`', 1) END) AS span FROM l WHERE NOT mark),
parts AS (SELECT doc_path, line_no, trim(unnest(regexp_split_to_array(span, '&&|[|]{1,2}|;'))) AS part FROM spans),
cmds AS (SELECT doc_path, line_no, trim(regexp_replace(part, '^\$ ', '')) AS cmd FROM parts WHERE trim(regexp_replace(part, '^\$ ', '')) <> ''),
toks AS (SELECT *, list_filter(regexp_split_to_array(cmd, '\s+'), lambda x: x <> '') AS t FROM cmds),
goals AS (SELECT *, list_filter(list_slice(t, 2, 99), lambda x, i: NOT x IN ('--directory','-C','-I','-W','-f','-j','-l','-o') AND NOT x LIKE '-%' AND NOT contains(x, '=')
   AND NOT (i > 1 AND coalesce(t[i] IN ('--directory','-C','-I','-W','-f','-j','-l','-o'), false)))[1] AS goal FROM toks),"""
    + f"""classified AS (SELECT doc_path, line_no, cmd, CASE WHEN t[1] IN ('npm','pnpm','yarn') THEN 'npm' ELSE t[1] END AS kind,
  CASE WHEN t[1] = 'npm' AND t[2] = 'run' THEN t[3] WHEN t[1] IN ('pnpm','yarn') AND t[2] = 'run' THEN t[3]
   WHEN t[1] IN ('pnpm','yarn') AND NOT t[2] LIKE '-%' AND t[2] NOT IN ('{"','".join(text.RUNNER_BUILTINS)}') THEN t[2]
   WHEN t[1] = 'cargo' AND coalesce(t[2], '') NOT IN ('new','init') AND list_contains(t, '--bin') THEN t[list_position(t, '--bin') + 1]
   WHEN t[1] = 'make' THEN goal END AS target FROM goals)"""
)


@query(f"WITH {_CMDS_CTE} SELECT doc_path, line_no, cmd, kind, target FROM classified WHERE target IS NOT NULL")
def command_claims(spark, sf_dir):
    return text.classify_commands(text.commands(doc_lines(spark, sf_dir)))


_ENTRIES_CTE = "entries AS (SELECT DISTINCT 'npm' AS kind, 's' || (s_suppkey % 45) AS name FROM supplier UNION SELECT DISTINCT 'make', 't' || (n_nationkey * 2) FROM nation)"


@query(
    f"""WITH {_CMDS_CTE}, {_ENTRIES_CTE} SELECT doc_path, line_no, cmd, c.kind, target, CASE WHEN e.name IS NULL THEN 'stale' ELSE 'supported' END AS verdict
FROM classified c LEFT JOIN entries e ON c.kind = e.kind AND c.target = e.name WHERE target IS NOT NULL AND c.kind IN (SELECT kind FROM entries)"""
)
def commands_vs_manifest(spark, sf_dir):
    npm = table(spark, sf_dir, "supplier").selectExpr("'npm' AS kind", "'s' || CAST(s_suppkey % 45 AS STRING) AS name")
    make = table(spark, sf_dir, "nation").selectExpr("'make' AS kind", "'t' || CAST(n_nationkey * 2 AS STRING) AS name")
    return checks.check_commands(command_claims(spark, sf_dir), npm.union(make).distinct())


def code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of derived source text: variables, options and names of suppliers and customers."""
    s = table(spark, sf_dir, "supplier").selectExpr("'getenv(SUPP_' || CAST(s_suppkey % 30 AS STRING) || ') or getenv(PART_' || CAST(s_suppkey % 80 AS STRING) || '_MODE) # partBrand size' || CAST(s_suppkey % 33 AS STRING) || ' color' AS text")
    return text.words(s)


_TOKENS_CTE = "tokens AS (SELECT DISTINCT unnest(regexp_extract_all('getenv(SUPP_' || (s_suppkey % 30) || ') or getenv(PART_' || (s_suppkey % 80) || '_MODE) # partBrand size' || (s_suppkey % 33) || ' color', '([_a-zA-Z][_0-9a-zA-Z]+)', 1)) AS term FROM supplier)"


@query(
    f"""WITH {_LINES_CTE}, {_TOKENS_CTE},
dollar AS (SELECT doc_path, line_no, unnest(regexp_extract_all(line, '\\$\\{{?({text.WORD})', 1)) AS name FROM l WHERE NOT mark),
quoted AS (SELECT doc_path, line_no, trim(unnest(regexp_extract_all(line, '`([^`]+)`', 1))) AS name FROM l WHERE NOT fenced),
named AS (SELECT * FROM dollar WHERE regexp_full_match(name, '{text.CAPITALS}') UNION SELECT * FROM quoted WHERE regexp_full_match(name, '[A-Z][0-9A-Z]*(_[0-9A-Z]+)+')),
assigned AS (SELECT DISTINCT doc_path, unnest(regexp_extract_all(line, '(?:\\bexport\\s+|[&;|]|^)\\s*({text.CAPITALS})=', 1)) AS name FROM l)
SELECT n.doc_path, n.line_no, n.name, CASE WHEN t.term IS NULL THEN 'stale' ELSE 'supported' END AS verdict FROM named n LEFT JOIN tokens t ON n.name = t.term
WHERE n.name NOT IN ('{"','".join(_KNOWN.split())}') AND NOT (n.name LIKE 'MY\\_%' ESCAPE '\\' OR n.name LIKE '%YOUR%' OR n.name LIKE '%PLACEHOLDER%') AND NOT EXISTS (SELECT 1 FROM assigned a WHERE a.doc_path = n.doc_path AND a.name = n.name)"""
)
def env_findings(spark, sf_dir):
    return checks.check_env(text.env_variables(doc_lines(spark, sf_dir)), code_tokens(spark, sf_dir))


@query(
    f"""WITH {_CMDS_CTE}, {_TOKENS_CTE}, f AS (SELECT DISTINCT doc_path, line_no, substr(unnest(list_slice(t, 2, 99)), 3) AS flag FROM toks WHERE t[1] = 'partctl'),
used AS (SELECT * FROM f WHERE flag NOT IN ('help','version') AND regexp_full_match(flag, '[a-z][-0-9a-z]+')),
spelled AS (SELECT DISTINCT flag, b, unnest([replace(b, '-', '_'), replace(b, '-', ''),
   list_aggregate(list_transform(string_split(b, '-'), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), 'string_agg', ''),
   coalesce(string_split(b, '-')[1] || list_aggregate(list_transform(list_slice(string_split(b, '-'), 2, 99), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), 'string_agg', ''), b)]) AS term
   FROM (SELECT flag, unnest([flag, regexp_replace(flag, '^no-', '')]) AS b FROM used))
SELECT doc_path, line_no, flag, CASE WHEN flag IN (SELECT flag FROM spelled WHERE term IN (SELECT term FROM tokens)) THEN 'supported' ELSE 'stale' END AS verdict FROM used"""
)
def flag_findings(spark, sf_dir):
    bins = spark.createDataFrame([("partctl",)], "name string")
    return checks.check_flags(text.flags(text.commands(doc_lines(spark, sf_dir)), bins), code_tokens(spark, sf_dir))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "'part' || CAST(s_suppkey % 70 AS STRING) AS name", "'function' AS kind", "'lib/m' || CAST(s_suppkey % 4 AS STRING) AS module"
    ).union(table(spark, sf_dir, "nation").selectExpr("'Kind' || CAST(n_nationkey % 3 AS STRING)", "'enum'", "'lib/kinds'"))


@query(
    f"""WITH {_LINES_CTE}, sym AS (SELECT 'part' || (s_suppkey % 70) AS name, 'function' AS kind, 'lib/m' || (s_suppkey % 4) AS module FROM supplier
 UNION ALL SELECT 'Kind' || (n_nationkey % 3), 'enum', 'lib/kinds' FROM nation),
names AS (SELECT name FROM sym UNION SELECT unnest(string_split(module, '/')) FROM sym),
types AS (SELECT DISTINCT name FROM sym WHERE kind = 'enum'),
refs AS (SELECT DISTINCT doc_path, line_no, unnest(regexp_extract_all(span, '({text.NAME}(?:::{text.NAME})+)', 1)) AS reference
 FROM (SELECT doc_path, line_no, unnest(regexp_extract_all(line, '`([^`]+)`', 1)) AS span FROM l)),
r AS (SELECT *, reference LIKE 'crate::%' AS kw, string_split(regexp_replace(reference, '^((crate|self|super)::)+', ''), '::') AS rest FROM refs)
SELECT doc_path, line_no, reference, CASE WHEN rest[-1] IN (FROM names) OR (len(rest) > 1 AND rest[-2] IN (FROM types)) THEN 'supported' ELSE 'stale' END AS verdict
FROM r WHERE kw OR rest[1] IN (FROM names)"""
)
def reference_findings(spark, sf_dir):
    return checks.check_references(text.qualified_references(doc_lines(spark, sf_dir)), *checks.grounding(symbols(spark, sf_dir)))


_CONST_CTE = (
    _LINES_CTE
    + r""", m AS (SELECT doc_path, line_no, unnest(regexp_extract_all(line, '("""
    + f"(?:`{text.NAME}`|" + r"\b" + text.NAME + ")"
    + r"""\s*(?i:default(?:s?\s+to|s|\sis|\sof|:|)|is\s+(?:set\s+to|(?:by\s+default\s+)?)|=|set\s+to)\s*(?:"[^"]+"|`[^`]+`|"""
    + text.NUMBER
    + r"""|true|false))', 1)) AS phrase FROM l WHERE NOT fenced),
c AS (SELECT doc_path, line_no, trim(phrase) AS phrase, regexp_extract(phrase, '^`([A-Za-z0-9_]+)`', 1) AS b, regexp_extract(phrase, '^([A-Za-z0-9_]+)', 1) AS p, regexp_extract(phrase, '`?([0-9]+)`?$', 1) AS v FROM m),
const AS (SELECT doc_path, line_no, CASE WHEN b <> '' THEN b ELSE p END AS symbol, 'int' AS vtype, (v::BIGINT)::VARCHAR AS vkey, phrase FROM c
 WHERE v <> '' AND (b <> '' OR contains(p, '_') OR regexp_matches(p, '[a-z].*[A-Z]')))"""
)


@query(f"WITH {_CONST_CTE} SELECT * FROM const")
def constant_claims(spark, sf_dir):
    return text.constant_claims(doc_lines(spark, sf_dir))


@query(
    f"""WITH {_CONST_CTE}, lit AS (SELECT DISTINCT CASE WHEN l_orderkey % 3 = 0 THEN 'default_size_' ELSE 'SIZE_' END || l_orderkey AS name, (l_quantity::BIGINT)::VARCHAR AS vkey FROM lineitem),
keyed AS (SELECT lower(name) AS k, vkey FROM lit UNION SELECT regexp_replace(lower(name), '^default_', ''), vkey FROM lit),
seen AS (SELECT k, list(DISTINCT vkey) AS vs FROM keyed GROUP BY k)
SELECT doc_path, line_no, symbol, vkey, CASE WHEN list_contains(vs, vkey) THEN 'supported' ELSE 'contradicted' END AS verdict
FROM const JOIN seen ON lower(symbol) = k WHERE list_contains(vs, vkey) OR len(vs) = 1"""
)
def constant_findings(spark, sf_dir):
    lit = table(spark, sf_dir, "lineitem")
    name = "CASE WHEN l_orderkey % 3 = 0 THEN 'default_size_' ELSE 'SIZE_' END || CAST(l_orderkey AS STRING) AS name"
    return checks.check_constants(text.constant_claims(doc_lines(spark, sf_dir)), lit.selectExpr(name, "'int' AS vtype", "CAST(CAST(l_quantity AS BIGINT) AS STRING) AS vkey").distinct())


_RULES_CTE = (
    _LINES_CTE
    + r""", q AS (SELECT doc_path, line_no, regexp_replace(line, '"[^"]*"', '', 'g') AS line FROM l WHERE NOT fenced),
rules AS (
 SELECT doc_path, line_no, 'forbid_edge' AS kind, regexp_extract(line, '`([^`]+)` module must not depend on `([^`]+)`', 1) AS a, regexp_extract(line, '`([^`]+)` module must not depend on `([^`]+)`', 2) AS b, '' AS items FROM q WHERE line LIKE '%must not depend on%'
 UNION ALL SELECT doc_path, line_no, 'forbid_edge', regexp_extract(line, '`([^`]+)` should never use', 1), regexp_extract(line, 'never use the `([^`]+)`', 1), '' FROM q WHERE line LIKE '%should never use%'
 UNION ALL SELECT doc_path, line_no, 'layer', regexp_extract(line, '`([^`]+)` only', 1), NULL, array_to_string(list_slice(regexp_extract_all(line, '`([^`]+)`', 1), 2, 9), ',') FROM q WHERE line LIKE '%only depends on%'
 UNION ALL SELECT doc_path, line_no, 'forbid_reach', regexp_extract(line, '`([^`]+)` must not trans', 1), regexp_extract(line, 'reach `([^`]+)`', 1), '' FROM q WHERE line LIKE '%transitively reach%'
 UNION ALL SELECT doc_path, line_no, 'forbid_symbol', regexp_extract(line, 'call `([^`]+)`', 1), NULL, regexp_extract(line, 'outside `([^`]+)`', 1) FROM q WHERE line LIKE '%don''t call%'
 UNION ALL SELECT doc_path, line_no, 'forbid_edge', regexp_extract(line, 'imported by `([^`]+)`', 1), regexp_extract(line, '`([^`]+)` must not be', 1), '' FROM q WHERE line LIKE '%imported by%'
 UNION ALL SELECT doc_path, line_no, 'forbid_edge', regexp_extract(line, '`([^`]+)` package', 1), regexp_extract(line, 'of the `([^`]+)`', 1), '' FROM q WHERE line LIKE '%independent of%'
 UNION ALL SELECT doc_path, line_no, 'forbid_edge', regexp_extract(line, 'of the `([^`]+)`', 1), regexp_extract(line, '`([^`]+)` package', 1), '' FROM q WHERE line LIKE '%independent of%'
 UNION ALL SELECT doc_path, line_no, 'layer', regexp_extract(line, '`([^`]+)` layer', 1), NULL, '' FROM q WHERE line LIKE '%has no dependencies%'
 UNION ALL SELECT doc_path, line_no, 'forbid_symbol', regexp_extract(line, 'use of `([^`]+)`', 1), NULL, regexp_extract(line, 'except in `([^`]+)`', 1) FROM q WHERE line LIKE '%No raw use%')"""
)


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct rules, written, so that the steps which read them don't take the texts apart again."""
    return cut(rules.extract_rules(doc_lines(spark, sf_dir)).select("kind", "a", "b", "items").distinct())


@query(f"WITH {_RULES_CTE} SELECT * FROM rules")
def rules_extracted(spark, sf_dir):
    return rules.extract_rules(doc_lines(spark, sf_dir)).withColumn("items", F.array_join("items", ","))


def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports between 500 modules in 25 folders: each part's module takes those that its order lines' numbers lead to."""
    k = "l_partkey % 500 AS k", "(l_partkey % 500 * 7 + l_linenumber) % 500 AS to"
    both = table(spark, sf_dir, "lineitem").selectExpr(*k).distinct().where("k <> to")
    name = "'lib/n' || CAST({0} % 25 AS STRING) || '/m' || CAST({0} AS STRING) AS {1}"
    return both.selectExpr(name.format("k", "src"), name.format("to", "dst"))


_EDGES_CTE = """edges AS (SELECT DISTINCT 'lib/n' || (k % 25) || '/m' || k AS src, 'lib/n' || (t % 25) || '/m' || t AS dst FROM (SELECT l_partkey % 500 AS k, (l_partkey % 500 * 7 + l_linenumber) % 500 AS t FROM lineitem) WHERE k <> t),
mods AS (SELECT src AS module FROM edges UNION SELECT dst FROM edges),
segs AS (SELECT module, string_split(module, '/') AS p FROM mods),
names AS (SELECT DISTINCT module, array_to_string(list_slice(p, i, j), '/') AS said FROM segs, range(1, 4) AS x(i), range(1, 4) AS y(j) WHERE i <= j AND j <= len(p))"""
_EDGE_BREACHES = "SELECT DISTINCT a, b, src, dst FROM rules JOIN names m1 ON m1.said = a JOIN names m2 ON m2.said = b JOIN edges ON src = m1.module AND dst = m2.module WHERE kind = 'forbid_edge'"


@query(f"WITH {_RULES_CTE}, {_EDGES_CTE} {_EDGE_BREACHES}")
def forbid_edge(spark, sf_dir):
    return rules.forbidden_edges(extracted(spark, sf_dir), module_edges(spark, sf_dir))


_LAYER_CTE = """lay AS (SELECT DISTINCT a, items FROM rules WHERE kind = 'layer'),
inside AS (SELECT a, items, module FROM lay JOIN names ON said = a),
ok AS (SELECT * FROM inside UNION SELECT a, items, module FROM (SELECT a, items, unnest(string_split(items, ',')) AS item FROM lay) JOIN names ON said = item),
breaches AS (SELECT DISTINCT a, items, src, dst FROM inside JOIN edges ON src = module WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.a = inside.a AND ok.items = inside.items AND ok.module = dst))"""


@query(f"WITH {_RULES_CTE}, {_EDGES_CTE}, {_LAYER_CTE} SELECT a, items, src, dst FROM breaches")
def layer_rule(spark, sf_dir):
    return rules.layer_breaches(extracted(spark, sf_dir), module_edges(spark, sf_dir)).withColumn("items", F.array_join("items", ","))


_REACH_CTE = """pairs AS (SELECT DISTINCT a, b FROM rules WHERE kind = 'forbid_reach'),
of_a AS (SELECT DISTINCT a, b, module FROM pairs JOIN names ON said = a),
of_b AS (SELECT DISTINCT a, b, module FROM pairs JOIN names ON said = b),
starts AS (SELECT * FROM of_a EXCEPT SELECT * FROM of_b), targets AS (SELECT * FROM of_b EXCEPT SELECT * FROM of_a),
walk(src, node, depth) AS (SELECT DISTINCT module, module, 0 FROM starts UNION SELECT w.src, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 12),
near AS (SELECT src, node, min(depth) AS depth FROM walk GROUP BY src, node),
hits AS (SELECT s.a, s.b, s.module AS src, t.module AS hit, n.depth, row_number() OVER (PARTITION BY s.a, s.b, s.module ORDER BY n.depth, t.module) AS k
 FROM starts s JOIN targets t ON s.a = t.a AND s.b = t.b JOIN near n ON n.src = s.module AND n.node = t.module WHERE n.depth > 0)"""
# The least of the shortest paths, back from the hit: before each node the predecessor on the least path.
_CHAIN_CTE = """steps AS (SELECT n.src, n.node, n.depth, p.node AS before FROM near n JOIN edges e ON e.dst = n.node JOIN near p ON p.src = n.src AND p.node = e.src AND p.depth = n.depth - 1 WHERE n.depth > 0),
paths(src, node, depth, chain) AS (SELECT src, node, 0, [node] FROM near WHERE depth = 0
 UNION ALL SELECT s.src, s.node, s.depth, list_append(p.chain, s.node) FROM paths p JOIN steps s ON s.src = p.src AND s.before = p.node AND s.depth = p.depth + 1
  WHERE s.depth <= (SELECT max(depth) FROM hits WHERE k = 1))"""


@query(
    f"""WITH RECURSIVE {_RULES_CTE}, {_EDGES_CTE}, {_REACH_CTE}, {_CHAIN_CTE} SELECT a, b, h.src, hit, h.depth, array_to_string(min(p.chain), ' ') AS chain
FROM hits h JOIN paths p ON p.src = h.src AND p.node = h.hit WHERE k = 1 GROUP BY ALL"""
)
def forbid_reach(spark, sf_dir):
    return rules.forbidden_reach(extracted(spark, sf_dir), module_edges(spark, sf_dir)).withColumn("chain", F.array_join("chain", " "))


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = "CASE WHEN s_suppkey % 3 = 0 THEN 'y = os.environ' || CAST(s_suppkey % 11 AS STRING) ELSE 'x = eval' || CAST(s_suppkey % 18 AS STRING) || '(y) + evaluate' || CAST(s_nationkey AS STRING) END AS line"
    return table(spark, sf_dir, "supplier").selectExpr("'lib/n' || CAST(s_nationkey AS STRING) || '/m' || CAST(s_nationkey AS STRING) AS module", "s_suppkey AS line_no", call)


_CODE_CTE = r"""code AS (SELECT 'lib/n' || s_nationkey || '/m' || s_nationkey AS module, s_suppkey AS line_no, CASE WHEN s_suppkey % 3 = 0 THEN 'y = os.environ' || (s_suppkey % 11) ELSE 'x = eval' || (s_suppkey % 18) || '(y) + evaluate' || s_nationkey END AS line FROM supplier),
ban AS (SELECT DISTINCT a AS symbol, items FROM rules WHERE kind = 'forbid_symbol'),
excepted AS (SELECT symbol, items, module FROM ban CROSS JOIN (SELECT DISTINCT module FROM code) WHERE items <> '' AND (module = items OR module LIKE items || '/%' OR module LIKE '%/' || items OR module LIKE '%/' || items || '/%')),
direct AS (SELECT DISTINCT symbol, items, module, line_no FROM ban JOIN code ON CASE WHEN regexp_full_match(symbol, '\w+') THEN regexp_matches(line, '\b' || symbol || '\b') ELSE contains(line, symbol) END
 WHERE NOT EXISTS (SELECT 1 FROM excepted e WHERE e.symbol = ban.symbol AND e.items = ban.items AND e.module = code.module))"""


@query(f"WITH {_RULES_CTE}, {_CODE_CTE} SELECT * FROM direct")
def forbid_symbol(spark, sf_dir):
    return rules.forbidden_symbols(extracted(spark, sf_dir), code_lines(spark, sf_dir)).withColumn("items", F.array_join("items", ","))


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of the forbidden names, some of them twice."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS idx", "CASE WHEN p_partkey <= 12 THEN 'eval' || CAST(p_partkey AS STRING) WHEN p_partkey < 16 THEN 'eval3' ELSE 'f' || CAST(p_partkey AS STRING) END AS name")
    module = "'lib/n' || CAST(idx % 25 AS STRING) || '/m' || CAST(idx % 500 AS STRING)"
    return p.selectExpr("name", f"{module} AS module", f"{module} || '::' || name AS qualified_name", f"{module} || '.py' AS path", "idx")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference for each order line, from its part's function to one of the first twenty definitions."""
    sym = definitions(spark, sf_dir).select("idx", "qualified_name")
    li = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS a", "l_linenumber + l_orderkey % 14 AS b").distinct()
    return li.join(sym.toDF("a", "from_symbol"), "a").join(sym.toDF("b", "to_symbol"), "b").where("a <> b").select("from_symbol", "to_symbol")


_CALLS_CTE = """defs AS (SELECT p_partkey AS idx, CASE WHEN p_partkey <= 12 THEN 'eval' || p_partkey WHEN p_partkey < 16 THEN 'eval3' ELSE 'f' || p_partkey END AS name, 'lib/n' || (p_partkey % 25) || '/m' || (p_partkey % 500) AS module FROM part),
refs AS (SELECT DISTINCT x.module AS module, x.module || '::' || x.name AS caller, y.name AS target FROM lineitem JOIN defs x ON x.idx = l_partkey JOIN defs y ON y.idx = l_linenumber + l_orderkey % 14 WHERE x.idx <> y.idx),
single AS (SELECT name FROM defs GROUP BY name HAVING count(*) = 1),
indirect AS (SELECT DISTINCT symbol, items, module, caller FROM refs JOIN single ON target = name JOIN ban ON symbol = name
 WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.symbol = ban.symbol AND d.items = ban.items AND d.module = refs.module)
 AND NOT (module = items OR module LIKE items || '/%' OR module LIKE '%/' || items OR module LIKE '%/' || items || '/%'))"""


@query(f"WITH {_RULES_CTE}, {_CODE_CTE}, {_CALLS_CTE} SELECT * FROM indirect")
def forbid_symbol_indirect(spark, sf_dir):
    told = extracted(spark, sf_dir)
    direct = rules.forbidden_symbols(told, code_lines(spark, sf_dir))
    return rules.indirect_symbols(told, direct, definitions(spark, sf_dir), calls(spark, sf_dir)).withColumn("items", F.array_join("items", ","))


@query(
    f"""WITH RECURSIVE {_RULES_CTE}, {_EDGES_CTE}, {_REACH_CTE}, {_LAYER_CTE}, {_CODE_CTE}, {_CALLS_CTE},
base AS (SELECT DISTINCT kind, a, b, items FROM rules),
bad AS (SELECT 'forbid_edge' AS kind, a, b, '' AS items FROM ({_EDGE_BREACHES})
 UNION ALL SELECT 'forbid_reach', a, b, '' FROM hits WHERE k = 1 UNION ALL SELECT 'layer', a, NULL, items FROM breaches
 UNION ALL SELECT 'forbid_symbol', symbol, NULL, items FROM direct UNION ALL SELECT 'forbid_symbol', symbol, NULL, items FROM indirect),
n AS (SELECT kind, a, coalesce(b, '') AS b, items, count(*) AS n FROM bad GROUP BY ALL),
told AS (SELECT base.*, n.n, CASE WHEN base.kind = 'forbid_symbol' THEN NULL WHEN base.a NOT IN (SELECT said FROM names) THEN base.a WHEN base.kind <> 'layer' AND base.b NOT IN (SELECT said FROM names) THEN base.b END AS operand
  FROM base LEFT JOIN n ON n.kind = base.kind AND n.a = base.a AND n.b = coalesce(base.b, '') AND n.items = base.items),
said AS (SELECT *, '`' || replace(items, ',', '`, `') || '`' AS listed FROM told)
SELECT kind, a, b, items, CASE kind WHEN 'forbid_edge' THEN '`' || a || '` ✗→ `' || b || '`' WHEN 'forbid_reach' THEN '`' || a || '` ✗⇢ `' || b || '` (transitive)'
  WHEN 'layer' THEN '`' || a || '` ' || CASE WHEN items = '' THEN 'depends on nothing' ELSE '→ only ' || listed END
  ELSE 'forbid symbol `' || a || '`' || CASE WHEN items = '' THEN '' ELSE ' (except ' || listed || ')' END END AS rule,
 CASE WHEN operand IS NOT NULL THEN 'Ungrounded' WHEN n > 0 THEN 'Violated' ELSE 'Holds' END AS status, CASE WHEN operand IS NULL THEN n END AS n, operand FROM said"""
)
def rules_audit(spark, sf_dir):
    args = (f(spark, sf_dir) for f in (module_edges, code_lines, definitions, calls))
    return rules.audit(extracted(spark, sf_dir), *args).withColumn("items", F.array_join("items", ","))
