"""Lines, fences and claims of Markdown documents as DataFrame transformations.

A document is a row (doc_path, text); its lines are rows (doc_path, line_no, line,
fenced, historical). What a line takes from those before it is found in one Arrow pass
over whole documents, before they are split into rows, so nothing is shuffled or sorted
and a long document is no hot partition; all else is built-in column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TICK = "`([^`]+)`"
NAME = "[_a-zA-Z][_0-9a-zA-Z]*"
CAPITALS = "[A-Z][_0-9A-Z]*"

PATH_EXTENSIONS = tuple(
    """adoc bash bat c cc cfg cjs clj cmd conf cpp cs css csv cxx dart dot env erl ex exs fish fs gemspec go gql gradle
    graphql gv h hcl hpp hs htm html ini ipynb java jl js json json5 jsonc jsx kt less lock lua markdown md mjs mk ml nim php
    pl pm podspec properties proto ps1 py pyi pyx r rake rb rs rst sass scala scss sh sql svelte swift tf toml ts tsv tsx txt vue
    xml yaml yml zig zsh""".split()
)
BARE_FILENAMES = tuple("brewfile changelog dockerfile gemfile gnumakefile justfile license makefile procfile rakefile readme vagrantfile".split())
ROOT_MANIFESTS = tuple(
    """angular.json cargo.lock cargo.toml composer.json composer.lock deno.json deno.jsonc go.mod go.sum jsconfig.json nx.json
    package-lock.json package.json pyproject.toml tsconfig.json""".split()
)
_RUN = r"[-./\w]+"
PATH_TOKEN = f"`({_RUN}/{_RUN}|" + r"[-\w]+[.]\w{1,5})`"
PAST_CUE = (
    r"(?i)\b(as-built|deleted?|deletes|deprecated|former(ly)?|legacy|moved|no longer|old path|original plan|previously"
    r"|removal|removed?|removes|renamed?|replaced?|used to)\b"
)
#: Lines before a claim that may put it into the past.
LOOK_BACK = 4

RUNNER_BUILTINS = tuple(
    """add audit build cache ci config create dedupe dev dlx exec fund get global help i import info init install link list
    login logout ls node outdated pack patch prune publish rebuild remove restart rm set start stop store test unlink up
    update upgrade version view whoami why x""".split()
)
MAKE_VALUE_FLAGS = ("--directory", "-C", "-I", "-W", "-f", "-j", "-l", "-o")
SYSTEM_VARIABLES = tuple(
    """DISPLAY EDITOR EUID FTP_PROXY GID HOME HOSTNAME HTTPS_PROXY HTTP_PROXY LANG LC_ALL LC_CTYPE LOGNAME NO_PROXY OLDPWD
    PAGER PATH PWD SHELL SHLVL TEMP TERM TMP TMPDIR UID USER VISUAL""".split()
)
PLACEHOLDERS = ("BAR", "BAZ", "CHANGEME", "FOO", "PLACEHOLDER")
WORD = "[_a-zA-Z][_0-9a-zA-Z]+"


def is_fence(line: Column) -> Column:
    return F.ltrim(line).startswith("```") | F.ltrim(line).startswith("~~~")


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lines of all texts, one after the other, and where those of each begin and the last end.

    Split at line feeds, without a trailing carriage return or an empty last line.
    """
    lists = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    edges = np.asarray(lists.offsets, np.int64)
    flat = lists.flatten()
    edges = edges - edges[0]
    size = np.diff(edges)
    last = edges[1:] - 1
    drop = last[size > 0][pc.equal(flat.take(pa.array(last[size > 0])), "").to_numpy(zero_copy_only=False)]
    keep = np.ones(len(flat), bool)
    keep[drop] = False
    flat = pc.replace_substring_regex(flat.filter(pa.array(keep)), "\r$", "")
    return flat, np.concatenate([[0], np.cumsum(keep)])[edges]


def running(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many flags are set in the same text up to each line, this one included."""
    sums = np.cumsum(flags)
    return sums - np.repeat(np.concatenate([[0], sums])[edges[:-1]], np.diff(edges))


def marks(flat: pa.Array, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines open or close a fence, and which are such lines or lie inside a fence."""
    bare = pc.utf8_ltrim_whitespace(flat)
    fence = pc.or_(pc.starts_with(bare, "```"), pc.starts_with(bare, "~~~")).to_numpy(zero_copy_only=False)
    return fence, fence | (running(fence, edges) % 2 == 1)


LINES = "doc_path string, line_no int, line string, fenced boolean, historical boolean"


def doc_lines(docs: DataFrame) -> DataFrame:
    """The lines (LINES) of documents (doc_path, text); a null text has none.

    ``fenced``: the line opens or closes a fence, or lies behind an odd number of such
    lines. ``historical``: this line or one of the LOOK_BACK before it puts things into
    the past.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat, edges = split_lines(part.column(1))
                n = np.diff(edges)
                number = np.arange(len(flat)) - np.repeat(edges[:-1], n)
                _, inside = marks(flat, edges)
                cue = pc.match_substring_regex(pc.replace_substring_regex(flat, "`[^`]*`", " "), PAST_CUE).to_numpy(zero_copy_only=False)
                seen = np.concatenate([[0], np.cumsum(cue)])
                here = np.arange(1, len(flat) + 1)
                past = seen[here] > seen[here - 1 - np.minimum(number, LOOK_BACK)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), n))), pa.array(number + 1, pa.int32()), flat.cast(pa.string()), pa.array(inside), pa.array(past)],
                    ["doc_path", "line_no", "line", "fenced", "historical"],
                )

    return docs.where("text IS NOT NULL").select("doc_path", "text").mapInArrow(run, LINES)


def find(doc_lines: DataFrame, pattern: str, column: str, group: int = 1) -> DataFrame:
    """A row for each match of ``pattern`` in a line."""
    return doc_lines.withColumn(column, F.explode(F.regexp_extract_all("line", F.lit(pattern), group)))


def looks_like_path(token: Column) -> Column:
    last = F.lower(F.element_at(F.split(token, "/"), -1))
    known = last.contains(".") & F.element_at(F.split(last, r"\."), -1).isin(*PATH_EXTENSIONS)
    return F.when(known, token.contains("/") | last.isin(*ROOT_MANIFESTS)).otherwise(last.isin(*BARE_FILENAMES))


def path_claims(doc_lines: DataFrame) -> DataFrame:
    """(doc_path, line_no, raw, historical, table_row) of the back-quoted paths outside fences; takes marked lines."""
    raw = F.col("raw")
    outside = ~(raw.contains("://") | raw.startswith("*") | raw.endswith("/*") | raw.startswith("/") | raw.startswith("../"))
    found = find(doc_lines.where("NOT fenced"), PATH_TOKEN, "raw").where(outside & looks_like_path(raw))
    return found.select("doc_path", "line_no", "raw", "historical", F.col("line").contains("|").alias("table_row"))


def commands(doc_lines: DataFrame) -> DataFrame:
    """(doc_path, line_no, cmd): fenced lines and inline spans, cut at &&, ||, ; and |; takes fenced lines."""
    spans = F.when(F.col("fenced"), F.array("line")).otherwise(F.regexp_extract_all("line", F.lit(TICK), 1))
    parts = doc_lines.where(~is_fence(F.col("line"))).withColumn("span", F.explode(spans)).withColumn("part", F.explode(F.split("span", r"&&|[|]{1,2}|;")))
    cmd = F.trim(F.regexp_replace(F.trim("part"), r"^\$ ", ""))
    return parts.select("doc_path", "line_no", cmd.alias("cmd")).where("cmd <> ''")


def _after(tokens: Column, n: int) -> Column:
    return F.slice(tokens, n + 1, F.greatest(F.size(tokens), F.lit(1)))


def make_goal(arguments: Column) -> Column:
    """The first argument that is no flag, no flag's value and no assignment."""
    start = F.struct(F.lit(False).alias("skip"), F.lit(None).cast("string").alias("goal"))

    def step(acc: Column, x: Column) -> Column:
        plain = ~x.startswith("-") & ~x.contains("=")
        return F.struct(
            (~acc["skip"] & acc["goal"].isNull() & x.isin(*MAKE_VALUE_FLAGS)).alias("skip"),
            F.coalesce(acc["goal"], F.when(~acc["skip"] & ~x.isin(*MAKE_VALUE_FLAGS) & plain, x)).alias("goal"),
        )

    return F.aggregate(arguments, start, step)["goal"]


def classify_commands(cmds: DataFrame) -> DataFrame:
    """Adds ``kind`` (npm, make, cargo) and ``target`` to the commands that need one declared in a manifest."""
    toks = F.filter(F.split("cmd", r"\s+"), lambda t: t != "")
    head, second, third = (F.try_element_at(toks, F.lit(i)) for i in (1, 2, 3))
    runner = F.when(second == "run", third).when(~second.startswith("-") & ~second.isin(*RUNNER_BUILTINS), second)
    at = F.array_position(toks, "--bin").cast("int")
    inline = F.try_element_at(F.filter(toks, lambda t: t.startswith("--bin=")), F.lit(1))
    binary = F.coalesce(F.when(at > 0, F.try_element_at(toks, at + 1)), F.regexp_replace(inline, "^--bin=", ""))
    kind = F.when(head.isin("npm", "pnpm", "yarn"), "npm").when(head == "make", "make").when(head == "cargo", "cargo")
    target = (
        F.when((head == "npm") & (second == "run"), third)
        .when(head.isin("pnpm", "yarn"), runner)
        .when((head == "cargo") & ~F.coalesce(second.isin("new", "init"), F.lit(False)), binary)
        .when(head == "make", make_goal(_after(toks, 1)))
    )
    return cmds.withColumn("kind", kind).withColumn("target", target).where("target IS NOT NULL")


def env_variables(doc_lines: DataFrame) -> DataFrame:
    """(doc_path, line_no, name) of the environment variables that documents name and don't set themselves; takes fenced lines.

    What a line names and what it sets is found in one pass over the lines.
    """
    line, name = F.col("line"), F.col("name")
    dollar = F.filter(F.regexp_extract_all(line, F.lit(r"\$\{?(" + WORD + ")"), 1), lambda n: n.rlike(f"^{CAPITALS}$"))
    quoted = F.filter(F.transform(F.regexp_extract_all(line, F.lit(TICK), 1), F.trim), lambda n: n.rlike("^[A-Z][0-9A-Z]*(?:_[0-9A-Z]+)+$"))
    none = F.array().cast("array<string>")
    named = F.concat(
        F.when(line.contains("$") & ~is_fence(line), dollar).otherwise(none),
        F.when(line.contains("`") & ~F.col("fenced") & ~is_fence(line), quoted).otherwise(none),
    )
    assigned = F.when(line.contains("="), F.regexp_extract_all(line, F.lit(r"(?:\bexport\s+|[&;|]|^)\s*(" + CAPITALS + ")="), 1)).otherwise(none)
    both = F.concat(F.transform(named, lambda n: F.struct(n.alias("name"), F.lit(False).alias("own"))), F.transform(assigned, lambda n: F.struct(n.alias("name"), F.lit(True).alias("own"))))
    some = doc_lines.where(line.contains("$") | line.contains("`") | line.contains("=")).select("doc_path", "line_no", F.explode(both).alias("n")).select("doc_path", "line_no", "n.name", "n.own")
    some = some.where(~(name.isin(*SYSTEM_VARIABLES, *PLACEHOLDERS) | name.startswith("MY_") | name.contains("YOUR") | name.contains("PLACEHOLDER")))
    by = some.groupBy("doc_path", "name").agg(F.max("own").alias("own"), F.collect_set("line_no").alias("lines"))
    return by.where("NOT own").select("doc_path", F.explode("lines").alias("line_no"), "name")


def flag_spellings(flag: Column) -> Column:
    """How a flag may be spelled in code, also without a leading ``no-``."""

    def forms(base: Column) -> Column:
        parts = F.filter(F.split(base, "-"), lambda p: p != "")
        caps = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20)))
        camel = F.concat(F.element_at(parts, 1), F.array_join(F.slice(caps, 2, F.greatest(F.size(caps), F.lit(1))), ""))
        return F.array(F.array_join(parts, "_"), F.array_join(parts, ""), F.array_join(caps, ""), camel)

    bare = F.regexp_replace(flag, "^(no-)+", "")
    # Each "no-" may be left off; what remains of a run of them is spelled like the rest.
    return F.array_distinct(F.concat(forms(flag), forms(F.regexp_replace(flag, "^no-", "")), F.when(bare != "", forms(bare)).otherwise(F.array().cast("array<string>"))))


def flags(cmds: DataFrame, binaries: DataFrame) -> DataFrame:
    """(doc_path, line_no, bin, flag) of long flags in commands that start with one of ``binaries`` (name)."""
    # Flags are found before the join, as few commands have one.
    toks = cmds.where(F.col("cmd").contains("--")).select("doc_path", "line_no", F.split(F.trim("cmd"), r"\s+").alias("toks"))
    found = toks.select("doc_path", "line_no", F.element_at("toks", 1).alias("bin"), F.explode(_after(F.col("toks"), 1)).alias("tok")).where(F.col("tok").startswith("--"))
    found = found.withColumn("flag", F.regexp_extract("tok", "^--([a-z][-0-9a-z]+)$", 1)).where("flag <> '' AND flag NOT IN ('help', 'version')")
    own = found.join(binaries.select(F.col("name").alias("bin")).distinct(), "bin", "left_semi")
    return own.select("doc_path", "line_no", "bin", "flag").dropDuplicates(["doc_path", "line_no", "flag"])


def qualified_references(doc_lines: DataFrame) -> DataFrame:
    """(doc_path, line_no, reference) of ``a::b`` paths in inline code, fenced or not."""
    spans = find(doc_lines, TICK, "span")
    found = spans.withColumn("reference", F.explode(F.regexp_extract_all("span", F.lit(f"({NAME}(?:::{NAME})+)"), 1)))
    return found.select("doc_path", "line_no", "reference").distinct()


_CUE = r"(?i:default(?:s?\s+to|s|\sis|\sof|:|)|is\s+(?:set\s+to|(?:by\s+default\s+)?)|=|set\s+to)"
NUMBER = "-?[0-9][_0-9]*(?:[.][0-9]+)?"
#: What every such claim has in it; it begins with the cue, and so is looked for faster.
_CUED_VALUE = _CUE + r"\s*" + r'(?:[`"]|-?[0-9]|true|false)'
CONSTANT_CLAIM = (
    f"(?:`({NAME})`|" + r"\b" + f"({NAME}))" + r"\s*" + _CUE + r"\s*"
    f'(?:{TICK}|"([^"]+)"|({NUMBER}|true|false))'
)


def code_shaped(name: Column) -> Column:
    """A bare name that can only be code: with an underscore, all capitals, or camel case."""
    return name.contains("_") | (name.rlike("[A-Z][^A-Za-z]*[A-Z]") & ~name.rlike("[a-z]")) | name.rlike("[a-z].*[A-Z]")


def canonical_int(raw: Column) -> Column:
    """Decimal text of an integer literal without separators, suffix or leading zeros; null if it doesn't begin with digits."""
    digits = F.regexp_replace(F.regexp_extract(raw, r"^-*([0-9_]+)", 1), "_", "")
    number = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return F.when(digits != "", F.concat(F.when(raw.startswith("-"), "-").otherwise(""), number))


def value_of(raw: Column, delimited: Column) -> Column:
    """Struct (vtype, vkey) of a claimed value; null if it is none that can be compared."""
    low = F.lower(raw)
    number = F.when(~raw.contains("."), canonical_int(raw))
    plain = delimited & (F.trim(raw) != "") & ~raw.rlike(r"[\\{}$]")
    kind = F.when(low.isin("true", "false"), "bool").when(number.isNotNull(), "int").when(plain, "str")
    key = F.when(low.isin("true", "false"), low).when(number.isNotNull(), number).when(plain, F.concat(F.lit('"'), raw, F.lit('"')))
    return F.when(kind.isNotNull(), F.struct(kind.alias("vtype"), key.alias("vkey")))


def constant_claims(doc_lines: DataFrame) -> DataFrame:
    """(doc_path, line_no, symbol, vtype, vkey, phrase) of claims that a name has a value; takes fenced lines."""
    # Matches are found in one pass over the line; their groups are taken from the matches.
    whole = F.regexp_extract_all("line", F.lit(CONSTANT_CLAIM), F.lit(0))
    found = doc_lines.where(~F.col("fenced") & F.col("line").rlike(_CUED_VALUE)).withColumn("g0", F.explode(whole))
    g = {i: F.regexp_extract("g0", CONSTANT_CLAIM, i) for i in range(1, 6)} | {0: F.col("g0")}
    symbol = F.when(g[1] != "", g[1]).when((g[2] != "") & code_shaped(g[2]), g[2])
    delimited = (g[3] != "") | (g[4] != "")
    raw = F.when(g[3] != "", g[3]).when(g[4] != "", g[4]).otherwise(g[5])
    out = found.select("doc_path", "line_no", symbol.alias("symbol"), value_of(raw, delimited).alias("v"), F.trim(g[0]).alias("phrase"))
    return out.where("symbol IS NOT NULL AND v IS NOT NULL").select("doc_path", "line_no", "symbol", "v.vtype", "v.vkey", "phrase")


def words(docs: DataFrame) -> DataFrame:
    """Distinct identifiers (term) of all texts."""
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)).alias("term")).distinct()


_ITEM = r"^([-*>]|[0-9]+[.)])"


def logical_lines(docs: DataFrame) -> DataFrame:
    """(doc_path, start_line, text) of documents (doc_path, text): list items and paragraphs with their soft wraps folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat, edges = split_lines(part.column(1))
                n = np.diff(edges)
                first = np.zeros(len(flat) + 1, bool)
                first[edges[:-1][n > 0]] = True
                bare = pc.utf8_trim_whitespace(flat)
                stop = marks(flat, edges)[1]
                for found in (pc.equal(bare, ""), pc.starts_with(bare, "#"), pc.starts_with(bare, "|")):
                    stop = stop | found.to_numpy(zero_copy_only=False)
                item = pc.match_substring_regex(bare, _ITEM).to_numpy(zero_copy_only=False)
                begins = ~stop & (item | first[:-1] | np.concatenate([[True], stop[:-1]]))
                # Lines that don't stop belong to the block that began last.
                live = np.flatnonzero(~stop)
                start = np.flatnonzero(begins)
                size = np.diff(np.append(np.searchsorted(live, start), len(live)))
                said = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), bare.take(pa.array(live)).cast(pa.string()))
                doc = np.searchsorted(edges, start, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), pa.array(start - edges[doc] + 1, pa.int32()), pc.binary_join(said, " ")], ["doc_path", "start_line", "text"]
                )

    return docs.where("text IS NOT NULL").select("doc_path", "text").mapInArrow(run, "doc_path string, start_line int, text string")


DANGLING = tuple("a an and as at but by for from if in into of on or than that the then to via when where which while with".split())


def claim_flags(claims: DataFrame) -> DataFrame:
    """Adds ``claim`` (the text without list markers), what makes it unfit as a claim, and ``candidate`` for those with no such mark."""
    text = F.regexp_replace(F.trim("text"), r"^[-*>\s]+", "")
    claim = F.col("claim")
    last = F.lower(F.regexp_replace(F.element_at(F.split(F.trim(claim), r"\s+"), -1), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    out = claims.withColumn("claim", text).withColumn("n_words", F.size(F.filter(F.split(F.trim("claim"), r"\s+"), lambda w: w != "")))
    # Every second part between double quotes is quoted; the last part has no closing quote.
    parts = F.split(claim, '"', -1)
    quoted = F.exists(F.transform(parts, lambda p, i: (i % 2 == 1) & (i < F.size(parts) - 1) & p.contains("`")), lambda x: x)
    return (
        out.withColumn("has_code", claim.contains("`"))
        .withColumn("fragment", F.trim(claim).rlike(r"[,;:]\z") | last.isin(*DANGLING))
        .withColumn("quoted_example", quoted)
        .withColumn("feature_entry", claim.rlike(r"\*\* ?[—–]"))
        .withColumn("lower_start", claim.rlike(r"^[*_ ]*[a-z]"))
        .withColumn("candidate", F.expr("n_words >= 6 AND has_code AND NOT (fragment OR quoted_example OR feature_entry OR lower_start)"))
    )
