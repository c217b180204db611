"""Checks of single claims: paths, commands, environment variables, flags, references and constants.

Each takes claims and what the code holds, and returns the claims with a verdict:
supported, contradicted, stale, undocumented or unverifiable. Doubt gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import canonical_int, flag_spellings
from plumbline.operators.lineage import cut
from plumbline.operators.match import existing


def verdict(supported) -> F.Column:
    return F.when(supported, "supported").otherwise("stale").alias("verdict")


def check_paths(claims: DataFrame, paths: DataFrame) -> DataFrame:
    """(doc_path, line_no, raw, verdict). A missing path of the past is silent; so are those of a table row, all of
    whose cells are claims and some of which exists: the row tells of a move."""
    row = Window.partitionBy("doc_path", "line_no")
    seen = existing(claims, paths)
    moved = (F.count(F.lit(1)).over(row) >= 2) & (F.min(F.col("table_row").cast("int")).over(row) == 1) & (F.max(F.col("found").cast("int")).over(row) == 1)
    out = seen.withColumn("__moved", moved).where(F.col("found") | ~(F.col("historical") | F.col("__moved")))
    return out.select("doc_path", "line_no", "raw", verdict(F.col("found")))


def check_commands(classified: DataFrame, entries: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """(doc_path, line_no, cmd, kind, target, verdict); kinds without a manifest are silent.

    entries: (kind, name). present: the kinds that have a manifest, an empty one too;
    by default those that have entries.
    """
    kinds = (entries if present is None else present).select("kind").distinct()
    declared = entries.select("kind", F.col("name").alias("target"), F.lit(True).alias("found")).distinct()
    out = classified.join(kinds, "kind", "left_semi").join(declared, ["kind", "target"], "left")
    return out.select("doc_path", "line_no", "cmd", "kind", "target", verdict(F.coalesce("found", F.lit(False))))


def check_env(named: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_path, line_no, name, verdict) by whether the code has the token (term)."""
    known = tokens.select(F.col("term").alias("name"), F.lit(True).alias("found")).distinct()
    return named.join(known, "name", "left").select("doc_path", "line_no", "name", verdict(F.coalesce("found", F.lit(False))))


def check_flags(found_flags: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_path, line_no, flag, verdict) by whether the code has any of the flag's spellings."""
    found_flags = cut(found_flags.select("doc_path", "line_no", "flag"))  # read twice
    spelled = found_flags.select("flag").distinct().withColumn("term", F.explode(flag_spellings(F.col("flag"))))
    known = spelled.join(tokens.select("term").distinct(), "term", "left_semi").select("flag", F.lit(True).alias("found")).distinct()
    return found_flags.join(known, "flag", "left").select("doc_path", "line_no", "flag", verdict(F.coalesce("found", F.lit(False))))


def grounding(symbols: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names, anchors, types) of symbols (name, kind, module): each a table of ``name``."""
    segments = symbols.select(F.explode(F.split("module", "/")).alias("name")).where("name <> ''")
    names = symbols.select("name").union(segments).distinct()
    kinds = ("class", "enum", "interface", "struct", "trait")
    return names, names, symbols.where(F.col("kind").isin(*kinds)).select("name").distinct()


def check_references(references: DataFrame, names: DataFrame, anchors: DataFrame, types: DataFrame) -> DataFrame:
    """(doc_path, line_no, reference, verdict) of those references that begin in this code."""
    parts = F.split("reference", "::")
    local = F.regexp_replace("reference", "^((crate|self|super)::)+", "")
    rest = F.split(local, "::")
    told = references.withColumn("__local", F.element_at(parts, 1).isin("crate", "self", "super")).withColumn("__rest", rest)
    told = told.where(~local.isin("crate", "self", "super"))
    told = told.withColumn("__head", F.col("__rest")[0]).withColumn("__member", F.element_at("__rest", -1)).withColumn("__type", F.try_element_at("__rest", F.lit(-2)))

    def flag(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
        return df.join(table.select(F.col("name").alias(key), F.lit(True).alias(f"{key}_ok")).distinct(), key, "left")

    out = flag(flag(flag(told, anchors, "__head"), names, "__member"), types, "__type")
    out = out.where("__local OR __head_ok")
    return out.select("doc_path", "line_no", "reference", verdict(F.coalesce("__member_ok", "__type_ok", F.lit(False))))


def literals(symbols: DataFrame) -> DataFrame:
    """Distinct (name, vtype, vkey) of the constants (name, constants) that can be compared: booleans, whole numbers and
    plain strings, without the quotes and prefixes of their language."""
    one = symbols.select("name", F.explode("constants").alias("raw"))
    quoted = F.col("raw").rlike(r"""^[A-Za-z]{0,2}(["'`])[^\\{}$\s]+\1$""")
    inner = F.concat(F.lit('"'), F.regexp_extract("raw", r"""^[A-Za-z]{0,2}["'`](.*)["'`]$""", 1), F.lit('"'))
    low, number = F.lower("raw"), canonical_int(F.col("raw"))
    kinds = F.array(
        F.when(low.isin("true", "false"), F.struct(F.lit("bool").alias("vtype"), low.alias("vkey"))),
        F.when(~F.col("raw").startswith('"') & number.isNotNull(), F.struct(F.lit("int").alias("vtype"), number.alias("vkey"))),
        F.when(quoted, F.struct(F.lit("str").alias("vtype"), inner.alias("vkey"))),
    )
    return one.select("name", F.explode(F.filter(kinds, lambda v: v.isNotNull())).alias("v")).select("name", "v.vtype", "v.vkey").distinct()


def check_constants(claims: DataFrame, literals: DataFrame) -> DataFrame:
    """(doc_path, line_no, symbol, vkey, verdict): supported if a literal of the claimed type is the claimed value,
    contradicted if there is exactly one and it is another.

    literals: (name, vtype, vkey) of the code. ``default_x`` and ``x_default`` also answer to x.
    """
    low = F.lower("name")
    keys = F.array_distinct(F.array(low, F.regexp_replace(low, "^default_", ""), F.when(~low.startswith("default_"), F.regexp_replace(low, "_default$", "")).otherwise(low)))
    own_name = (F.col("vtype") == "str") & (F.lower("vkey") == F.concat(F.lit('"'), low, F.lit('"')))
    told = literals.where(~own_name).select(F.explode(keys).alias("__key"), "vtype", F.col("vkey").alias("__seen")).distinct()
    seen = told.groupBy("__key", "vtype").agg(F.collect_set("__seen").alias("__all"))
    out = claims.withColumn("__key", F.lower("symbol")).join(seen, ["__key", "vtype"])
    found = F.array_contains("__all", F.col("vkey"))
    return out.where(found | (F.size("__all") == 1)).select("doc_path", "line_no", "symbol", "vkey", F.when(found, "supported").otherwise("contradicted").alias("verdict"))
