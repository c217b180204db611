"""Findings across runs: score, severity, ledger, dirty claims, behavioural drift and the regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.match import suffixes

#: verdict -> credit, weight, severity (3 error, 2 warning, 1 note)
VERDICTS = {"supported": (1, 1, 1), "contradicted": (0, 3, 3), "stale": (0, 2, 3), "undocumented": (0, 1, 1), "unverifiable": (0, 0, 2)}
SEVERITIES = {"note": 1, "warning": 2, "error": 3}
TOLERANCE = 1e-9


def _of(field: int) -> Column:
    out = F.lit(None).cast("int")
    for name, values in VERDICTS.items():
        out = F.when(F.col("verdict") == name, F.lit(values[field])).otherwise(out)
    return out


def _ratio() -> Column:
    return F.coalesce(F.sum(_of(0)) / F.nullif(F.sum(_of(1)), F.lit(0)), F.lit(1.0))


def score(findings: DataFrame) -> DataFrame:
    """(score) of all findings (verdict): credit over weight, 1 where nothing weighs."""
    return findings.agg(_ratio().alias("score"))


def module_scores(findings: DataFrame) -> DataFrame:
    """(module, score, claims): a finding that weighs counts in each of its ``modules``; those without one in ``(unscoped)``."""
    where = F.when(F.size("modules") > 0, F.array_distinct("modules")).otherwise(F.array(F.lit("(unscoped)")))
    each = findings.where(_of(1) > 0).withColumn("module", F.explode(where))
    return each.groupBy("module").agg(_ratio().alias("score"), F.count(F.lit(1)).alias("claims"))


def reportable(findings: DataFrame, least: str = "warning", suppressed: tuple[str, ...] = ()) -> DataFrame:
    """Findings that are not suppressed and severe enough; supported ones always stay."""
    keep = F.col("verdict") == "supported"
    return findings.where(keep | (~F.col("verdict").isin(*suppressed) & (_of(2) >= SEVERITIES[least])))


def dirty(claims: DataFrame, ledger: DataFrame, changed: DataFrame) -> DataFrame:
    """Adds ``dirty`` to claims (id, anchors): without anchors, not in the ledger (id), or with a changed anchor (name)."""
    touched = claims.select("id", F.explode("anchors").alias("name")).join(changed.select("name").distinct(), "name", "left_semi").select("id").distinct().withColumn("__touched", F.lit(True))
    known = ledger.select("id").distinct().withColumn("__known", F.lit(True))
    out = claims.join(touched, "id", "left").join(known, "id", "left")
    return out.withColumn("dirty", (F.size("anchors") == 0) | F.col("__known").isNull() | F.col("__touched").isNotNull()).drop("__touched", "__known")


def behaviour_changes(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """Dirty claims whose facts' hash differs from the ledger's; a hash of 0 or null tells nothing."""
    old = ledger.select("id", F.col("facts_hash").alias("__old"))
    both = claims.where("dirty").join(old, "id")
    known = (F.col("facts_hash") != 0) & (F.col("__old") != 0)
    return both.where(known & (F.col("facts_hash") != F.col("__old"))).drop("__old")


def upsert(claims: DataFrame, order: str = "pos") -> DataFrame:
    """The ledger after this run: one row for each id, the last by ``order``."""
    last = Window.partitionBy("id").orderBy(F.desc(order))
    return claims.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def gate(before: DataFrame, after: DataFrame) -> DataFrame:
    """(base, head, regressed) of two one-row scores."""
    both = before.select(F.col("score").alias("base")).crossJoin(after.select(F.col("score").alias("head")))
    return both.withColumn("regressed", F.col("head") + TOLERANCE < F.col("base"))


def merged_facts(facts: DataFrame) -> DataFrame:
    """One row for each claim id: lists joined, sorted and without repeats; the first known signature and return by ``pos``."""
    return facts.groupBy("id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("constants")))).alias("constants"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("predicates")))).alias("predicates"),
        F.min_by("signature", F.when(F.col("signature").isNotNull(), F.col("pos"))).alias("signature"),
        F.min_by("return_shape", F.when(F.col("return_shape").isNotNull(), F.col("pos"))).alias("return_shape"),
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    """(rule_id, level, message, uri, start_line) of the findings that are not supported."""
    from plumbline.functions.scalars import split_reference

    path, line = split_reference(F.col("doc_path"))
    level = F.element_at(F.array(F.lit("note"), F.lit("warning"), F.lit("error")), _of(2))
    return findings.where("verdict <> 'supported'").select(F.col("verdict").alias("rule_id"), level.alias("level"), F.col("claim").alias("message"), path.alias("uri"), line.alias("start_line"))


def claim_modules(claims: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, verdict, modules): where each claim (id, verdict, anchors) counts, by symbols (qualified_name, name, module, path).

    An anchor is the name of a symbol or module, else a path or the end of one that holds
    symbols and so the first such path's module, else it stands for itself.
    """
    named = symbols.select(F.explode(F.array_distinct(F.array("qualified_name", "name", "module"))).alias("anchor"), "module").distinct()
    owned = symbols.select("path", "module").distinct().select("path", "module", F.explode(suffixes(F.col("path"))).alias("anchor")).groupBy("anchor").agg(F.min_by("module", "path").alias("owner"))
    # What an anchor means is looked up in tables of what is known, which are small beside the claims of any anchor: these are not
    # sorted, and all rows of a claim come together before they are collected.
    each = claims.select("id", "verdict", F.explode_outer("anchors").alias("anchor"))
    each = each.join(named.hint("shuffle_hash"), "anchor", "left").join(owned.hint("shuffle_hash"), "anchor", "left")
    each = each.select("id", "verdict", F.coalesce("module", "owner", "anchor").alias("module")).repartition("id")
    return each.groupBy("id", "verdict").agg(F.collect_set("module").alias("modules"))


def agreement(told: DataFrame) -> DataFrame:
    """(precision, recall, accuracy) of ``said`` against ``gold``, both boolean; 1 where nothing counts."""
    both = F.count_if(F.col("said") & F.col("gold"))
    ratio = lambda n, of: F.coalesce(n / F.nullif(of, F.lit(0)), F.lit(1.0))
    return told.agg(
        ratio(both, F.count_if("said")).alias("precision"),
        ratio(both, F.count_if("gold")).alias("recall"),
        ratio(F.count_if(F.col("said") == F.col("gold")), F.count(F.lit(1))).alias("accuracy"),
    )
