"""Commit history: churn, co-change of documents and code, coverage of public symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Commits that a pair shares, and commits of the code since the document's last one, that make it stale.
LEAST_SHARED, LEAST_CHURN = 2, 3


def is_document(path) -> F.Column:
    return F.lower(path).rlike(r"\.(md|markdown)\z")


def churn(commit_files: DataFrame) -> DataFrame:
    """(path, commits) of commit_files (commit_idx, path)."""
    return commit_files.distinct().groupBy("path").agg(F.count(F.lit(1)).alias("commits"))


def never_documented(commit_files: DataFrame) -> DataFrame:
    """(path) of code that never changed together with a document."""
    files = commit_files.distinct()
    w = Window.partitionBy("commit_idx")
    with_doc = files.withColumn("doc", F.max(is_document(F.col("path")).cast("int")).over(w)).where(~is_document(F.col("path")))
    return with_doc.groupBy("path").agg(F.max("doc").alias("doc")).where("doc = 0").select("path")


def coupled(commit_files: DataFrame, shared: int = 1) -> DataFrame:
    """(doc, code, cochange, churn_after): pairs that changed together in at least ``shared`` commits, and how many
    commits changed the code after the document's newest one (index 0 is the newest)."""
    files = commit_files.distinct()
    docs = files.where(is_document(F.col("path"))).select("commit_idx", F.col("path").alias("doc"))
    code = files.where(~is_document(F.col("path"))).select("commit_idx", F.col("path").alias("code"))
    pairs = docs.join(code, "commit_idx").groupBy("doc", "code").agg(F.count(F.lit(1)).alias("cochange")).where(F.col("cochange") >= shared)
    newest = docs.groupBy("doc").agg(F.min("commit_idx").alias("last_doc"))
    # An as-of count: in one order of a file's commits and its pairs' last commits, the commits that come before.
    asked = pairs.join(newest, "doc").select("code", F.col("last_doc").alias("at"), F.lit(0).alias("is_commit"), "doc", "cochange")
    made = code.select("code", F.col("commit_idx").alias("at"), F.lit(1).alias("is_commit"), F.lit(None).cast("string").alias("doc"), F.lit(None).cast("long").alias("cochange"))
    before = Window.partitionBy("code").orderBy("at", "is_commit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = asked.unionByName(made).withColumn("churn_after", F.sum("is_commit").over(before))
    return both.where("is_commit = 0").select("doc", "code", "cochange", "churn_after")


def stale_documents(commit_files: DataFrame, shared: int = LEAST_SHARED, churned: int = LEAST_CHURN) -> DataFrame:
    return coupled(commit_files, shared).where(F.col("churn_after") >= churned)


def coverage_gaps(symbols: DataFrame, terms: DataFrame) -> DataFrame:
    """Public symbols (name) that no document's term names."""
    return symbols.where("visibility = 'public'").join(terms.select(F.col("term").alias("name")).distinct(), "name", "left_anti")


def ranked_gaps(gaps: DataFrame) -> DataFrame:
    """Adds ``rank``: symbols of never documented code first, then by reach (fan_in + commits + predicates), path and line.

    The rank of the whole is one sort; ``row_number`` without a partition would go through one task, so the rank is
    the partition's offset and the place in a range-partitioned sort.
    """
    reach = F.coalesce("fan_in", F.lit(0)) + F.coalesce("commits", F.lit(0)) + F.coalesce("n_predicates", F.lit(0))
    order = [F.desc("net_new"), F.desc("reach"), F.asc("path"), F.asc("line_no"), F.asc("name")]
    bucketed = gaps.withColumn("reach", reach.cast("long"))
    per = bucketed.groupBy("net_new", "reach").agg(F.count(F.lit(1)).alias("__n"))
    # As many rows as there are distinct (net_new, reach): the running sum over them is small.
    before = per.withColumn("__before", F.sum("__n").over(Window.orderBy(F.desc("net_new"), F.desc("reach")).rowsBetween(Window.unboundedPreceding, -1)))
    inner = F.row_number().over(Window.partitionBy("net_new", "reach").orderBy(*order[2:]))
    return bucketed.join(before.select("net_new", "reach", F.coalesce("__before", F.lit(0)).alias("__before")), ["net_new", "reach"]).withColumn("rank", F.col("__before") + inner).drop("__before")
