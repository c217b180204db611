"""Findings as a stream: each micro-batch of findings is merged into the ledger, the last state of a claim winning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.sources.storage import names

SCHEMA = "id string, module string, verdict string, seen_at timestamp"


def ledger_state(updates: DataFrame) -> DataFrame:
    """The newest row of each claim; of equal times the greatest verdict."""
    last = Window.partitionBy("id").orderBy(F.desc("seen_at"), F.desc("verdict"))
    return updates.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def follow(findings: DataFrame, ledger_path: str, checkpoint: str) -> StreamingQuery:
    """Merges the stream ``findings`` (SCHEMA) into versions of the ledger under ``ledger_path``.

    A batch writes version N + 1 from version N, whose number is the batch's, so a batch
    that is run again after a failure gives the same version.
    """

    at = ledger_path.rstrip("/")

    def merge(batch: DataFrame, number: int) -> None:
        parts = batch.sparkSession.read.parquet(f"{at}/v{number - 1}").unionByName(batch) if number else batch
        ledger_state(parts).write.mode("overwrite").parquet(f"{at}/v{number}")

    return findings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def windowed_counts(findings: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Findings for each verdict and time window; rows later than ``late`` are dropped in a stream."""
    kept = findings.withWatermark("seen_at", late)
    return kept.groupBy(F.window("seen_at", width), "verdict").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "verdict", "n")


def read(spark: SparkSession, ledger_path: str) -> DataFrame:
    """The newest version of the ledger, in a folder or under a URI."""
    newest = max(int(n[1:]) for n in names(ledger_path) if n.startswith("v"))
    return spark.read.parquet(f"{ledger_path.rstrip('/')}/v{newest}")
