"""Cutting the lineage of iterative plans at files that outlive any executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own_dir: str | None = None


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again, in the folder that ``spark.checkpoint.dir`` names.

    Where that is unset, as in tests, an own folder is used, in local mode alone.
    """
    global _own_dir
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dir = _own_dir or tempfile.mkdtemp(prefix="plumbline-cut-")
        where = f"file://{_own_dir}"
    path = f"{where.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
