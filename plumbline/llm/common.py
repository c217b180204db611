"""What the operators of this subpackage share: reading, written intermediates, batches of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text handled at once inside a Python worker.
CHUNK_CHARS = 1 << 20

_own_dir: str | None = None


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, as in tests, an own one."""
    global _own_dir
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", "") or ""
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="plumbline-")
    return f"file://{_own_dir}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    This cuts the lineage at files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` gave and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def chunks(batches: Iterator[pa.RecordBatch], text_column: int = 1, chars: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches that hold about ``chars`` characters of text, or one longer text."""
    for batch in batches:
        texts = batch.column(text_column).to_pylist()
        start = held = 0
        for i, text in enumerate(texts):
            n = len(text) if text else 0
            if i > start and held + n > chars:
                yield batch.slice(start, i - start), texts[start:i]
                start, held = i, 0
            held += n
        if len(texts) > start:
            yield batch.slice(start, len(texts) - start), texts[start:]


def broadcast_value(spark: SparkSession, value):
    """A model of bounded size, sent once to each executor."""
    return spark.sparkContext.broadcast(value)


def id_and_text(docs: DataFrame) -> DataFrame:
    """Just the two columns the operators read, whatever else the table has."""
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))


def keep_rows(docs: DataFrame, decide: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts ``decide`` keeps; no shuffle.

    The text is found by name as Spark finds it, in any case; one that is no string is a TypeError.
    """
    at = [c.lower() for c in docs.columns].index("text")
    if not isinstance(docs.schema[at].dataType, T.StringType):
        raise TypeError(f"text is no string but {docs.schema[at].dataType.simpleString()}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, at):
            yield batch.filter(pa.array(decide(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
