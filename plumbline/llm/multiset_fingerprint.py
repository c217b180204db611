"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Each paragraph is hashed to a wide vector of LANES words of 16 bits; a document's
state is the sum of its paragraphs' vectors modulo 2**16. The sum commutes, so the
order of paragraphs doesn't matter, and a paragraph is inserted or deleted by adding
or subtracting its vector, without the rest of the document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, id_and_text, written

#: SHA-256 blocks for each paragraph; each gives 16 lanes.
BLOCKS = 8
LANES = BLOCKS * 16
_SALTS = [f"{j}:".encode() for j in range(BLOCKS)]


def paragraphs(text: str) -> list[str]:
    """The lines of the text that are not empty."""
    return [p for p in text.split("\n") if p]


def vectors(parts: Iterable[str]) -> np.ndarray:
    """A row of LANES lanes for each paragraph."""
    sha = hashlib.sha256
    raw = b"".join([sha(s + p).digest() for p in (x.encode("utf-8", "surrogatepass") for x in parts) for s in _SALTS])
    return np.frombuffer(raw, ">u2").reshape(-1, LANES).astype(np.uint16)


def empty() -> np.ndarray:
    return np.zeros(LANES, np.uint16)


def insert(state: np.ndarray, *parts: str) -> np.ndarray:
    return state + vectors(parts).sum(axis=0, dtype=np.uint16)


def delete(state: np.ndarray, *parts: str) -> np.ndarray:
    return state - vectors(parts).sum(axis=0, dtype=np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state of the union of two multisets."""
    return a + b


def to_hex(state: np.ndarray) -> str:
    return state.astype(">u2").tobytes().hex()


def from_hex(digest: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(digest), ">u2").astype(np.uint16)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs and fingerprint (hexadecimal) for each row of ``docs``; no shuffle.

    A text without paragraphs has the zero state. A null text has a null count and
    fingerprint. Texts are taken whole. Extra columns are ignored, repeated rows stay
    and an empty table gives no rows.
    """
    source = id_and_text(docs)
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_paragraphs", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            counts: list[int | None] = []
            digests: list[str | None] = []
            for text in texts:
                if text is None:
                    counts.append(None)
                    digests.append(None)
                    continue
                state, n, parts = empty(), 0, paragraphs(text)
                for i in range(0, len(parts), 4096):
                    state = insert(state, *parts[i : i + 4096])
                    n += len(parts[i : i + 4096])
                counts.append(n)
                digests.append(to_hex(state))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_paragraphs", "fingerprint"])

    return source.mapInArrow(run, schema)


def equal_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints with ``same_as``, the least doc_id of equal fingerprint, and ``n_equal`` rows of it.

    Fingerprints are written once and known by a digest of 128 bits. Least ids and
    counts are aggregated before they are shuffled, however many rows share a
    fingerprint, and only fingerprints of several rows are joined back. Rows of null
    fingerprint are equal to none: their ``same_as`` and ``n_equal`` are null. Null
    doc_ids never become ``same_as`` unless all of the group are null. Repeated rows
    count and stay; extra columns are ignored; an empty table gives no rows.
    """
    found = written(fingerprints(docs).withColumn("digest", F.unhex(F.md5("fingerprint"))), "fingerprints")
    count, least = F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")
    several = written(found.where("digest IS NOT NULL").groupBy("digest").agg(least, count).where("n > 1"), "equal")
    columns = [F.col(c) for c in ("doc_id", "n_paragraphs", "fingerprint")]
    known = found.where("digest IS NOT NULL").join(several, "digest", "left")
    known = known.select(*columns, F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("same_as"), F.coalesce("n", F.lit(1).cast("long")).alias("n_equal"))
    none = found.where("digest IS NULL").select(*columns, F.lit(None).cast(found.schema["doc_id"].dataType).alias("same_as"), F.lit(None).cast("long").alias("n_equal"))
    return known.unionByName(none)


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
p AS (SELECT rid, unnest(string_split(text, chr(10))) AS part FROM d),
h AS (SELECT rid, j, sha256(j || ':' || part) AS hex FROM p, range({BLOCKS}) AS r(j) WHERE part <> ''),
lanes AS (SELECT rid, j * 16 + k AS lane, sum(('0x' || substr(hex, 4 * k::BIGINT + 1, 4))::BIGINT) % 65536 AS v FROM h, range(16) AS q(k) GROUP BY ALL),
states AS (SELECT rid, string_agg(printf('%04x', v::BIGINT), '' ORDER BY lane) AS fingerprint FROM lanes GROUP BY rid),
counts AS (SELECT rid, count(*) AS n FROM p WHERE part <> '' GROUP BY rid),
f AS (SELECT d.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(n, 0) END AS n_paragraphs,
        CASE WHEN text IS NOT NULL THEN coalesce(fingerprint, repeat('0', {4 * LANES})) END AS fingerprint
      FROM d LEFT JOIN states USING (rid) LEFT JOIN counts USING (rid))
SELECT doc_id, n_paragraphs, fingerprint,
  CASE WHEN fingerprint IS NOT NULL THEN min(doc_id) OVER (PARTITION BY fingerprint) END AS same_as,
  CASE WHEN fingerprint IS NOT NULL THEN count(*) OVER (PARTITION BY fingerprint) END AS n_equal
FROM f"""
