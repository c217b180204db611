"""Words of a corpus as numbers: vectorized tokens, their counts, and a vocabulary by relative frequency.

Tokens are taken from the UTF-8 bytes: maximal runs of word bytes (ASCII letters and
digits, and all bytes of characters beyond ASCII) and maximal runs of other visible
bytes. A token is known by a 64-bit hash. Counts cover every token of every document;
a word is in the vocabulary if its share of all tokens is at least a threshold, so
a vocabulary has no more than 1 / threshold words at any size of the corpus. All
others are open words, told apart by ending, and none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, written

#: Characters whose tokens are taken at once: their arrays then fit into a core's cache.
CHARS = 1 << 17
#: Distinct tokens held in a worker before their counts are handed on.
HELD = 400_000
_BASE = 0x9E3779B97F4A7C15
#: 1: bytes of words, 2: other visible bytes, 0: white space and control bytes.
KIND = np.full(256, 2, np.uint8)
KIND[:33] = 0
KIND[127] = 0
for _r in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(128, 256))):
    KIND[np.frombuffer(_r, np.uint8)] = 1

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base, and of its inverse modulo 2**64, for at least ``n`` places."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Tokens:
    """The tokens of several texts, one after the other."""

    #: UTF-8 of the texts, a line feed after each.
    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: 64-bit hash of each token.
    hashes: np.ndarray
    #: Number of the text that each token is in.
    doc: np.ndarray


def tokens(texts: list[str | None], lower: bool = True) -> Tokens:
    """Null texts have no tokens."""
    parts = [(t.lower() if lower else t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    kind = KIND[raw]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    bounds = np.concatenate([[0], change, [len(raw)]])
    visible = kind[bounds[:-1]] > 0
    start, end = bounds[:-1][visible], bounds[1:][visible]
    up, down = _tables(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    hashes = mixed((sums[end] - sums[start]) * down[start])
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    return Tokens(raw, start, end, hashes, np.searchsorted(np.cumsum(sizes), start, side="right"))


class Counter:
    """Sums of counts by 64-bit key, handed on whenever more than ``held`` keys are there."""

    def __init__(self, held: int = HELD):
        self.held = held
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def _merge(self) -> None:
        keys = np.concatenate([k for k, _ in self.parts])
        unique, at = np.unique(keys, return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([c for _, c in self.parts]).astype(np.float64), minlength=len(unique))
        self.parts = [(unique, counts.astype(np.int64))]
        self.size = len(unique)

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(keys):
            self.parts.append(np.unique(keys, return_counts=True))
            self.size += len(self.parts[-1][0])
            if self.size > self.held:
                self._merge()
                if self.size > self.held // 2:
                    yield from self.flush()

    def flush(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.parts:
            self._merge()
            yield self.parts[0]
        self.parts, self.size = [], 0


def counts(docs: DataFrame, lower: bool = True) -> DataFrame:
    """(word hash, n) over all tokens of all texts; only partial counts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()

        def rows(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for k, c in found:
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], ["word", "n"])

        for _, texts in chunks(batches, 0, CHARS):
            yield from rows(counter.add(tokens(texts, lower).hashes))
        yield from rows(counter.flush())

    partial = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(run, "word long, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    #: Hashes of the words, ascending.
    hashes: np.ndarray
    counts: np.ndarray
    #: Tokens of the corpus, all words included.
    total: int

    def __len__(self) -> int:
        return len(self.hashes)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for an open word."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def vocabulary(docs: DataFrame, share: float, least: int = 2, lower: bool = True) -> Vocabulary:
    """The words of at least ``share`` of all tokens and ``least`` occurrences.

    At most 1 / share rows come to the driver, whatever the size of the corpus.
    """
    table = written(counts(docs, lower), "word-counts")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rows = table.where(F.col("n") >= max(least, int(np.ceil(share * total)))).toPandas()
    discard(table)
    hashes = rows["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], rows["n"].to_numpy(np.int64)[order], int(total))
