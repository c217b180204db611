"""Language ID: prediction by partial matching under frozen statistics.

For each language a context tree of bytes up to MAX_ORDER deep is counted on sample
documents. A byte's probability is that of its longest known context by escape
method C with exclusion: an unseen byte escapes to the next shorter context, down
to equal chances for all 256 bytes. As the statistics stay frozen, the code length
of a byte depends on its MAX_ORDER predecessors alone, so the trees are compiled
into one table of states by next byte, and a text's exact code length is a sum of
look-ups over all of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_value, chunks, keep_rows

MAX_ORDER = 3
#: Sample documents of each language that its tree is fitted on: those whose ids hash lowest.
TRAIN_DOCS = 400
#: A text that takes more bits a byte than this under every tree is in no known language.
REJECT_BITS = 5.0
#: Bits that a text of any length may take above that, for what no context tells yet at its start.
START_BITS = 32
#: Code lengths are whole multiples of 1 / UNIT bits, so sums are exact in any order.
UNIT = 1024


@dataclass
class Model:
    languages: list[str]
    #: Byte -> symbol; bytes of no sample share the last symbol.
    symbols: np.ndarray
    size: int
    #: The three preceding symbols, as a number -> state.
    states: np.ndarray
    #: (state * size + symbol, language) -> code length in 1 / UNIT bits.
    cost: np.ndarray


def _counts(texts: list[bytes], symbols: np.ndarray, size: int) -> list[dict[int, np.ndarray]]:
    """For each order: context (number in base ``size``) -> counts of next symbols."""
    start = int(symbols[10])
    parts = [np.concatenate([np.full(MAX_ORDER, start), symbols[np.frombuffer(t, np.uint8)]]) for t in texts if t]
    out: list[dict[int, np.ndarray]] = []
    for order in range(MAX_ORDER + 1):
        keys = []
        for p in parts:
            n = len(p) - MAX_ORDER
            c = np.zeros(n, np.int64)
            for j in range(order, 0, -1):
                c = c * size + p[MAX_ORDER - j : MAX_ORDER - j + n]
            keys.append(c * size + p[MAX_ORDER:])
        pair, count = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        context, first = np.unique(pair // size, return_index=True)
        table = np.zeros((len(context), size))
        table[np.searchsorted(context, pair // size), pair % size] = count
        out.append({"context": context, "table": table})
    return out


def _rows(contexts: np.ndarray, order: int, counts: list, size: int, base: np.ndarray) -> np.ndarray:
    """Probabilities of the next symbol for each context of ``order`` symbols, under one language's tree."""
    if order < 0:
        return np.broadcast_to(base, (len(contexts), size)).copy()
    shorter = _rows(contexts % size ** max(order - 1, 0) if order else contexts, order - 1, counts, size, base)
    known, table = counts[order]["context"], counts[order]["table"]
    at = np.searchsorted(known, contexts)
    hit = (at < len(known)) & (known[np.minimum(at, max(len(known) - 1, 0))] == contexts) if len(known) else np.zeros(len(contexts), bool)
    seen = np.zeros((len(contexts), size))
    seen[hit] = table[at[hit]]
    n, distinct = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
    left = 1.0 - np.where(seen > 0, shorter, 0.0).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(seen > 0, seen / (n + distinct), distinct / (n + distinct) * shorter / np.maximum(left, 1e-12))
    return np.where(hit[:, None], p, shorter)


def fit(samples: dict[str, list[str]]) -> Model:
    """A model over the languages of ``samples``; the same texts give the same model in any order."""
    languages = sorted(samples)
    texts = {k: sorted(t.encode("utf-8", "surrogatepass") for t in samples[k]) for k in languages}
    used = np.zeros(256, bool)
    used[10] = True
    for ts in texts.values():
        for t in ts:
            used[np.unique(np.frombuffer(t, np.uint8))] = True
    size = int(used.sum()) + 1
    symbols = np.full(256, size - 1, np.int64)
    symbols[used] = np.arange(size - 1)
    base = np.full(size, 1 / 256)
    base[-1] = max(256 - (size - 1), 1) / 256
    counts = {k: _counts(texts[k], symbols, size) for k in languages}
    # States: the contexts of any language, longest first; a history belongs to its longest known suffix.
    states = np.full(size**MAX_ORDER, -1, np.int32)
    cost, n = [], 0
    for order in range(MAX_ORDER, -1, -1):
        known = np.unique(np.concatenate([counts[k][order]["context"] for k in languages] or [np.zeros(0, np.int64)]))
        if order == 0:
            known = np.zeros(1, np.int64)
        tails = size**order
        view = states.reshape(-1, tails)
        free = view[:, known] < 0
        view[:, known] = np.where(free, n + np.arange(len(known), dtype=np.int32), view[:, known])
        bits = np.stack([-np.log2(_rows(known, order, counts[k], size, base)) for k in languages], axis=-1) if languages else np.zeros((len(known), size, 0))
        bits[:, -1] += np.log2(max(256 - (size - 1), 1))  # which of the bytes that share a symbol
        cost.append(np.rint(bits * UNIT).astype(np.int32))
        n += len(known)
    return Model(languages, symbols, size, states, np.ascontiguousarray(np.concatenate(cost).reshape(n * size, len(languages))))


def code_lengths(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each text, and its code length in 1 / UNIT bits under each language."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    out = np.zeros((len(raw), len(model.languages)), np.int64)
    if not sizes.any() or not model.languages:
        return sizes, out
    gap = b"\n" * MAX_ORDER
    s = model.symbols[np.frombuffer(gap + gap.join(r for r in raw if r), np.uint8)]
    m = len(s) - MAX_ORDER
    history = np.zeros(m, np.int64)
    for j in range(MAX_ORDER):
        history = history * model.size + s[j : j + m]
    at = model.states[history].astype(np.int64) * model.size + s[MAX_ORDER:]
    full = np.flatnonzero(sizes)
    start = np.concatenate([[0], np.cumsum(sizes[full] + MAX_ORDER)[:-1]])
    bounds = np.stack([start, start + sizes[full]], axis=1).ravel()
    if bounds[-1] == m:
        bounds = bounds[:-1]
    for k in range(len(model.languages)):
        out[full, k] = np.add.reduceat(model.cost[at, k], bounds, dtype=np.int64)[::2]
    return sizes, out


def sample(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> dict[str, list[str]]:
    """Up to ``train_docs`` whole texts of each language named in ``docs``, chosen by the hash of their ids."""
    ids = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang")
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("n", F.row_number().over(w)).where(F.col("n") <= train_docs).select("doc_id").distinct()
    # At most train_docs ids a language: a size fixed by the parameter.
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id", "left_semi").where("lang IS NOT NULL AND length(text) > 0").distinct()
    out: dict[str, list[str]] = {}
    for r in rows.toLocalIterator():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def predict(model: Model, texts: list[str | None], reject_bits: float = REJECT_BITS) -> tuple[list[str | None], list[float | None], list[float | None]]:
    """Language, bits a byte and margin of each text; see ``identify``."""
    sizes, cost = code_lengths(model, [t or "" for t in texts])
    predicted: list[str | None] = []
    bits: list[float | None] = []
    margin: list[float | None] = []
    for text, n, row in zip(texts, sizes.tolist(), cost.tolist()):
        if not text or text.isspace() or not row:
            predicted.append(None)
            bits.append(None)
            margin.append(None)
            continue
        best = min(row)
        bits.append(best / UNIT / n)
        margin.append((sorted(row)[1] - best) / UNIT / n if len(row) > 1 else None)
        predicted.append(model.languages[row.index(best)] if best / UNIT <= reject_bits * n + START_BITS else None)
    return predicted, bits, margin


def identify(docs: DataFrame, model: Model | None = None, reject_bits: float = REJECT_BITS) -> DataFrame:
    """doc_id, declared lang, predicted language, bits_per_byte, margin and keep for each row; no shuffle.

    ``margin`` is the bits a byte by which the second language is longer (null with
    one language). On a tie the first name wins. A null, empty or blank text, and
    one that takes more than ``reject_bits`` a byte and START_BITS under every language,
    is predicted null and not kept.
    Without any labelled text there are no languages and nothing is kept. Texts are
    scored whole. Extra columns are ignored; repeated rows stay; an empty table gives no
    rows.
    """
    spark = docs.sparkSession
    model = fit(sample(docs)) if model is None else model
    shared = broadcast_value(spark, model)
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    schema = T.StructType(
        [
            source.schema["doc_id"],
            T.StructField("lang", T.StringType()),
            T.StructField("predicted", T.StringType()),
            T.StructField("bits_per_byte", T.DoubleType()),
            T.StructField("margin", T.DoubleType()),
            T.StructField("keep", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch, texts in chunks(batches):
            predicted, bits, margin = predict(m, texts, reject_bits)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(predicted, pa.string()),
                    pa.array(bits, pa.float64()),
                    pa.array(margin, pa.float64()),
                    pa.array([p is not None for p in predicted], pa.bool_()),
                ],
                schema.names,
            )

    return source.mapInArrow(run, schema)


def known_languages(docs: DataFrame, model: Model | None = None, reject_bits: float = REJECT_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, that ``identify`` keeps; repeated rows stay, an empty table gives no rows."""
    shared = broadcast_value(docs.sparkSession, fit(sample(docs)) if model is None else model)
    return keep_rows(docs, lambda texts: [p is not None for p in predict(shared.value, texts, reject_bits)[0]])
