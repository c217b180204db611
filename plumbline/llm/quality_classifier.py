"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Each word has a sparse random index vector drawn from its hash; its word vector is the
sum of the index vectors of the tokens that stand within WINDOW places of it, over
the whole corpus. A document is the mean of its tokens' vectors, the mean of its
distinct tokens' vectors, and how many there are of each. A network of two layers,
fitted with numpy on a bounded sample of labelled documents, gives the chance that a
document is good; a temperature, chosen on labelled documents that were not fitted on,
calibrates it.

Words below SHARE of all tokens have no gathered vector. They are taken by shape (kind,
capitals, digits, length), and each also by an index vector of its own, drawn from its
hash, whose mean over the document stands beside the others: however rare a word is, it
is told from others of its shape. Word vectors gather every token of every document. The
driver holds at most 1 / SHARE word vectors and TRAIN_ROWS documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_value, chunks, id_and_text
from .corpus_words import CHARS, KIND, Tokens, Vocabulary, mixed, tokens, vocabulary

DIMENSIONS = 128
#: Places of an index vector that are 1 or -1.
NONZERO = 2
WINDOW = 2
SHARE = 1e-5
#: Labelled documents that the network is fitted on: those whose ids hash lowest.
TRAIN_ROWS = 20_000
#: Of these, one in so many chooses the temperature and takes no part in the fit.
HELD_OUT = 5
HIDDEN = 64
EPOCHS = 30
#: A document is kept if the chance that it is good is at least this.
KEEP = 0.5
SHAPES = 2 * 3 * 2 * 6
#: Places of the index vectors of words that are not in the vocabulary.
RARE = 128
#: Spreads that these places are divided by, so that words seen once sway the fit little.
RARE_SCALE = 4

_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1


def shapes(t: Tokens) -> np.ndarray:
    """The shape of each token."""
    size = t.end - t.start

    def within(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag[t.raw])])
        return sums[t.end] - sums[t.start]

    upper = within(_UPPER)
    caps = np.where(upper == 0, 0, np.where(upper * 2 > size, 2, 1))
    length = np.searchsorted([2, 4, 7, 11, 17], size, side="right")
    return (((KIND[t.raw[t.start]] == 1) * 3 + caps) * 2 + (within(_DIGIT) > 0)) * 6 + length


def nodes(vocab: Vocabulary, t: Tokens) -> np.ndarray:
    at = vocab.ids(t.hashes)
    return np.where(at >= 0, at, len(vocab) + shapes(t))


def index_vectors(vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each node's index vector; the boundary of a text, the last node, has none."""
    seed = np.concatenate([vocab.hashes, mixed(np.arange(1, SHAPES + 1, dtype=np.uint64))])
    place = np.empty((len(seed) + 1, NONZERO), np.int64)
    sign = np.zeros((len(seed) + 1, NONZERO), np.int64)
    place[-1] = 0
    for j in range(NONZERO):
        drawn = mixed(seed + np.uint64(0x632BE59BD9B4E019 * (j + 1) % 2**64))
        place[:-1, j] = drawn % np.uint64(DIMENSIONS)
        sign[:-1, j] = (drawn >> np.uint64(40)).astype(np.int64) % 2 * 2 - 1
    return place, sign


def _add_contexts(total: np.ndarray, t: Tokens, at: np.ndarray, texts: int, place: np.ndarray, sign: np.ndarray) -> None:
    """Adds to each node's row the index vectors of the tokens near it."""
    edge = len(place) - 1
    seq = np.full(len(at) + WINDOW * (texts + 1), edge, np.int64)
    seq[np.arange(len(at)) + WINDOW * (t.doc + 1)] = at
    here, local = np.unique(seq, return_inverse=True)
    keys, weights = [], []
    for step in range(1, WINDOW + 1):
        for a, b in ((slice(None, -step), slice(step, None)), (slice(step, None), slice(None, -step))):
            row, other = local[a] * DIMENSIONS, seq[b]
            for j in range(NONZERO):
                keys.append(row + place[other, j])
                weights.append(sign[other, j])
    sums = np.bincount(np.concatenate(keys), weights=np.concatenate(weights), minlength=len(here) * DIMENSIONS).reshape(-1, DIMENSIONS)
    real = here != edge
    total[here[real]] += sums[real].astype(np.int32)


def word_vectors(docs: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """The vector of each node, of length 1, around the mean of all."""
    shared = broadcast_value(docs.sparkSession, vocab)
    n_nodes = len(vocab) + SHAPES

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        place, sign = index_vectors(v)
        # The tokens of one task are few enough for 32 bits; sums over tasks are wider.
        total = np.zeros((n_nodes, DIMENSIONS), np.int32)
        for _, texts in chunks(batches, 0, CHARS):
            t = tokens(texts, lower=False)
            if len(t.start):
                _add_contexts(total, t, nodes(v, t), len(texts), place, sign)
        for i in range(0, n_nodes, 4096):
            part = total[i : i + 4096]
            at = np.flatnonzero(part.any(axis=1))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(i + at, pa.int32()), pa.array([r.tobytes() for r in part[at]], pa.binary())], ["node", "vector"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums the vectors of each node, whose rows follow one another, and brings them to length 1."""
        held_node, held = -1, np.zeros(DIMENSIONS, np.int64)

        def row() -> pa.RecordBatch:
            unit = (held / max(np.linalg.norm(held), 1e-9)).astype(np.float32)
            return pa.RecordBatch.from_arrays([pa.array([held_node], pa.int32()), pa.array([unit.tobytes()], pa.binary())], ["node", "vector"])

        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32).reshape(-1, DIMENSIONS)
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            for n, s in zip(node[start].tolist(), np.add.reduceat(rows, start, dtype=np.int64)):
                if n == held_node:
                    held = held + s
                    continue
                if held_node >= 0:
                    yield row()
                held_node, held = n, s
        if held_node >= 0:
            yield row()

    schema = "node int, vector binary"
    partial = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(gather, schema)
    rows = partial.repartition("node").sortWithinPartitions("node").mapInArrow(add, schema).toArrow()  # n_nodes rows of 512 bytes at most
    out = np.zeros((n_nodes, DIMENSIONS), np.float32)
    for batch in rows.to_batches():
        out[batch.column(0).to_numpy()] = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, DIMENSIONS)
    if rows.num_rows:
        out -= out.mean(axis=0, dtype=np.float64).astype(np.float32)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def rare_vectors(hashes: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """For each text, the sum of the index vectors of the words given by hash and text."""
    out = np.zeros(texts * RARE)
    for j in range(NONZERO):
        drawn = mixed(hashes + np.uint64(0x632BE59BD9B4E019 * (j + 1) % 2**64))
        out += np.bincount(doc * RARE + (drawn % np.uint64(RARE)).astype(np.int64), weights=(drawn >> np.uint64(40)).astype(np.int64) % 2 * 2 - 1, minlength=texts * RARE)
    return out.reshape(texts, RARE)


FEATURES = 2 * DIMENSIONS + RARE + 3


def features(vocab: Vocabulary, vectors: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """A row for each text: mean vector of its tokens, of its distinct tokens, of its rare words by hash, and three sizes; zeros without a token."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    t = tokens(texts, lower=False)
    if not len(t.start):
        return out
    at = nodes(vocab, t)
    pair, count = np.unique(t.doc * np.int64(len(vectors)) + at, return_counts=True)
    doc, node = pair // len(vectors), pair % len(vectors)
    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    full = doc[start]
    rows = vectors[node]
    total = np.add.reduceat(count, start)
    distinct = np.diff(np.append(start, len(doc)))
    out[full, DIMENSIONS : 2 * DIMENSIONS] = np.add.reduceat(rows, start) / distinct[:, None]
    rows *= count[:, None].astype(np.float32)
    out[full, :DIMENSIONS] = np.add.reduceat(rows, start) / total[:, None]
    rare = at >= len(vocab)
    out[full, 2 * DIMENSIONS : -3] = rare_vectors(t.hashes[rare], t.doc[rare], len(texts))[full] / total[:, None]
    out[full, -3] = np.log(total)
    out[full, -2] = np.log(total / distinct)
    # Distinct tokens by their hashes, open words told apart.
    order = np.lexsort((t.hashes, t.doc))
    d, h = t.doc[order], t.hashes[order]
    words = d[np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])]
    out[full, -1] = np.log(total / np.bincount(words, minlength=len(texts))[full])
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def chance(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z)) if len(y) else 0.0


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that the labels are likeliest under."""
    if not len(y) or y.min() == y.max():
        return 1.0
    grid = np.exp(np.linspace(np.log(0.1), np.log(10), 201))
    return float(grid[np.argmin([log_loss(z / t, y) for t in grid])])


def fit(x: np.ndarray, y: np.ndarray, held_out: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """The network for features ``x`` and labels ``y`` (0 or 1); ``held_out`` marks the rows for the temperature."""
    rng = np.random.default_rng(seed)
    train = np.flatnonzero(~held_out)
    if not len(train):
        train = np.arange(len(x))
    fx, fy = x[train].astype(np.float64), y[train].astype(np.float64)
    mean, scale = fx.mean(0), fx.std(0) + 1e-6
    if x.shape[1] == FEATURES:
        rare = slice(2 * DIMENSIONS, 2 * DIMENSIONS + RARE)
        scale[rare] = RARE_SCALE * np.sqrt(np.mean(scale[rare] ** 2))
    fx -= mean
    fx /= scale
    share = np.clip(fy.mean(), 1e-3, 1 - 1e-3)
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.log(share / (1 - share))]
    m, v, step = [0.0] * 4, [0.0] * 4, 0
    for epoch in range(epochs):
        rate = 2e-3 * (1 - epoch / epochs)
        order = rng.permutation(len(fx))
        for i in range(0, len(order), 256):
            a, b = fx[order[i : i + 256]], fy[order[i : i + 256]]
            h = np.maximum(a @ p[0] + p[1], 0)
            e = (_sigmoid(h @ p[2] + p[3]) - b) / len(b)
            dh = np.outer(e, p[2]) * (h > 0)
            step += 1
            for k, g in enumerate((a.T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ e + 1e-4 * p[2], e.sum())):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3]), 1.0)
    if held_out.any():
        net.temperature = temperature(net.logits(x[held_out]), y[held_out])
    return net


@dataclass
class Model:
    vocab: Vocabulary
    vectors: np.ndarray
    #: None without a labelled document.
    network: Network | None


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text and quality of at most ``rows`` labelled ids, those that hash lowest; no text is shuffled.

    A document labelled more than once has the lowest of its labels. All rows of a
    doc_id are given.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` ids and labels, whatever the size of the tables.
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, share: float = SHARE) -> Model:
    """Of texts that share a doc_id the one whose features are least, byte by byte, is fitted on."""
    vocab = vocabulary(docs, share, lower=False)
    vectors = word_vectors(docs, vocab)
    shared = broadcast_value(docs.sparkSession, (vocab, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, 1, CHARS):
            x = features(*shared.value, texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    sample = labelled_sample(docs, labels, rows)
    schema = T.StructType([sample.schema["doc_id"], T.StructField("quality", T.IntegerType()), T.StructField("x", T.BinaryType())])
    held_out = F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(HELD_OUT)) == 0
    one = sample.mapInArrow(run, schema).groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    found = one.withColumn("held_out", held_out).orderBy("doc_id").select("quality", "x", "held_out").toArrow()  # ``rows`` rows at most
    if not found.num_rows:
        return Model(vocab, vectors, None)
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float32).reshape(-1, FEATURES)
    return Model(vocab, vectors, fit(x, (found["quality"].to_numpy() > 0).astype(np.float64), found["held_out"].to_numpy()))


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None, keep: float = KEEP) -> DataFrame:
    """doc_id, p_quality (rounded to 6 places) and keep for each document row; no shuffle after the training.

    A document is kept if its chance is at least ``keep``. A null text, and one
    without a token, has a null chance and isn't kept. Without any labelled document
    every chance is null, and every text with a token is kept. A document labelled more
    than once has the lowest of its labels; labels of a null or unknown doc_id count for
    nothing. Texts are taken whole. Equal texts have equal chances. Repeated rows stay;
    extra columns are ignored; an empty table gives no rows.
    """
    model = train(docs, labels) if model is None else model
    shared = broadcast_value(docs.sparkSession, model)
    source = id_and_text(docs)
    schema = T.StructType([source.schema["doc_id"], T.StructField("p_quality", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch, texts in chunks(batches, 1, CHARS):
            x = features(m.vocab, m.vectors, texts)
            none = np.array([not t or not t.strip(_BLANKS) for t in texts], bool)
            if m.network is None:
                p, kept = np.zeros(len(texts)), ~none
                unknown = np.ones(len(texts), bool)
            else:
                p = np.round(m.network.chance(x), 6)
                kept, unknown = (p >= keep) & ~none, none
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, mask=unknown), pa.array(kept)], schema.names)

    return source.mapInArrow(run, schema)


#: What no token holds.
_BLANKS = "".join(map(chr, [*range(33), 127]))
