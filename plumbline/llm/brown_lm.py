"""LM scoring: a Brown class-based bigram model whose classes come from exchange clustering.

The probability of a token is that of its class after the class before, times that of
the token in its class. Words of the vocabulary (see ``corpus_words``) are assigned to
classes by exchange: each round finds, for every word, the class that raises the
likelihood of the class bigrams most while all other words stay where they are, and
moves half of the words, taken by a hash of word and pair of rounds, and in the next
round the other half. Rounds go on until such a pair raises the likelihood by less
than GAIN of what was gained so far; the best round's classes are used. Rarer words
of at least LEAST occurrences then get the class that raises the likelihood most, given
the classes of the vocabulary; as many as the corpus has, they stay in a table with their
classes and counts. All others are open: they belong to fixed classes by kind and last two
bytes and are spelled byte by byte, as all words below SHARE are spelled. Class
transitions are smoothed by Witten-Bell interpolation with the classes' own shares.

The counts cover every token and every neighbouring pair of the corpus. One shuffle
counts words, one gathers each word's neighbours into one row; each round then only
reads those rows. One more gathers the neighbours of the rarer words. Texts reach these
words' table as classes and distinct words of each part of the corpus, never as text.
What goes to the driver is bounded by parameters: 1 / SHARE words, the class matrix,
256 x 256 byte pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_value, chunks, discard, id_and_text, written
from .corpus_words import CHARS, KIND, Counter, Tokens, Vocabulary, mixed, tokens, vocabulary

#: Least share of all tokens that a word of the vocabulary has.
SHARE = 1e-5
#: Occurrences that a word with a class and a chance of its own has at least.
LEAST = 2
#: Classes that words are exchanged between.
CLASSES = 64
#: Classes of open words.
OPEN = 16
#: Share of all that the exchange has gained in likelihood that two more rounds gain at least, else it ends.
GAIN = 0.005
#: Costs are whole multiples of 1 / UNIT bits, so sums are exact in any order.
UNIT = 1 << 16
_SPAN = 1 << 31
_LF = 10
#: Characters of text whose distinct rarer words are looked up together.
PART_CHARS = 1 << 23
#: Occurrences of rarer words that are held before their neighbours are handed on.
HELD_NEAR = 1 << 19


def nodes(vocab: Vocabulary, t: Tokens) -> np.ndarray:
    """Number of each token: its word, or behind the words its open class."""
    at = vocab.ids(t.hashes)
    last = t.raw[t.end - 1].astype(np.uint64)
    before = np.where(t.end - t.start > 1, t.raw[np.maximum(t.end - 2, 0)], 0).astype(np.uint64)
    word = KIND[t.raw[t.start]] == 1
    # The last class holds the tokens that are not words.
    ending = np.where(word, mixed(last * np.uint64(256) + before) % np.uint64(OPEN - 1), OPEN - 1).astype(np.int64)
    return np.where(at >= 0, at, len(vocab) + ending)


def sequences(vocab: Vocabulary, t: Tokens, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of all texts with a boundary node before each and after the last; positions of the boundaries."""
    edge = len(vocab) + OPEN
    sizes = np.bincount(t.doc, minlength=texts)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(len(t.start) + texts + 1, edge, np.int64)
    out[np.arange(len(t.start)) + t.doc + 1] = nodes(vocab, t)
    return out, bounds


def _byte_pairs(t: Tokens, open_tokens: np.ndarray) -> np.ndarray:
    """Byte pairs (before * 256 + byte) of the tokens, each with a line feed before and after it."""
    start, size = t.start[open_tokens], (t.end - t.start)[open_tokens] + 1
    if not len(start):
        return np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    at = np.repeat(start - first, size) + np.arange(int(size.sum()))
    byte = t.raw[np.minimum(at, len(t.raw) - 1)].astype(np.int64)
    byte[first + size - 1] = _LF
    before = np.empty_like(byte)
    before[1:] = byte[:-1]
    before[first] = _LF
    return before * 256 + byte


def pair_counts(docs: DataFrame, vocab: Vocabulary) -> tuple[DataFrame, np.ndarray]:
    """Every neighbouring pair of nodes as (key, n), written, and how often each byte pair spells an open word."""
    shared = broadcast_value(docs.sparkSession, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        pairs, spelled = Counter(), np.zeros(1 << 16, np.int64)

        def rows(found) -> Iterator[pa.RecordBatch]:
            for k, c in found:
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["key", "n"])

        for _, texts in chunks(batches, 0, CHARS):
            t = tokens(texts)
            seq, _ = sequences(v, t, len(texts))
            left, right = seq[:-1], seq[1:]
            edge = len(v) + OPEN
            real = (left != edge) | (right != edge)  # empty texts are no sequence
            yield from rows(pairs.add(left[real] * _SPAN + right[real]))
            spelled += np.bincount(_byte_pairs(t, v.ids(t.hashes) < 0), minlength=1 << 16)
        yield from rows(pairs.flush())
        at = np.flatnonzero(spelled)
        yield from rows([(-1 - at, spelled[at])] if len(at) else [])

    partial = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(run, "key long, n long")
    table = written(partial.groupBy("key").agg(F.sum("n").alias("n")), "pair-counts")
    spelled = np.zeros(1 << 16, np.int64)
    bytes_ = table.where("key < 0").toPandas()  # 65,536 rows at most
    spelled[-1 - bytes_["key"].to_numpy(np.int64)] = bytes_["n"].to_numpy(np.int64)
    return table.where("key >= 0"), spelled


def contexts(pairs: DataFrame) -> DataFrame:
    """One row for each node, written: its right neighbours with their counts, then its left ones."""
    two = pairs.select(F.shiftright("key", 31).cast("int").alias("a"), F.col("key").bitwiseAND(F.lit(_SPAN - 1)).cast("int").alias("b"), "n")
    both = two.select(F.col("a").alias("node"), F.col("b").alias("other"), "n").unionByName(two.select(F.col("b").alias("node"), (-1 - F.col("a")).alias("other"), "n"))
    return written(both.groupBy("node").agg(F.collect_list(F.struct("other", "n")).alias("near")).select("node", F.col("near.other").alias("other"), F.col("near.n").alias("n")), "contexts")


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(m: np.ndarray) -> float:
    """What of the log-likelihood of the class bigrams depends on the classes."""
    return float(_g(m).sum() - _g(m.sum(0)).sum() - _g(m.sum(1)).sum())


def best_class(m: np.ndarray, classes: int, a: int, right: np.ndarray, left: np.ndarray, own: float) -> int:
    """The class that the word is best in while all others stay; ``a``, where it is now, on a tie.

    right, left: counts of the word before and after each class, without the ``own``
    pairs of the word with itself.
    """
    m = m.copy()
    m[a] -= right
    m[:, a] -= left
    m[a, a] -= own
    # The word's neighbours keep it as a neighbour wherever it goes.
    rows, cols = m.sum(1) + left, m.sum(0) + right
    r, c = np.flatnonzero(right), np.flatnonzero(left)
    k = np.arange(classes)
    gain = np.zeros(classes)
    at, add = m[:classes][:, r], right[r]
    d = _g(at + add) - _g(at)
    d[r[None, :] == k[:, None]] = 0.0  # the cell of the class with itself comes below
    gain += d.sum(1)
    at, add = m[c][:, :classes], left[c][:, None]
    d = _g(at + add) - _g(at)
    d[c[:, None] == k[None, :]] = 0.0
    gain += d.sum(0)
    corner = m[k, k]
    gain += _g(corner + right[:classes] + left[:classes] + own) - _g(corner)
    out, into = right.sum() + own, left.sum() + own
    gain -= _g(rows[:classes] + out) - _g(rows[:classes]) + _g(cols[:classes] + into) - _g(cols[:classes])
    best = int(np.argmax(gain))
    return best if gain[best] > gain[a] + 1e-6 else a


def _by_class(rows: pa.RecordBatch, class_of: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """(node, right, left, own) with neighbours summed by class."""
    offsets = rows.column(1).offsets.to_numpy()
    other, n = rows.column(1).values.to_numpy(), rows.column(2).values.to_numpy().astype(np.float64)
    for i, node in enumerate(rows.column(0).to_pylist()):
        o, c = other[offsets[i] : offsets[i + 1]], n[offsets[i] : offsets[i + 1]]
        own = float(c[o == node].sum())
        use = (o != node) & (o != -1 - node)
        o, c = o[use], c[use]
        on_right = o >= 0
        yield (
            node,
            np.bincount(class_of[o[on_right]], weights=c[on_right], minlength=width),
            np.bincount(class_of[-1 - o[~on_right]], weights=c[~on_right], minlength=width),
            own,
        )


def matrix(near: DataFrame, class_of: np.ndarray, width: int) -> np.ndarray:
    """Counts of class bigrams."""
    shared = broadcast_value(near.sparkSession, class_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((width, width))
        for batch in batches:
            for node, right, _, own in _by_class(batch, shared.value, width):
                m[shared.value[node]] += right
                m[shared.value[node], shared.value[node]] += own
        at = np.flatnonzero(m.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(m.ravel()[at].astype(np.int64))], ["cell", "n"])

    out = np.zeros(width * width)
    cells = near.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.float64)
    return out.reshape(width, width)


def movable(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Whether each word may move in the round: one half in every even round, the other in the round after it."""
    return mixed(hashes + np.uint64(turn // 2 + 1)) % np.uint64(2) == np.uint64(turn % 2)


def exchange(near: DataFrame, vocab: Vocabulary, classes: int = CLASSES, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of each node, the class bigrams, and the likelihood before and after each round."""
    v = len(vocab)
    width = classes + OPEN + 1
    by_count = np.argsort(-vocab.counts, kind="stable")
    now = np.empty(v, np.int64)
    now[by_count] = np.arange(v) % classes
    fixed = classes + np.arange(OPEN + 1)
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    course: list[float] = []
    while True:
        class_of = np.concatenate([now, fixed])
        m = matrix(near, class_of, width)
        course.append(likelihood(m))
        if best is None or course[-1] > best[0]:
            best = course[-1], class_of, m
        turn = len(course) - 1
        if not v or (turn >= 2 and turn % 2 == 0 and best[0] - max(course[:-2]) <= gain * (best[0] - course[0])):
            break
        shared = broadcast_value(near.sparkSession, (class_of, m, vocab.hashes))

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            class_of, m, hashes = shared.value
            may = movable(hashes, turn)
            for batch in batches:
                moved, to = [], []
                for node, right, left, own in _by_class(batch, class_of, width):
                    if node < v and may[node]:
                        b = best_class(m, classes, int(class_of[node]), right, left, own)
                        if b != class_of[node]:
                            moved.append(node)
                            to.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(moved, pa.int32()), pa.array(to, pa.int32())], ["node", "class"])

        moves = near.mapInArrow(run, "node int, class int").toPandas()  # 1 / SHARE rows at most
        now = now.copy()
        now[moves["node"].to_numpy(np.int64)] = moves["class"].to_numpy(np.int64)
    return best[1], best[2], course


@dataclass
class Model:
    vocab: Vocabulary
    class_of: np.ndarray
    #: Cost of each class after each class, of each node in its class, of each byte after each byte.
    transition: np.ndarray
    emission: np.ndarray
    spelling: np.ndarray
    #: (word, class, cost) of the words that are not in the vocabulary but have a class; None without such.
    rarer: DataFrame | None = None


def _cost(p: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(p) * UNIT).astype(np.int64)


def probabilities(m: np.ndarray, spelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed chances of each class after each class, and of each byte after each byte."""
    k = len(m)
    share = (m.sum(0) + 1) / (m.sum() + k)
    n, kinds = m.sum(1, keepdims=True), np.maximum((m > 0).sum(1, keepdims=True), 1)
    transition = (m + kinds * share) / (n + kinds)
    s = spelled.reshape(256, 256)
    base = (s.sum(0) + 1) / (s.sum() + 256)
    kinds = np.maximum((s > 0).sum(1, keepdims=True), 1)
    return transition, (s + kinds * base) / (s.sum(1, keepdims=True) + kinds)


def model_of(vocab: Vocabulary, class_of: np.ndarray, m: np.ndarray, spelled: np.ndarray) -> Model:
    transition, spelling = probabilities(m, spelled)
    total = np.bincount(class_of[: len(vocab)], weights=vocab.counts, minlength=len(m)).astype(np.float64)
    emission = np.ones(len(class_of))
    emission[: len(vocab)] = vocab.counts / total[class_of[: len(vocab)]]
    return Model(vocab, class_of, _cost(transition), _cost(emission), _cost(spelling).ravel())


def _spelled(model: Model, t: Tokens, open_tokens: np.ndarray) -> np.ndarray:
    """Cost of each of the tokens byte by byte."""
    size = (t.end - t.start)[open_tokens] + 1
    return np.add.reduceat(model.spelling[_byte_pairs(t, open_tokens)], np.cumsum(size) - size) if len(size) else size


def _placed(m: np.ndarray, classes: int, word: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word of ``word``, sorted, with the class that raises the likelihood of ``m`` most, and its count.

    left, right: classes of the tokens before and after each occurrence.
    """
    width, k = len(m), np.arange(classes)
    start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    n = np.diff(np.append(start, len(word)))
    start, n, words = start[n >= LEAST], n[n >= LEAST], word[start[n >= LEAST]]
    best = np.empty(len(words), np.int64)
    for i in range(0, len(words), 2048):
        size = n[i : i + 2048]
        rows = len(size)
        row = np.repeat(np.arange(rows), size)
        at = np.repeat(start[i : i + 2048] - (np.cumsum(size) - size), size) + np.arange(len(row))
        gain = np.zeros((rows, classes))
        corner = np.zeros((rows, classes))
        for other, table in ((right[at], m[:classes].T), (left[at], m[:, :classes])):
            cell, count = np.unique(row * width + other, return_counts=True)
            r, o = cell // width, cell % width
            own = o < classes
            corner[r[own], o[own]] += count[own]
            before = table[o]
            d = _g(before + count[:, None]) - _g(before)
            d[own, o[own]] = 0.0  # the cell of the class with itself comes below
            gain += np.add.reduceat(d, np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])))
        gain += _g(m[k, k] + corner) - _g(m[k, k])
        for total in (m.sum(1)[:classes], m.sum(0)[:classes]):
            gain -= _g(total + size[:, None]) - _g(total)
        best[i : i + 2048] = np.argmax(gain, axis=1)
    return words, best, n


def rarer_words(docs: DataFrame, vocab: Vocabulary, class_of: np.ndarray, m: np.ndarray, classes: int) -> DataFrame:
    """(word, class, n), written, of all words with LEAST occurrences that are not in the vocabulary.

    The neighbours of a word count by class, those not in the vocabulary by the class of
    their ending.
    """
    shared = broadcast_value(docs.sparkSession, (vocab, class_of, m))
    kind = np.uint16 if len(m) ** 2 <= 1 << 16 else np.uint32

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The neighbours of each rarer word, gathered over as many occurrences as are held at once."""
        v, class_of, m = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def rows() -> pa.RecordBatch:
            word, around = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(word, kind="stable")
            word, around = word[order], around[order]
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            offsets = np.append(start, len(word)).astype(np.int32) * around.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(around)])
            return pa.RecordBatch.from_arrays([pa.array(word[start].view(np.int64)), packed], ["word", "near"])

        for _, texts in chunks(batches, 0, CHARS):
            t = tokens(texts)
            seq, _ = sequences(v, t, len(texts))
            c = class_of[seq]
            rare = np.flatnonzero(v.ids(t.hashes) < 0)
            at = rare + t.doc[rare] + 1
            if len(rare):
                held.append((t.hashes[rare], (c[at - 1] * len(m) + c[at + 1]).astype(kind)))
                n += len(rare)
            if n > HELD_NEAR:
                yield rows()
                held, n = [], 0
        if held:
            yield rows()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, m = shared.value
        word, around = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows(word: np.ndarray, around: np.ndarray) -> pa.RecordBatch:
            w, c, n = _placed(m, classes, word, around // len(m), around % len(m))
            return pa.RecordBatch.from_arrays([pa.array(w), pa.array(c, pa.int32()), pa.array(n)], ["word", "class", "n"])

        for batch in batches:
            size = pc.binary_length(batch.column(1)).to_numpy() // kind(0).itemsize
            word = np.concatenate([word, np.repeat(batch.column(0).to_numpy(), size)])
            around = np.concatenate([around, np.frombuffer(b"".join(batch.column(1).to_pylist()), kind).astype(np.int64)])
            # The last word may go on in the next batch.
            end = int(np.searchsorted(word, word[-1])) if len(word) else 0
            if end:
                yield rows(word[:end], around[:end])
                word, around = word[end:], around[end:]
        if len(word):
            yield rows(word, around)

    seen = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(near, "word long, near binary")
    return written(seen.repartition("word").sortWithinPartitions("word").mapInArrow(place, "word long, class int, n long"), "rarer-words")


def classed(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, classes (a byte for each token) and own (cost of the tokens in their classes) of each row, written.

    Each part of the corpus asks for its distinct words that are not in the vocabulary;
    those that are not in the table of rarer words either are spelled.
    """
    source = id_and_text(docs)
    shared = broadcast_value(docs.sparkSession, replace(model, rarer=None))
    doc = T.StructType([T.StructField("part", T.LongType()), source.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("classes", T.BinaryType()), T.StructField("asked", T.BinaryType()), T.StructField("own", T.LongType())])
    ask = T.StructType([T.StructField("word", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("class", T.IntegerType()), T.StructField("cost", T.LongType())])
    both = T.StructType([*doc.fields, *ask.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        part, held = TaskContext.get().partitionId() << 32, 0
        asked: list[tuple[np.ndarray, ...]] = []
        number: dict[int, int] = {}

        def questions() -> pa.RecordBatch:
            word, at, klass, cost = (np.concatenate(x) for x in zip(*asked))
            none = [pa.nulls(len(word), f.type) for f in list(out)[1:6]]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(word), part)), *none, pa.array(word.view(np.int64)), pa.array(at, pa.int32()), pa.array(klass, pa.int32()), pa.array(cost, pa.int64())], names=out.names)

        for batch, texts in chunks(batches, 1, CHARS):
            out = pa.schema([("part", pa.int64()), ("doc_id", batch.schema.field(0).type), ("n_tokens", pa.int64()), ("classes", pa.binary()), ("asked", pa.binary()), ("own", pa.int64()), ("word", pa.int64()), ("at", pa.int32()), ("class", pa.int32()), ("cost", pa.int64())])
            t = tokens(texts)
            node = nodes(model.vocab, t)
            rare = np.flatnonzero(node >= len(model.vocab))
            word, first, which = np.unique(t.hashes[rare], return_index=True, return_inverse=True)
            size = len(number)
            at = np.array([number.setdefault(w, len(number)) for w in word.tolist()], np.int64)
            new = at >= size
            if new.any():
                tokens_ = np.sort(rare[first[new]])
                order = np.argsort(rare[first[new]])
                asked.append((word[new][order], at[new][order], model.class_of[node[tokens_]], _spelled(model, t, tokens_)))
            edges = np.concatenate([[0], np.cumsum(np.bincount(t.doc, minlength=len(texts)))])
            own = np.concatenate([[0], np.cumsum(model.emission[node])])
            c = model.class_of[node].astype(np.uint8)
            c[rare] = 255
            rare_edges = np.searchsorted(rare, edges)
            which = at[which].astype(np.int32)
            null = np.array([x is None for x in texts], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(texts), part)),
                    batch.column(0),
                    pa.array(np.diff(edges), mask=null),
                    pa.array([c[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
                    pa.array([which[a:b].tobytes() for a, b in zip(rare_edges[:-1], rare_edges[1:])], pa.binary()),
                    pa.array(own[edges[1:]] - own[edges[:-1]]),
                    *[pa.nulls(len(texts), f.type) for f in list(out)[6:]],
                ],
                names=out.names,
            )
            held += sum(len(x) for x in texts if x)
            if held > PART_CHARS:
                if asked:
                    yield questions()
                part, held, asked, number = part + 1, 0, [], {}
        if asked:
            yield questions()

    told = written(source.mapInArrow(run, both), "classes")
    asks = told.where("word IS NOT NULL").select("part", *ask.names)
    if model.rarer is not None:
        known = model.rarer.select("word", F.col("class").alias("known"), F.col("cost").alias("known_cost"))
        asks = asks.join(known, "word", "left").withColumns({"class": F.coalesce("known", "class"), "cost": F.coalesce("known_cost", "cost")})
    asks = asks.select(F.col("part").alias("of"), "at", "class", "cost")
    result = T.StructType([f for f in doc.fields if f.name not in ("part", "asked")])

    def fill(docs: pa.Table, answers: pa.Table) -> pa.Table:
        n = answers.num_rows
        klass, cost = np.zeros(n, np.uint8), np.zeros(n, np.int64)
        at = answers["at"].to_numpy()
        klass[at], cost[at] = answers["class"].to_numpy(), answers["cost"].to_numpy()
        classes, own = [], []
        for c, a, o in zip(docs["classes"].to_pylist(), docs["asked"].to_pylist(), docs["own"].to_pylist()):
            c, a = np.frombuffer(c, np.uint8).copy(), np.frombuffer(a, np.int32)
            c[c == 255] = klass[a]
            classes.append(c.tobytes())
            own.append(o + int(cost[a].sum()))
        return pa.table([docs["doc_id"], docs["n_tokens"], pa.array(classes, pa.binary()), pa.array(own, pa.int64())], names=result.names)

    out = written(told.where("word IS NULL").select(*doc.names).groupBy("part").cogroup(asks.groupBy("of")).applyInArrow(fill, result), "classed")
    discard(told)
    return out


def _joined(rows: list[bytes], edge: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all rows with a boundary before each and after the last; positions of the boundaries."""
    mark = bytes([edge])
    return np.frombuffer(mark + b"".join(r + mark for r in rows), np.uint8).astype(np.int64), np.concatenate([[0], np.cumsum([len(r) + 1 for r in rows])]).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def class_pairs(rows: DataFrame, width: int) -> np.ndarray:
    """Counts of class bigrams over all rows of ``classed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(width * width, np.int64)
        for batch in _slices(batches):
            seq, _ = _joined([r for r in batch.column(0).to_pylist() if r], width - 1)
            m += np.bincount(seq[:-1] * width + seq[1:], minlength=width * width)
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(m[at])], ["cell", "n"])

    out = np.zeros(width * width)
    cells = rows.select("classes").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.float64)
    return out.reshape(width, width)


def _trained(docs: DataFrame, share: float, classes: int, gain: float) -> tuple[Model, DataFrame]:
    """The model of ``docs``, and their rows of ``classed``."""
    vocab = vocabulary(docs, share)
    pairs, spelled = pair_counts(docs, vocab)
    near = contexts(pairs)
    discard(pairs)
    class_of, m, _ = exchange(near, vocab, classes, gain)
    discard(near)
    rarer = rarer_words(docs, vocab, class_of, m, classes)
    total = np.bincount(class_of[: len(vocab)], weights=vocab.counts, minlength=len(m)).astype(np.float64)
    of_rarer = rarer.groupBy("class").agg(F.sum("n").alias("n")).toPandas()  # a row for each class
    total[of_rarer["class"].to_numpy(np.int64)] += of_rarer["n"].to_numpy(np.float64)
    model = model_of(vocab, class_of, m, spelled)
    model.emission[: len(vocab)] = _cost(vocab.counts / total[class_of[: len(vocab)]])
    sums = F.array(*[F.lit(float(x)) for x in total])
    model.rarer = rarer.select("word", "class", F.rint(-F.log2(F.col("n") / F.get(sums, F.col("class"))) * UNIT).cast("long").alias("cost"))
    rows = classed(docs, model)
    transition, _ = probabilities(class_pairs(rows, len(m)), spelled)
    model.transition = _cost(transition)
    return model, rows


def train(docs: DataFrame, share: float = SHARE, classes: int = CLASSES, gain: float = GAIN) -> Model:
    return _trained(docs, share, classes, gain)[0]


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_tokens, bits and perplexity for each document row.

    The model is trained on all of ``docs`` unless one is given. Perplexity is
    2 ** (bits / (n_tokens + 1)), the end of the text being predicted too. A null
    text, and one without a token, has null bits and perplexity and no part in the
    counts. A word that two classes suit equally well goes to the one of lower number,
    or stays in its own. Texts are scored whole. Repeated rows count and stay; extra
    columns are ignored; an empty table gives no rows.
    """
    model, rows = _trained(docs, SHARE, CLASSES, GAIN) if model is None else (model, classed(docs, model))
    shared = broadcast_value(docs.sparkSession, model.transition)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("bits", T.DoubleType()), T.StructField("perplexity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition = shared.value
        for batch in _slices(batches):
            c, bounds = _joined(batch.column(2).to_pylist(), len(transition) - 1)
            sums = np.concatenate([[0], np.cumsum(transition[c[:-1], c[1:]])])
            bits = (sums[bounds[1:]] - sums[bounds[:-1]] + batch.column(3).to_numpy()) / UNIT
            n = np.diff(bounds) - 1
            with np.errstate(over="ignore"):
                perplexity = np.exp2(bits / (n + 1))
            none = n == 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, mask=none), pa.array(perplexity, mask=none)], schema.names)

    return rows.mapInArrow(run, schema)
