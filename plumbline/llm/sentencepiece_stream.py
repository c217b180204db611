"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search keeps, for each character boundary, the surviving path into it. Arcs are
no longer than the longest piece, so only the boundaries of a window of that length
can still be extended; as soon as the backpointers of all of them lead through one
boundary, the ids up to it are final and handed out, and the window moves on.

In a unigram model the survivor is the path of greatest score. In a BPE model a piece's
score is its merge rank, and the greatest sum of ranks is not what the model encodes
to; there an arc survives if its piece may stand after the survivor's last piece under
the merges, which exactly one arc into each boundary does.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import Memo, PrefixEncoder
from .common import broadcast_value, chunks, id_and_text

#: A SentencePiece model file.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Score of an unknown character below the least piece, as in unigram models.
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = raw[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = struct.unpack("<f" if kind == 5 else "<d", raw[i : i + n])[0], i + n
        yield key >> 3, value


class Model:
    """Pieces of a model file, and encoding and decoding with them."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind = UNIGRAM
        normalizer: dict[int, object] = {}
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f[1].decode(), f.get(2, 0.0), f.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(1) != b"identity" or normalizer.get(4, 1) or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models that keep the text as it is can be used")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        self.scores = {p: self.pieces[i][1] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.unknown_score = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.merges = PrefixEncoder({p: -s for p, s in self.scores.items()})
        #: Ids by the numbers that the merges give to pieces.
        self.numbered = [-1, *self.ids.values()]
        # Characters that are part of no piece but their own: no arc crosses them.
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        self.walls = "".join(c for c in "\n\t\r" if c not in inner)
        blob = [bytes([int(p[1:-1], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNKNOWN) else p.encode() for p, _, kind in self.pieces]
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.lengths = np.array([len(b) for b in blob], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def normalized(self, text: str) -> str:
        return ((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)) if text else ""

    def unknown_ids(self, piece: str) -> list[int]:
        if self.bytes:
            return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def decode(self, ids: np.ndarray) -> bytes:
        """The normalized text as UTF-8."""
        n = self.lengths[ids]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        return self.blob[np.repeat(self.offsets[ids] - (end - n), n) + np.arange(total)].tobytes()

    def decode_text(self, ids: np.ndarray) -> str:
        text = self.decode(ids).decode("utf-8", "surrogatepass").replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


class StreamingViterbi:
    """Ids of a normalized text that is fed in parts."""

    def __init__(self, model: Model):
        self.model = model
        self.most_held = 0
        self._restart()

    def _restart(self) -> None:
        self.text = ""  # from the last committed boundary on
        self.back = [0]
        self.last = [0]  # BPE: the number of the last piece
        self.score = [0.0]  # unigram: the score of the path

    def feed(self, part: str) -> list[int]:
        """Adds ``part`` to the text; returns the ids that are final now."""
        out: list[int] = []
        step = 2 * self.model.longest
        for i in range(0, len(part), step):
            self.text += part[i : i + step]
            self.most_held = max(self.most_held, len(self.text))
            if self.model.kind == BPE:
                self.model.merges.extend(self.text, self.last, self.back)
            else:
                self._extend()
            if len(self.text) > step:
                out += self._commit()
        return out

    def _extend(self) -> None:
        m, s = self.model, self.text
        for i in range(len(self.back), len(s) + 1):
            best_j, best = i - 1, -1e300
            for j in range(max(0, i - m.longest), i):
                score = m.scores.get(s[j:i], m.unknown_score if j == i - 1 else None)
                if score is not None and self.score[j] + score > best:
                    best_j, best = j, self.score[j] + score
            self.back.append(best_j)
            self.score.append(best)

    def _ids(self, end: int) -> list[int]:
        cut = [end]
        while cut[-1] > 0:
            cut.append(self.back[cut[-1]])
        cut.reverse()
        out: list[int] = []
        ids = self.model.ids.get
        for a, b in zip(cut, cut[1:]):
            i = ids(self.text[a:b])
            if i is not None:
                out.append(i)
            else:
                out += self.model.unknown_ids(self.text[a:b])
        return out

    def _commit(self) -> list[int]:
        """Hands out what all paths into the window share."""
        n = len(self.text)
        live = set(range(max(0, n - self.model.longest + 1), n + 1))
        while len(live) > 1:
            at = max(live)
            live.discard(at)
            live.add(self.back[at])
            if 0 in live:
                return []
        end = live.pop()
        out = self._ids(end)
        self.text = self.text[end:]
        self.back = [0, *(j - end for j in self.back[end + 1 :])]
        if self.model.kind == BPE:
            self.last = self.last[end:]
        else:
            base = self.score[end]
            self.score = [x - base for x in self.score[end:]]
        return out

    def finish(self) -> list[int]:
        out = self._ids(len(self.text))
        self._restart()
        return out

    def within(self, part: str) -> list[int]:
        """Ids of a whole text that is no longer than the window, so that nothing of it is committed before its end."""
        m = self.model
        if m.kind != BPE:
            return self.feed(part) + self.finish()
        last, back = [0], [0]
        m.merges.extend(part, last, back)
        out: list[int] = []
        i, known, ids = len(part), len(m.numbered), m.numbered
        while i:
            number, j = last[i], back[i]
            if number < known:
                out.append(ids[number])
            else:
                out += m.unknown_ids(part[j:i])[::-1]
            i = j
        return out[::-1]


class Encoder:
    """Encodes unit by unit. A unit ends where no piece reaches across, so all paths meet there and it can be remembered."""

    def __init__(self, model: Model):
        self.model = model
        w = re.escape(model.walls)
        # Where no piece has a space after another character, a word begins with its spaces.
        spaced = all(SPACE not in p.lstrip(SPACE) for p in model.ids)
        self.units = re.compile(f"{SPACE}*[^{SPACE}{w}]+|{SPACE}+" + (f"|[{w}]" if w else "") if spaced else r"(?s).+")
        self.search = StreamingViterbi(model)
        self.window = 2 * model.longest
        self.memo = Memo(self._unit)

    def _unit(self, unit: str) -> bytes:
        search = self.search
        return array("i", search.within(unit) if len(unit) <= self.window else search.feed(unit) + search.finish()).tobytes()

    def encode(self, text: str) -> np.ndarray:
        units = self.units.findall(self.model.normalized(text))
        return np.frombuffer(b"".join([self.memo[u] if len(u) < 100 else self._unit(u) for u in units]), np.int32)


_encoder: tuple[int, Encoder] | None = None


def _worker_encoder(raw: bytes) -> Encoder:
    """One encoder for each Python worker, kept from task to task."""
    global _encoder
    if _encoder is None or _encoder[0] != hash(raw):
        _encoder = hash(raw), Encoder(Model(raw))
    return _encoder[1]


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids and round_trip for each document row; no shuffle.

    ``round_trip`` tells that decoding the ids gives the text back (a U+2581 in a text
    counts as the space it stands for). A null text has nulls, an empty one no ids.
    Whole texts are encoded. Extra columns are ignored, repeated rows stay and an empty
    table gives no rows. Paths of equal score are told apart by their last piece: the
    longest wins.
    """
    with open(model, "rb") as f:
        shared = broadcast_value(docs.sparkSession, f.read())
    source = id_and_text(docs)
    schema = T.StructType(
        [
            source.schema["doc_id"],
            T.StructField("n_ids", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
            T.StructField("round_trip", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(shared.value)
        m = encoder.model
        for batch, texts in chunks(batches):
            found = [None if t is None else encoder.encode(t) for t in texts]
            sizes = [0 if x is None else len(x) for x in found]
            good = [None if t is None else m.decode(x) == m.normalized(t).encode("utf-8", "surrogatepass") for t, x in zip(texts, found)]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = np.concatenate([x for x in found if x is not None] or [np.zeros(0, np.int32)])
            null = pa.array([x is None for x in found], pa.bool_())
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), type=pa.list_(pa.field("element", pa.int32(), False)), mask=null)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else len(x) for x in found], pa.int64()), ids, pa.array(good, pa.bool_())], schema.names)

    return source.mapInArrow(run, schema)
