"""Token counts: a prefix dynamic program with the exact token count at every prefix.

For each prefix of a text the count is the one that encoding the prefix by itself
gives. Truncation and budget questions are look-ups in these counts. Counts are
stored as differences, one for each character; a prefix's count can be below that
of a shorter one, as a new character may let tokens merge.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import Memo, PrefixEncoder
from .common import broadcast_value, chunks, id_and_text

#: Rank file of a byte-level vocabulary: lines of a base64 token and its rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BUDGETS = (512, 2048, 8192)

_S = r"[\t-\r \x85\xa0  -     　]"
_NOT_SPACE = r"[^\t-\r \x85\xa0  -     　"
_SYMBOLS = _NOT_SPACE + r"\p{L}\p{N}]+"
_SHORT = r"'(?:s|t|re|ve|m|ll|d)"
_BLANK = r"[\t-\r\x85\xa0  -     　]"
#: A text's units: what no merge crosses, whatever follows. Those are the words of the
#: vocabulary's own pattern, but two or more spaces go with the word after them, since
#: a prefix that ends among the spaces takes them as one.
_UNIT = regex.compile(rf" ?\p{{L}}+|{_SHORT}| ?\p{{N}}+| ?{_SYMBOLS}|{_S}+ (?:\p{{L}}+|\p{{N}}+|{_SYMBOLS})|{_S}+{_BLANK}(?:{_SHORT}|\p{{L}}+|\p{{N}}+|{_SYMBOLS})|{_S}+")
_SHORT_FORM = regex.compile(_SHORT)
_SPACES = regex.compile(f"{_S}*")


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class PrefixCounter:
    def __init__(self, ranks: dict[bytes, int]):
        self.encoder = PrefixEncoder(ranks)
        self.memo = Memo(self._unit_steps)

    def _unit_steps(self, unit: str) -> bytes | None:
        """The differences of the unit's prefix counts as signed bytes, or None where they don't fit."""
        counts = self.unit_counts(unit)
        try:
            return array("b", map(sub, counts, [0, *counts])).tobytes()
        except OverflowError:
            return None

    def _word(self, word: str) -> list[int]:
        """Counts of the prefixes of one word of the pattern, by character, from one character on."""
        raw = word.encode("utf-8", "surrogatepass")
        counts = self.encoder.counts(raw)
        if len(raw) == len(word):
            del counts[0]
            return counts
        return [counts[i + 1] for i in range(len(raw)) if i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80]

    def _short_or_word(self, word: str) -> list[int]:
        # An apostrophe whose letters are not all there yet is a word of its own.
        if word[0] == "'" and len(word) > 1 and _SHORT_FORM.fullmatch(word):
            return [1, *[2] * (len(word) - 2), self._word(word)[-1]]
        return self._word(word)

    def unit_counts(self, unit: str) -> list[int]:
        n = _SPACES.match(unit).end()
        if n < 2:
            return self._short_or_word(unit)
        run, body = unit[:n], unit[n:]
        out = self._word(run)
        if body:
            before = self._word(run[:-1])[-1]
            if run[-1] == " ":
                out += [before + c for c in self._word(" " + body)[1:]]
            else:
                before += self._word(run[-1])[-1]
                out += [before + c for c in self._short_or_word(body)]
        return out

    def steps(self, text: str) -> np.ndarray:
        """The difference that each character makes to the count."""
        units = _UNIT.findall(text)
        values = list(map(self.memo.__getitem__, units))
        try:
            return np.frombuffer(b"".join(values), np.int8)
        except TypeError:
            return np.concatenate([np.diff(self.unit_counts(u), prepend=0) for u in units]).astype(np.int32)


def prefix_counts(deltas: bytes, width: int) -> np.ndarray:
    """The token count of each prefix, from the empty one on, from a stored row."""
    steps = np.frombuffer(deltas, np.int8 if width == 1 else "<i4")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    if counts[-1] <= budget:
        return len(counts) - 1
    return int(np.flatnonzero(counts <= budget)[-1])


_counter: tuple[int, PrefixCounter] | None = None


def _worker_counter(raw: bytes) -> PrefixCounter:
    """One counter for each Python worker, kept from task to task."""
    global _counter
    if _counter is None or _counter[0] != hash(raw):
        _counter = hash(raw), PrefixCounter(read_ranks(raw))
    return _counter[1]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """One row for each document row, with no shuffle.

    doc_id, n_chars, n_tokens; deltas: the difference of the count at each character,
    of ``delta_width`` (1 or 4) bytes, see ``prefix_counts``; and for each budget b
    chars_b, the characters of the longest prefix of at most b tokens. A null text
    has nulls, an empty one zeros. Whole texts are counted. Extra columns are ignored,
    repeated rows stay and an empty table gives no rows.
    """
    with open(vocabulary, "rb") as f:
        shared = broadcast_value(docs.sparkSession, f.read())
    source = id_and_text(docs)
    schema = T.StructType(
        [
            source.schema["doc_id"],
            T.StructField("n_chars", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("delta_width", T.IntegerType()),
            T.StructField("deltas", T.BinaryType()),
            *[T.StructField(f"chars_{b}", T.LongType()) for b in budgets],
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _worker_counter(shared.value)
        for batch, texts in chunks(batches):
            rows: list[tuple] = []
            for text in texts:
                if text is None:
                    rows.append((None,) * (4 + len(budgets)))
                    continue
                steps = counter.steps(text)
                total = int(steps.sum(dtype=np.int64))
                within = []
                if any(total > b for b in budgets):
                    counts = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
                    within = [longest_within(counts, b) for b in budgets]
                rows.append((len(text), total, steps.itemsize, steps.tobytes(), *(within or [len(text)] * len(budgets))))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * len(budgets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], schema.names)

    return source.mapInArrow(run, schema)
