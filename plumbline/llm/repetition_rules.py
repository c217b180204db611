"""Quality rules: repetition inside a document, from its suffix array.

The text is taken as words, whatever their length. A text of which most is written
without white space, its words having more than SPACELESS characters on average, is
taken character by character instead, and WORD_CHARS characters count as a word. The
suffix array is built by prefix doubling in which only suffixes that are not yet told
apart are sorted again; adjacent common prefixes come from the ranks kept for each
doubling. Intervals of common prefixes of at least MIN_WORDS give the maximal repeated
substrings; the union of their spans, as a fraction of the characters, and the longest
of them are limited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, id_and_text, keep_rows

#: Words that a repeated substring has at least.
MIN_WORDS = 4
#: Mean characters of a text's words beyond which the text is written without white space.
SPACELESS = 32
#: Characters that count as a word in such a text.
WORD_CHARS = 6
MAX_COVERED = 0.4
MAX_LONGEST = 100


def units(text: str) -> tuple[list[str], int]:
    """The words of a text, or its visible characters if it is written without white space, and how many make a word."""
    words = text.split()
    chars = sum(map(len, words))
    return (list("".join(words)), WORD_CHARS) if chars > SPACELESS * len(words) else (words, 1)


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of ``ids`` and, for each doubling k, ranks that are equal where 2**k items are.

    No suffix may be another's prefix: the last item of ``ids`` must be unique.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    ordered = ids[order]
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    slot = np.arange(n)
    start = np.maximum.accumulate(np.where(new, slot, 0))
    rank = np.empty(n, np.int32 if n < 2**31 else np.int64)
    rank[order] = start
    ranks = [rank]
    alone = new & np.append(new[1:], True)
    slots = slot[~alone]
    h = 1
    while len(slots):
        at = order[slots]
        key = rank[at].astype(np.int64) * (n + 1) + rank[at + h]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        new = np.empty(len(slots), bool)
        new[:1] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        start = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        rank = rank.copy()
        rank[at] = start
        ranks.append(rank)
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray], least: int) -> np.ndarray:
    """Common prefix of each suffix and the next in the array, or 0 where it is below ``least``."""
    out = np.zeros(len(order), np.int64)
    level = max(0, least.bit_length() - 1)
    if len(order) < 2 or level >= len(ranks):
        return out
    same = np.flatnonzero(ranks[level][order[:-1]] == ranks[level][order[1:]])
    a, b = order[same], order[same + 1]
    length = np.zeros(len(same), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        equal = ranks[k][a + length] == ranks[k][b + length]
        length[equal] += 1 << k
    out[same] = np.where(length >= least, length, 0)
    return out


def maximal_repeats(order: np.ndarray, prefix: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(length, first slot, last slot) of each common-prefix interval that can't be extended to the left.

    ``left`` is each position's preceding item, unique where there is none.
    """
    before = left[order]
    differs = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    stack: list[tuple[int, int]] = []
    values = prefix.tolist()
    for j in np.flatnonzero(prefix > 0).tolist():
        v, first = values[j], j
        while stack and stack[-1][0] >= v:
            height, first = stack.pop()
            if height > v and differs[j] > differs[first]:
                yield height, first, j
        stack.append((v, first))
        if j + 1 >= len(values) or values[j + 1] == 0:
            while stack:
                height, first = stack.pop()
                if differs[j + 1] > differs[first]:
                    yield height, first, j + 1


def measure(texts: list[str], least: int = MIN_WORDS) -> list[tuple[float, int, int]]:
    """For each text: the fraction of its characters in repeats, the longest repeat in words, the maximal repeats."""
    found = [units(t) for t in texts]
    result: list[tuple[float, int, int]] = [(0.0, 0, 0)] * len(texts)
    for size in {k for _, k in found}:
        at = [i for i, (_, k) in enumerate(found) if k == size]
        for i, (covered, longest, number) in zip(at, _measure([found[i][0] for i in at], least * size)):
            result[i] = covered, longest // size, number
    return result


def _measure(parts: list[list[str]], least: int) -> list[tuple[float, int, int]]:
    sizes = np.array([len(p) for p in parts], np.int64)
    full = np.flatnonzero(sizes)
    result: list[tuple[float, int, int]] = [(0.0, 0, 0)] * len(parts)
    if not len(full):
        return result
    ids: list[int] = []
    base = 0
    for i in full.tolist():
        seen: dict[str, int] = {}
        put = seen.setdefault
        # Numbers of their own for each document, and one for its end: repeats never reach across.
        ids += [base + put(w, len(seen)) for w in parts[i]]
        base += len(seen) + 1
        ids.append(base - 1)
    numbers = np.array(ids, np.int64)
    chars = np.array([n for i in full.tolist() for n in (*map(len, parts[i]), 0)], np.int64)
    order, ranks = suffix_array(numbers)
    prefix = common_prefixes(order, ranks, least)
    longest = np.zeros(len(numbers), np.int64)
    longest[order] = np.maximum(prefix, np.concatenate([[0], prefix[:-1]]))
    begin = np.flatnonzero(longest)
    edge = np.bincount(begin, minlength=len(numbers) + 1) - np.bincount(begin + longest[begin], minlength=len(numbers) + 1)
    covered = np.cumsum(edge)[:-1] > 0
    start = np.concatenate([[0], np.cumsum(sizes[full] + 1)[:-1]])
    total, inside = np.add.reduceat(chars, start), np.add.reduceat(chars * covered, start)
    most = np.maximum.reduceat(longest, start)
    left = np.concatenate([[-1], numbers[:-1]])
    left[start] = -1 - np.arange(len(start))
    number = np.zeros(len(full), np.int64)
    for _, first, _ in maximal_repeats(order, prefix, left):
        number[np.searchsorted(start, order[first], side="right") - 1] += 1
    for k, i in enumerate(full.tolist()):
        result[i] = (float(inside[k] / total[k]), int(most[k]), int(number[k]))
    return result


def _kept(rows: list[tuple[float, int, int]], max_covered: float, max_longest: int) -> list[bool]:
    return [c <= max_covered and n <= max_longest for c, n, _ in rows]


def repetition(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """doc_id, covered_fraction, longest_repeat (words), n_repeats and keep for each row; no shuffle.

    A document is kept if at most ``max_covered`` of its characters lie in repeats
    of MIN_WORDS words or more, and no repeat has more than ``max_longest`` words. A
    word is a run without white space of any length, so a text that cites a long URL
    twice repeats one word. Only a text whose runs have more than SPACELESS characters
    on average is taken by characters, WORD_CHARS of which are a word (whole words in
    ``longest_repeat``). A null, empty or blank text repeats nothing: its measures are
    0 and it is kept. Texts are taken whole, and a worker holds 4 bytes for each word of
    a text and each doubling of the longest repeat. Extra columns are ignored; repeated
    rows stay, and an empty table gives no rows.
    """
    source = id_and_text(docs)
    schema = T.StructType(
        [
            source.schema["doc_id"],
            T.StructField("covered_fraction", T.DoubleType()),
            T.StructField("longest_repeat", T.LongType()),
            T.StructField("n_repeats", T.LongType()),
            T.StructField("keep", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            rows = measure([t or "" for t in texts])
            keep = _kept(rows, max_covered, max_longest)
            covered, longest, number = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(covered, pa.float64()), pa.array(longest, pa.int64()), pa.array(number, pa.int64()), pa.array(keep, pa.bool_())],
                schema.names,
            )

    return source.mapInArrow(run, schema)


def unrepetitive(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of ``docs``, all columns, that ``repetition`` keeps; repeated rows stay, an empty table gives no rows."""
    return keep_rows(docs, lambda texts: _kept(measure([t or "" for t in texts]), max_covered, max_longest))
