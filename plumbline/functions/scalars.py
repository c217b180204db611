"""Scalar functions: hashes and ids, references, globs, vectors."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a_of(texts: list[bytes]) -> np.ndarray:
    """FNV-1a of each text: byte by byte, all texts that are long enough at once."""
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    start = (np.cumsum(sizes) - sizes)[order]
    h = np.full(len(texts), FNV_OFFSET, np.uint64)
    live = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
    for i, n in enumerate(live.tolist()):
        h[:n] = (h[:n] ^ data[start[:n] + i]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


@pandas_udf(T.StringType())
def fnv1a_hex(text: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 bytes as 16 hexadecimal digits; multiplication modulo 2**64 has no built-in form."""
    known = text.notna()
    out = pd.Series([None] * len(text), dtype=object)
    found = fnv1a_of([t.encode("utf-8", "surrogatepass") for t in text[known]])
    out[known.to_numpy()] = [f"{x:016x}" for x in found.tolist()]
    return out


def normalized(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def claim_id(doc_ref: Column, claim: Column) -> Column:
    return fnv1a_hex(F.concat(doc_ref, F.lit("\0"), normalized(claim)))


def split_reference(ref: Column) -> tuple[Column, Column]:
    """Path and line of ``path:line``; the whole as path, and line 1, where no number follows."""
    good = ref.rlike(r":[0-9]{1,9}\z")
    return F.when(good, F.regexp_extract(ref, r"^(.*):[0-9]+\z", 1)).otherwise(ref), F.when(good, F.regexp_extract(ref, r":([0-9]+)\z", 1).cast("int")).otherwise(1)


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob: * within a segment, ** across; a bare name matches in any folder."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$" if "/" in glob else f"(?:^|/){out}$"


def excluded(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_pattern(g))
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    length = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def fact_fingerprint(constants: Column, signature: Column, predicates: Column, returns: Column) -> Column:
    """FNV-1a of a symbol's facts, lists sorted and without repeats."""

    def joined(items: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(items)), ",")

    empty = F.lit("")
    return fnv1a_hex(F.concat(F.lit("C:"), joined(constants), F.lit("|S:"), F.coalesce(signature, empty), F.lit("|P:"), joined(predicates), F.lit("|R:"), F.coalesce(returns, empty)))
