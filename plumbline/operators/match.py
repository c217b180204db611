"""Joins by path suffix, by sub-path, by name, by interval and by best overlap, all as hash equi-joins where possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _runs(segments: Column, whole_end: bool) -> Column:
    """The contiguous runs of segments joined by slashes; with ``whole_end`` only those that reach the end."""
    n = F.size(segments)

    def from_start(i: Column) -> Column:
        lengths = F.array(n - i + 1) if whole_end else F.sequence(F.lit(1), n - i + 1)
        return F.transform(lengths, lambda k: F.array_join(F.slice(segments, i, k), "/"))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), from_start)))


def suffixes(path: Column) -> Column:
    """The path and what is left of it after each slash."""
    return _runs(F.split(path, "/"), True)


def subpaths(module: Column) -> Column:
    """Every contiguous run of segments: what an operand may say to mean the module."""
    return _runs(F.split(module, "/"), False)


def existing(claims: DataFrame, paths: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``found``: some path is the claimed one or ends with it at a segment's border.

    Every suffix of every path becomes a join key, so a theta join becomes a hash join.
    """
    keys = paths.select(F.explode(suffixes(F.col("path"))).alias("__needle")).distinct().withColumn("found", F.lit(True))
    needle = F.regexp_replace(F.regexp_replace(raw, r"^(\./)+", ""), "/+$", "")
    return claims.withColumn("__needle", needle).join(keys, "__needle", "left").drop("__needle").withColumn("found", F.coalesce("found", F.lit(False)))


def modules_of(operands: DataFrame, modules: DataFrame, operand: str = "operand") -> DataFrame:
    """Rows of ``operands`` with each ``module`` that the operand means: equal, or a run of whole segments of it."""
    keys = modules.select("module", F.explode(subpaths(F.col("module"))).alias("__operand"))
    return operands.withColumn("__operand", F.regexp_replace(operand, "^/+|/+$", "")).join(keys, "__operand").drop("__operand")


def _bounds(lo: str, hi: str) -> tuple[Column, Column, Column]:
    """The least and the greatest line of a range, and its own level: the least whose cells, of 2**level lines, are no shorter than it."""
    low, high = F.least(lo, hi).cast("long"), F.greatest(lo, hi).cast("long")
    return low, high, F.ceil(F.log2((high - low + 1).cast("double"))).cast("int")


def _cells(ranges: DataFrame, lo: str, hi: str, levels: DataFrame) -> DataFrame:
    """``ranges`` with ``__low``, ``__level``, ``__cell`` and ``__own``: the cells that a range meets, of its own level and all higher
    ones of ``levels`` (one row), and whether the level is its own. It meets two cells of a level at most."""
    low, high, own = _bounds(lo, hi)
    each = ranges.withColumns({"__low": low, "__high": high, "__least": own}).crossJoin(F.broadcast(levels))
    each = each.withColumn("__level", F.explode(F.filter("levels", lambda k: k >= F.col("__least")))).withColumn("__own", F.col("__level") == F.col("__least"))
    cells = F.expr("sequence(shiftright(__low, __level), shiftright(__high, __level))")
    return each.withColumn("__cell", F.explode(cells)).drop("levels", "__high", "__least")


def overlaps(hunks: DataFrame, bodies: DataFrame) -> DataFrame:
    """(symbol, path, lo, hi) where a changed range [lo, hi] meets a symbol's lines [start, end] in the same path.

    Ranges that meet share a cell at the higher of their own levels, so this is a hash join
    by path, level and cell. There are 64 levels at most. Of the cells that a pair shares
    only that of the later beginning counts.
    """
    used = hunks.select(_bounds("lo", "hi")[2].alias("k")).distinct().union(bodies.select(_bounds("start", "end")[2].alias("k")).distinct())
    levels = used.agg(F.collect_set("k").alias("levels"))
    h = _cells(hunks.select("path", "lo", "hi"), "lo", "hi", levels).alias("h")
    b = _cells(bodies.select("symbol", "path", "start", "end"), "start", "end", levels).alias("b")
    keys = (F.col("h.path") == F.col("b.path")) & (F.col("h.__level") == F.col("b.__level")) & (F.col("h.__cell") == F.col("b.__cell"))
    met = keys & (F.col("h.__own") | F.col("b.__own")) & (F.col("h.lo") <= F.col("b.end")) & (F.col("b.start") <= F.col("h.hi"))
    once = F.expr("h.__cell = shiftright(greatest(h.__low, b.__low), h.__level)")
    return h.join(b, met & once).select("b.symbol", "b.path", "h.lo", "h.hi")


def touched_symbols(hunks: DataFrame, renamed: DataFrame, bodies: DataFrame) -> DataFrame:
    """Distinct symbols whose lines a hunk meets, and all of a renamed file."""
    moved = bodies.join(renamed.select("path").distinct(), "path", "left_semi").select("symbol")
    return overlaps(hunks, bodies).select("symbol").union(moved).distinct()


def top_level(spans: DataFrame) -> DataFrame:
    """Spans (path, start, end) that no other span of the path contains; of equal ones the first id stays."""
    before = Window.partitionBy("path").orderBy("start", F.desc("end"), "id").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end").over(before)
    return spans.withColumn("__reach", reach).where(F.col("__reach").isNull() | (F.col("__reach") < F.col("end"))).drop("__reach")


def best_overlap(items: DataFrame, sets: DataFrame) -> DataFrame:
    """(owner, name, overlap, n): for each owner's items the set that holds most of them.

    At least 2 items and at least half must be in the set; of equal sets the smallest
    name wins. items: (owner, item); sets: (name, item).
    """
    n = items.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    both = items.join(sets.select("name", "item").distinct(), "item").groupBy("owner", "name").agg(F.count(F.lit(1)).alias("overlap"))
    order = Window.partitionBy("owner").orderBy(F.desc("overlap"), "name")
    first = both.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return first.join(n, "owner").where((F.col("overlap") >= 2) & (F.col("overlap") * 2 >= F.col("n")))


def first_match(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, target): of an id's candidates, in order of ``pos``, the first that is a target."""
    known = candidates.join(targets.select(F.col("target").alias("candidate")).distinct(), "candidate")
    return known.groupBy("id").agg(F.min_by("candidate", "pos").alias("target"))


#: A name with more definitions tells nothing.
MOST_DEFINITIONS = 32


def resolve_references(references: DataFrame, symbols: DataFrame, most: int = MOST_DEFINITIONS) -> DataFrame:
    """(from_symbol, to_symbol): raw references (from_symbol, name) to all symbols (qualified_name, name) of the name.

    Names with more than ``most`` definitions and references to oneself are dropped.
    """
    n = Window.partitionBy("name")
    known = symbols.select("qualified_name", "name").distinct().withColumn("__n", F.count(F.lit(1)).over(n)).where(F.col("__n") <= most)
    out = references.join(known, "name").where(F.col("from_symbol") != F.col("qualified_name"))
    return out.select("from_symbol", F.col("qualified_name").alias("to_symbol")).distinct()


def fan_in(edges: DataFrame) -> DataFrame:
    return edges.groupBy("to_symbol").agg(F.countDistinct("from_symbol").alias("fan_in"))
