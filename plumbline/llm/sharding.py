"""Sharding: a hierarchical weighted hash tree over regions, racks and shards.

At each level every child draws an exponential race time ``-ln(u) / weight``
with ``u`` hashed from the key and the child's path; the smallest draw wins.
A child's draw depends on its own path and weight alone, so a change of weights
moves keys only among the children of the node where the weights changed, and
only towards children that gained or away from children that lost weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: region -> (weight, {rack -> (weight, {shard -> weight})})
Tree = dict[str, tuple[float, dict[str, tuple[float, dict[str, float]]]]]


def _rack(weight: float, *shards: float) -> tuple[float, dict[str, float]]:
    return weight, {f"s{i}": w for i, w in enumerate(shards)}


#: Production topology.
TREE: Tree = {
    "east": (3.0, {"r0": _rack(2.0, 1, 1, 1, 1), "r1": _rack(2.0, 1, 1, 1, 1), "r2": _rack(1.0, 1, 1)}),
    "west": (2.0, {"r0": _rack(1.0, 1, 1, 2), "r1": _rack(1.5, 1, 2, 2)}),
    "north": (1.0, {"r0": _rack(1.0, 1, 1, 1), "r1": _rack(1.0, 1, 1, 1)}),
}
#: The same after one rack's shards were reweighted: s3 of east/r1 drains, s0 doubles.
NEXT_TREE: Tree = TREE | {"east": (3.0, TREE["east"][1] | {"r1": _rack(2.0, 2, 1, 1, 0)})}

DRAW_BITS = 52


def children(tree: Tree) -> dict[str, list[tuple[str, float]]]:
    """Path of each inner node -> its children with their weights; weights of 0 never win and are left out."""
    out: dict[str, list[tuple[str, float]]] = {"": [(r, w) for r, (w, _) in sorted(tree.items()) if w > 0]}
    for region, (_, racks) in tree.items():
        out[region] = [(k, w) for k, (w, _) in sorted(racks.items()) if w > 0]
        for rack, (_, shards) in racks.items():
            out[f"{region}/{rack}"] = [(s, float(w)) for s, w in sorted(shards.items()) if w > 0]
    live = [p for p, kids in out.items() if not kids]
    if live:
        raise ValueError(f"nodes without a child of positive weight: {live}")
    return out


def _draw(key: Column, path: Column, weight: Column) -> Column:
    hashed = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), path)), 1, DRAW_BITS // 4), 16, 10).cast("double")
    return -F.ln((hashed + F.lit(0.5)) / F.lit(float(2**DRAW_BITS))) / weight


def _descend(key: Column, parent: Column, kids: Column) -> Column:
    """The child of ``parent`` with the smallest draw; on a tie the smaller name."""
    slash = F.when(parent == "", F.lit("")).otherwise(F.concat(parent, F.lit("/")))
    drawn = F.transform(
        F.element_at(kids, parent),
        lambda c: F.struct(_draw(key, F.concat(slash, c["name"]), c["weight"]).alias("draw"), c["name"].alias("name")),
    )
    return F.array_min(drawn)["name"]


def _literal(tree: Tree) -> Column:
    parts: list[Column] = []
    for path, kids in children(tree).items():
        parts.append(F.lit(path))
        parts.append(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in kids]))
    return F.create_map(*parts)


def place(df: DataFrame, key: Column, tree: Tree, prefix: str = "") -> DataFrame:
    """Adds ``<prefix>region``, ``<prefix>rack`` and ``<prefix>shard``; no shuffle.

    Names are full paths. A null key is placed as the empty string is, so all
    null keys share one shard; equal keys always share one.
    """
    kids = _literal(tree)
    key = F.coalesce(key.cast("string"), F.lit(""))
    region, rack, shard = (f"{prefix}{x}" for x in ("region", "rack", "shard"))
    df = df.withColumn(region, _descend(key, F.lit(""), kids))
    df = df.withColumn(rack, F.concat_ws("/", F.col(region), _descend(key, F.col(region), kids)))
    return df.withColumn(shard, F.concat_ws("/", F.col(rack), _descend(key, F.col(rack), kids)))


def shard_documents(docs: DataFrame, tree: Tree = TREE, next_tree: Tree = NEXT_TREE) -> DataFrame:
    """One row for each document row: where it lies, and where it goes under ``next_tree``.

    Columns: doc_id, region, rack, shard, next_shard, moved. Only ``doc_id`` is
    read; other columns, null texts and clashing names play no part. Repeated
    rows are placed alike and kept. An empty table gives no rows.
    """
    at = place(docs.select("doc_id"), F.col("doc_id"), tree)
    to = place(at, F.col("doc_id"), next_tree, "next_")
    return to.select("doc_id", "region", "rack", "shard", "next_shard", (F.col("shard") != F.col("next_shard")).alias("moved"))


def oracle_sql(tree: Tree = TREE, next_tree: Tree = NEXT_TREE) -> str:
    def values(t: Tree, level: int) -> str:
        rows = []
        for path, kids in children(t).items():
            depth = 0 if path == "" else path.count("/") + 1
            if depth == level:
                rows += [f"('{path}', '{path + '/' if path else ''}{n}', {float(w)!r})" for n, w in kids]
        return ", ".join(rows)

    def levels(t: Tree, p: str) -> str:
        ctes, parent = [], "k0"
        for level in range(3):
            up = "''" if level == 0 else f"{parent}.path"
            ctes.append(
                f"""{p}{level} AS (SELECT rid, key, path FROM (
                 SELECT {parent}.rid, {parent}.key, c.child AS path, row_number() OVER (PARTITION BY {parent}.rid ORDER BY
                   -ln((('0x' || substr(md5({parent}.key || '|' || c.child), 1, {DRAW_BITS // 4}))::BIGINT::DOUBLE + 0.5) / {float(2**DRAW_BITS)!r}) / c.weight, c.child) AS n
                 FROM {parent} JOIN (VALUES {values(t, level)}) AS c(parent, child, weight) ON c.parent = {up}) WHERE n = 1)"""
            )
            parent = f"{p}{level}"
        return ", ".join(ctes)

    return f"""
    WITH k0 AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, '') AS key FROM documents),
    {levels(tree, "a")}, {levels(next_tree, "b")}
    SELECT k0.doc_id, a0.path AS region, a1.path AS rack, a2.path AS shard, b2.path AS next_shard, a2.path <> b2.path AS moved
    FROM k0 JOIN a0 USING (rid) JOIN a1 USING (rid) JOIN a2 USING (rid) JOIN b2 USING (rid)"""
