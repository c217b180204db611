"""SimHash near-dedup by a segment-popcount embedding.

A document's fingerprint is a SimHash of 256 bits over its distinct words, longer
words weighing more; a text without a word is taken by what stands between its white
space instead. A permutation of the bits, cut into segments of two bits,
maps a fingerprint to the bit counts of its segments; the Manhattan distance of two
such points never exceeds the Hamming distance of the fingerprints. Each of several
permutations lays a grid over some of the coordinates; fingerprints that share a
cell are range-joined under the Manhattan distance over all segments, and the pairs
that pass are verified by their exact Hamming distance. Verified pairs are the edges
of a graph whose connected components are the groups of near copies. A cell that many
different near copies crowd into is searched by many tasks, in blocks.

The grids find a pair at the threshold with chance RECALL. What they miss is found by
comparing all fingerprints that they leave in different components, block by block,
so the groups are those of every pair within the threshold: no link is lost.

Exact copies share a fingerprint, so the search and the graph are over distinct
fingerprints alone. The number of grids is what finds a pair at the threshold itself
with chance RECALL, at any size of the corpus; nearer pairs are found with a greater
one. The number of grid coordinates, which grows with the logarithm of the corpus,
is what makes the rows shuffled and the pairs compared cost least together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_value, chunks, discard, id_and_text, written

BITS = 256
#: Bits of a segment. The grids grow as the fingerprints to the power ln p(near) / ln p(unrelated),
#: with ``p`` the chance of equal counts: 0.46 for segments of 4 bits and 0.36 for 2.
SEGMENT = 2
SEGMENTS = BITS // SEGMENT
#: Fingerprints at this Hamming distance or less are near copies.
THRESHOLD = 44
#: Chance that the grids find a pair of fingerprints at the threshold; ``missed`` finds the others.
RECALL = 0.96
#: Pairs whose comparison costs as much as shuffling one row.
ROW_COST = 2000
_WORD = re.compile(r"[^\W_]+")
_MIX = 0x9E3779B97F4A7C15


def _weight(word: str) -> int:
    return min(len(word), 10) ** 2


def _expand(hashes: np.ndarray) -> np.ndarray:
    """256 bits for each 64-bit hash, by splitmix64 steps."""
    out = np.empty((len(hashes), BITS // 64), np.uint64)
    for k in range(BITS // 64):
        x = hashes + np.uint64(_MIX * (k + 1) % 2**64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out.view(np.uint8)


def fingerprints_of(texts: list[str | None]) -> list[bytes | None]:
    """The fingerprint of each text, by its words or, if it has none, by its runs of signs; None for a null or blank one."""
    number: dict[str, int] = {}
    put = number.setdefault
    docs: list[np.ndarray | None] = []
    for text in texts:
        low = text.lower() if text else ""
        found = set(_WORD.findall(low)) or set(low.split())
        docs.append(np.fromiter((put(w, len(number)) for w in found), np.int64, len(found)) if found else None)
    if not number:
        return [None] * len(texts)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in number), np.uint64, len(number))
    weights = np.fromiter(map(_weight, number), np.float32, len(number))
    expanded = _expand(hashes)
    out: list[bytes | None] = []
    for at in docs:
        if at is None:
            out.append(None)
            continue
        sums, total = np.zeros(BITS), 0.0
        for i in range(0, len(at), 8192):
            part = at[i : i + 8192]
            w = weights[part]
            sums += w @ np.unpackbits(expanded[part], axis=1).astype(np.float32)
            total += float(w.sum())
        out.append(np.packbits(2 * sums > total).tobytes())
    return out


def text_key(doc_id: Column, text: Column) -> Column:
    """What a row with a null doc_id is known by: a hash of its text; null for other rows."""
    return F.when(doc_id.isNull(), F.xxhash64(text))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and fp (32 bytes, null for a null or blank text) for each row."""
    source = id_and_text(docs).withColumn("text_key", text_key(F.col("doc_id"), F.col("text")))
    schema = T.StructType([source.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("fp", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fingerprints_of(texts), pa.binary())], schema.names)

    return source.mapInArrow(run, schema)


def match_chance(distance: int) -> float:
    """Chance that a random segment of two fingerprints at this distance has equal bit counts."""
    out = 0.0
    for flips in range(0, SEGMENT + 1, 2):
        hyper = math.comb(distance, flips) * math.comb(BITS - distance, SEGMENT - flips) / math.comb(BITS, SEGMENT)
        out += hyper * math.comb(flips, flips // 2) / 2**flips
    return out


def plan(n: int, threshold: int = THRESHOLD) -> tuple[int, int]:
    """Grid coordinates and number of grids for ``n`` fingerprints."""
    unrelated, near = match_chance(BITS // 2), match_chance(threshold)
    found = []
    for m in range(2, 33):
        grids = math.ceil(math.log(1 - RECALL) / math.log1p(-(near**m)))
        found.append((grids * (ROW_COST + n * unrelated**m), m, grids))
    return min(found)[1:]


def permutations(grids: int, m: int) -> np.ndarray:
    """For each grid the bits of its ``m`` segments."""
    rng = np.random.default_rng(20240607)
    return np.stack([rng.permutation(BITS)[: m * SEGMENT] for _ in range(grids)])


def cells(reps: DataFrame, m: int, grids: int, hot: np.ndarray | None = None, inside: bool = False) -> DataFrame:
    """(cell, node, fp) for each grid and fingerprint; with ``hot`` only in these cells, or only outside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_of = permutations(grids, m)
        powers = (SEGMENT + 1) ** np.arange(m, dtype=np.uint64)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                n = part.num_rows
                fps = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(n, BITS // 8)
                bits = np.unpackbits(fps, axis=1)
                cell = np.empty((n, grids), np.uint64)
                for g in range(grids):
                    counts = bits[:, bits_of[g]].reshape(n, m, SEGMENT).sum(2, dtype=np.uint64)
                    cell[:, g] = (counts * powers).sum(1, dtype=np.uint64) * np.uint64(grids) + np.uint64(g)
                flat, at = cell.ravel().view(np.int64), np.repeat(np.arange(n), grids)
                if hot is not None:
                    use = np.isin(flat, hot) == inside
                    flat, at = flat[use], at[use]
                repeat = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(flat), part.column(0).take(repeat), part.column(1).take(repeat)], ["cell", "node", "fp"])

    return reps.mapInArrow(run, "cell long, node long, fp binary")


def _embed(fps: np.ndarray) -> np.ndarray:
    """The bit counts of all segments, each as that many ones in its own two bits.

    The Manhattan distance of two points is then the Hamming distance of these codes.
    """
    low = np.uint8(0x55)
    a, b = fps & low, (fps >> np.uint8(1)) & low
    return ((a | b) << np.uint8(1)) | (a & b)


def _columns(fps: np.ndarray) -> np.ndarray:
    """The 64-bit words of the rows, a contiguous row for each word."""
    return np.ascontiguousarray(np.ascontiguousarray(fps).view(np.uint64).T)


def _apart(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the columns ``a`` and ``b`` of ``x``."""
    out = np.bitwise_count(x[0][a] ^ x[0][b]).astype(np.uint16)
    for w in x[1:]:
        out += np.bitwise_count(w[a] ^ w[b])
    return out


def _near(points: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Which pairs are within the threshold: by the Manhattan bound over half the segments, over all, then exactly."""
    at = np.flatnonzero(_apart(points[:2], a, b) <= threshold)
    at = at[_apart(points, a[at], b[at]) <= threshold]
    return at[_apart(words, a[at], b[at]) <= threshold]


def _dense(points: np.ndarray, words: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning stars of the components in one crowded cell: each step tests one member against all not yet reached."""
    free = np.arange(points.shape[1])
    while len(free):
        root, free, frontier = int(free[0]), free[1:], [int(free[0])]
        while frontier and len(free):
            at = np.array([frontier.pop()])
            hit = _near(points, words, np.repeat(at, len(free)), free, threshold)
            if len(hit):
                reached, free = free[hit], np.delete(free, hit)
                yield np.full(len(reached), root), reached
                frontier += reached.tolist()


def _tiles(points: np.ndarray, words: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the near pairs of one cell; all pairs are compared, some rows against all at a time."""
    n = points.shape[1]
    label = np.arange(n)
    for i in range(0, n, TILE):
        rows = slice(i, i + TILE)
        apart = np.bitwise_count(points[0][rows, None] ^ points[0][None, i:]).astype(np.uint16)
        for p in points[1:]:
            apart += np.bitwise_count(p[rows, None] ^ p[None, i:])
        a, b = np.nonzero(apart <= threshold)
        a, b = a[a < b] + i, b[a < b] + i
        good = _apart(words, a, b) <= threshold
        a, b = a[good], b[good]
        for r, first, end in zip(*_runs(a)):
            at = b[first:end]
            at = at[label[at] != label[r]]
            if len(at):
                other, one = np.unique(label[at], return_index=True)
                yield np.full(len(one), r), at[one]
                label[np.isin(label, other)] = label[r]


def _cross(points: np.ndarray, words: np.ndarray, n: int, label: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs between the first ``n`` rows and the others, as many as connect what they connect; rows of a label are connected already."""
    label = label.copy()
    for i in range(0, n, TILE):
        rows = slice(i, min(i + TILE, n))
        apart = np.bitwise_count(points[0][rows, None] ^ points[0][None, n:]).astype(np.uint16)
        for p in points[1:]:
            apart += np.bitwise_count(p[rows, None] ^ p[None, n:])
        a, b = np.nonzero(apart <= threshold)
        a, b = a + i, b + n
        good = _apart(words, a, b) <= threshold
        a, b = a[good], b[good]
        for r, first, end in zip(*_runs(a)):
            at = b[first:end]
            at = at[label[at] != label[r]]
            if len(at):
                other, one = np.unique(label[at], return_index=True)
                yield np.full(len(one), r), at[one]
                label[np.isin(label, other)] = label[r]


def _runs(x: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Values of the runs of equal items, and where each begins and ends."""
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[start].tolist(), start.tolist(), np.append(start, len(x))[1:].tolist()


#: Rows compared at once with all others of a cell.
TILE = 64
#: Cells above this are searched member by member; the components found are the same.
CROWDED = 8192
#: Rows of whole cells that are taken together.
ROWS = 1 << 16


def edges(cells_df: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Verified near pairs (a, b), as many as connect the members of each cell.

    The rows of a cell are brought together by a hash shuffle and a sort that spills;
    cells that reach over the end of a batch are carried on.
    """

    def emit(cell: np.ndarray, node: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        points, words = _columns(_embed(fps)), _columns(fps)
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        size = np.diff(np.append(start, len(cell)))
        last = np.repeat(start + size - 1, size)
        rows = np.flatnonzero(np.repeat(size <= TILE, size) & (last > np.arange(len(cell))))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        step = 1
        while len(rows):
            hit = rows[_near(points, words, rows, rows + step, threshold)]
            found.append((hit, hit + step))
            step += 1
            rows = rows[rows + step <= last[rows]]
        for s, n in zip(start[size > TILE].tolist(), size[size > TILE].tolist()):
            search = _tiles if n <= CROWDED else _dense
            found += [(s + a, s + b) for a, b in search(points[:, s : s + n], words[:, s : s + n], threshold)]
        if found:
            a, b = (node[np.concatenate(x)] for x in zip(*found))
            pair = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, BITS // 8)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), fps))
            n += batch.num_rows
            if n < ROWS or held[0][0][0] == held[-1][0][-1]:
                continue
            cell, node, fps = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(cell, cell[-1]))
            yield from emit(cell[:cut], node[:cut], fps[:cut])
            held, n = [(cell[cut:], node[cut:], fps[cut:])], len(cell) - cut
        if held:
            yield from emit(*(np.concatenate(x) for x in zip(*held)))

    return cells_df.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


#: Cells of about this many fingerprints are searched by many tasks; a task holds smaller ones whole.
HOT = 200_000
#: Fingerprints of the sample that tells which cells are hot, and how often a hot cell is in it at least.
SAMPLE, SEEN = 50_000, 8
#: Hot cells that are searched by many tasks, the largest; and pivots of each, in each of two rounds.
MOST_HOT, PIVOTS = 10_000, 64
#: Fingerprints of a hot cell that are compared at once with as many others, and parts that the others are dealt to.
LEFT, RIGHT, PARTS = 2_048, 16_384, 64


def hot_cells(reps: DataFrame, n: int, m: int, grids: int, hot: int = HOT) -> np.ndarray:
    """Numbers of the cells that hold about ``hot`` of the ``n`` fingerprints or more, MOST_HOT at most, by a sample.

    Which cells these are decides how they are searched, and not what is found.
    """
    if n < hot:
        return np.zeros(0, np.int64)
    rate = max(1, n // SAMPLE)
    some = reps.where(F.pmod(F.xxhash64("node"), F.lit(rate)) == 0)
    often = cells(some, m, grids).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(SEEN, hot // rate))
    return often.orderBy(F.desc("n"), "cell").limit(MOST_HOT).toPandas()["cell"].to_numpy(np.int64)


def _told(rows: DataFrame, threshold: int) -> DataFrame:
    """rows (cell, node, fp, label) with the nodes of the pivots that each is near: of PIVOTS rows of each cell that have no
    label, those whose nodes hash lowest."""
    first = Window.partitionBy("cell").orderBy(F.xxhash64("node"), "node")
    chosen = rows.where("label IS NULL").withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= PIVOTS)
    found = chosen.select("cell", "node", "fp").orderBy("cell").toPandas()  # MOST_HOT * PIVOTS rows at most
    if not len(found):
        return rows.withColumn("near", F.array().cast("array<long>"))
    fps = np.frombuffer(b"".join(found["fp"]), np.uint8).reshape(-1, BITS // 8)
    shared = broadcast_value(rows.sparkSession, (found["cell"].to_numpy(np.int64), found["node"].to_numpy(np.int64), fps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pivot, pivot_fps = shared.value
        for batch in batches:
            n = batch.num_rows
            mine = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, BITS // 8)
            both = np.concatenate([mine, pivot_fps])
            points, words = _columns(_embed(both)), _columns(both)
            cell = batch.column(0).to_numpy()
            start, end = np.searchsorted(of, cell), np.searchsorted(of, cell, side="right")
            size = end - start
            row = np.repeat(np.arange(n), size)
            at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(row))
            hit = _near(points, words, row, at + n, threshold)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=n))])
            near = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pivot[at[hit]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, near], ["cell", "node", "fp", "label", "near"])

    return rows.mapInArrow(run, "cell long, node long, fp binary, label long, near array<long>")


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """(cell, nodes, fps, labels, part): up to ``size`` rows of a cell as one, as they lie; part: a number below PARTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            table = pa.Table.from_batches([batch]).sort_by("cell")
            cell, node, label = (table.column(c).to_numpy() for c in ("cell", "node", "label"))
            fps = table.column("fp").to_pylist()
            for c, first, end in zip(*_runs(cell)):
                for i in range(first, end, size):
                    j = min(i + size, end)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c]), pa.array([node[i:j].tobytes()], pa.binary()), pa.array([b"".join(fps[i:j])], pa.binary()), pa.array([label[i:j].tobytes()], pa.binary()), pa.array([(int(node[i]) + number) % PARTS], pa.int32())],
                        ["cell", "nodes", "fps", "labels", "part"],
                    )

    own = rows.select("cell", "node", "fp", F.coalesce("label", "node").alias("label"))
    return own.mapInArrow(run, "cell long, nodes binary, fps binary, labels binary, part int")


def hot_edges(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Verified near pairs (a, b) that connect the members (cell, node, fp) of hot cells; no task holds a whole cell.

    Twice, every member is compared with PIVOTS members of its cell that are near to no
    pivot yet; a member takes the label of the least pivot it is near. Of the labels that
    members tie together, the largest set of a cell is connected by that. All other members
    are then compared with all of the cell, block by block, so no link is lost.
    """
    now = written(rows.select("cell", "node", "fp", F.lit(None).cast("long").alias("label")), "hot")
    pairs = []
    for _ in range(2):
        told = written(_told(now, threshold), "hot-told")
        pairs.append(told.select(F.explode("near").alias("a"), F.col("node").alias("b"), "cell").where("a <> b"))
        now = told.select("cell", "node", "fp", F.coalesce("label", F.array_min("near")).alias("label"))
    ties = None
    for p in pairs:
        # Pivots that share a member, by their labels: the pivots of a cell bound how many there are.
        both = p.groupBy("cell", "b").agg(F.array_sort(F.collect_set("a")).alias("near")).where("size(near) > 1").select("cell", F.explode("near").alias("a"), F.col("near")[0].alias("b")).where("a <> b").distinct()
        ties = both if ties is None else ties.unionByName(both)
    sizes: dict[int, dict[int, int]] = {}
    for r in now.where("label IS NOT NULL").groupBy("cell", "label").count().collect():  # MOST_HOT * 2 * PIVOTS rows at most
        sizes.setdefault(r["cell"], {})[r["label"]] = r["count"]
    root: dict[tuple[int, int], int] = {}

    def find(cell: int, x: int) -> int:
        while (y := root.get((cell, x), x)) != x:
            x = y
        return x

    for r in ties.collect():  # MOST_HOT * (2 * PIVOTS) ** 2 rows at most, and mostly 2 * PIVOTS for a cell
        a, b = find(r["cell"], r["a"]), find(r["cell"], r["b"])
        root[r["cell"], max(a, b)] = min(a, b)
    main = []
    for cell, found in sizes.items():
        whole: dict[int, int] = {}
        for label, n in found.items():
            whole[find(cell, label)] = whole.get(find(cell, label), 0) + n
        best = max(whole, key=lambda x: (whole[x], -x))
        main += [(cell, label) for label in found if find(cell, label) == best]
    known = F.broadcast(rows.sparkSession.createDataFrame(main, "cell long, label long"))  # as many rows as labels
    now = written(now, "hot-labels")
    rest = now.join(known, ["cell", "label"], "left_anti")
    left = _packed(rest, LEFT).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    left = left.withColumnsRenamed({c: f"l_{c}" for c in ("nodes", "fps", "labels")})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                node, label = (np.frombuffer(r[f"l_{c}"] + r[c], np.int64) for c in ("nodes", "labels"))
                fps = np.frombuffer(r["l_fps"] + r["fps"], np.uint8).reshape(-1, BITS // 8)
                found = list(_cross(_columns(_embed(fps)), _columns(fps), len(r["l_nodes"]) // 8, label, threshold))
                if found:
                    a, b = (node[np.concatenate(x)] for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    crossed = left.join(_packed(now, RIGHT), ["cell", "part"]).mapInArrow(compare, "a long, b long").where("a <> b")
    out = crossed
    for p in pairs:
        out = out.unionByName(p.select("a", "b"))
    return out


def near_pairs(reps: DataFrame, n: int, threshold: int = THRESHOLD, hot: int = HOT) -> DataFrame:
    """Verified near pairs (a, b) of the ``n`` fingerprints (node, fp), as many as connect the members of each cell.

    Pairs that share no cell are left to ``missed``.
    """
    m, grids = plan(n, threshold)
    crowd = hot_cells(reps, n, m, grids, hot)
    if not len(crowd):
        return edges(cells(reps, m, grids), threshold)
    return edges(cells(reps, m, grids, crowd), threshold).unionByName(hot_edges(cells(reps, m, grids, crowd, True), threshold))


#: Fingerprints of a block at most, on average; blocks that smaller corpora are cut into for the sake of many tasks, of
#: LEAST fingerprints or more; and fingerprints that are sent as one row.
BLOCK, BLOCKS, LEAST, PIECE = 1 << 18, 8, 2_048, 1 << 14
#: Bits compared by a matrix product, and fields of eight bits that one number of the product holds.
FIRST, FIELDS = 144, 6
#: Rows of a block compared at once with FIELDS times as many columns as the other number.
ROW_TILE, COLUMN_TILE = 256, 512
_FIELD = 256 ** np.arange(FIELDS, dtype=np.int64)
_TOP = np.uint64(128 * _FIELD.sum())


def _packed_columns(fps: np.ndarray, threshold: int) -> np.ndarray:
    """A matrix whose product with the first bits of fingerprints, and a one, has a field for each of ``fps``.

    The field is threshold + 128 less the differing bits, so its top bit tells whether these are within the threshold
    (or one of FIRST - 128, below which a field would fall short of 0). All sums are whole numbers below 2^53, exact in any order, and 2^52 makes the fields the low bits of the number.
    """
    if threshold > 127:
        raise ValueError(f"a threshold of {threshold} does not fit a field")
    threshold, width = max(threshold, FIRST - 128), -(-len(fps) // FIELDS)
    y = np.unpackbits(fps[:, : FIRST // 8], axis=1).astype(np.int64)
    out = np.zeros((width * FIELDS, FIRST + 1), np.int64)
    out[: len(fps), :FIRST] = 2 * y - 1
    out[: len(fps), FIRST] = threshold + 128 - y.sum(1)
    packed = np.einsum("gfk,f->kg", out.reshape(width, FIELDS, FIRST + 1), _FIELD)
    packed[FIRST] += 1 << 52
    return packed.astype(np.float64)


def _between(x: np.ndarray, x_root: np.ndarray, y: np.ndarray, y_root: np.ndarray, threshold: int, same: bool = False) -> Iterator[np.ndarray]:
    """Pairs of different roots that have a near pair of ``x`` and ``y``, as rows; rows are sorted by root, and tiles of one root passed over.

    ``same``: ``x`` and ``y`` are one block, of which each pair is compared once.
    """
    x_words, y_words = _columns(x), _columns(y)
    tile = COLUMN_TILE * FIELDS
    left, product = np.ones((ROW_TILE, FIRST + 1)), np.empty(ROW_TILE * COLUMN_TILE)
    for c in range(0, len(y), tile):
        packed, of = None, y_root[c : c + tile]
        for r in range(0, min(len(x), c + tile) if same else len(x), ROW_TILE):
            by = x_root[r : r + ROW_TILE]
            if by[0] == by[-1] == of[0] == of[-1]:
                continue
            if packed is None:
                packed = _packed_columns(y[c : c + tile], threshold)
            m, width = len(by), packed.shape[1]
            left[:m, :FIRST] = np.unpackbits(x[r : r + ROW_TILE, : FIRST // 8], axis=1)
            fields = np.matmul(left[:m], packed, out=product[: m * width].reshape(m, width)).view(np.uint64)
            rows = np.flatnonzero(np.bitwise_or.reduce(fields, axis=1) & _TOP)
            if not len(rows):
                continue
            at, group = np.nonzero(fields[rows] & _TOP)
            field = np.flatnonzero((fields[rows[at], group][:, None] >> np.uint64(8) * np.arange(FIELDS, dtype=np.uint64)) & np.uint64(128))
            a, b = rows[at[field // FIELDS]] + r, group[field // FIELDS] * FIELDS + field % FIELDS + c
            apart = x_root[a] != y_root[b]
            a, b = a[apart], b[apart]
            distance = sum(np.bitwise_count(p[a] ^ q[b]).astype(np.uint16) for p, q in zip(x_words, y_words))
            near = np.stack([x_root[a], y_root[b]], axis=1)[distance <= threshold]
            if len(near):
                yield np.unique(np.sort(near, axis=1), axis=0)


def missed(nodes: DataFrame, n: int, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): the roots of all near pairs of the ``n`` fingerprints (node, fp, root) whose roots differ.

    The fingerprints are dealt to blocks, and a task compares two blocks or one with itself.
    """
    blocks = max(1, min(BLOCKS, n // LEAST), -(-n // BLOCK))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        n_held = 0

        def row(k: int) -> pa.RecordBatch:
            fps, root = (b"".join(x.tobytes() for x in part) for part in zip(*held.pop(k)))
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([fps], pa.binary()), pa.array([root], pa.binary())], ["block", "fps", "roots"])

        for batch in batches:
            block, root = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8)
            order = np.argsort(block, kind="stable")
            for k, first, end in zip(*_runs(block[order])):
                held.setdefault(k, []).append((fps[order[first:end]], root[order[first:end]]))
                n_held += end - first
                if sum(len(part) for _, part in held[k]) >= PIECE:
                    n_held -= sum(len(part) for _, part in held[k])
                    yield row(k)
            if n_held >= BLOCK:
                n_held = 0
                for k in list(held):
                    yield row(k)
        for k in list(held):
            yield row(k)

    def compare(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        same = table.column("low")[0] == table.column("high")[0]
        sides = []
        for k in np.unique(block):
            part = table.filter(pa.array(block == k))
            root = np.frombuffer(b"".join(part.column("roots").to_pylist()), np.int64)
            fps = np.frombuffer(b"".join(part.column("fps").to_pylist()), np.uint8).reshape(-1, BITS // 8)
            order = np.argsort(root, kind="stable")
            sides.append((fps[order], root[order]))
        found = list(_between(*sides[0], *sides[-1], threshold, same)) if same or len(sides) == 2 else []
        both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    pieces = nodes.select(F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), "fp", "root").mapInArrow(pack, "block int, fps binary, roots binary")
    others = pieces.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = others.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fps", "roots")
    # As many partitions as pairs of blocks: a task is long for its few bytes.
    sent = sent.repartition(min(blocks * (blocks + 1) // 2, 4_096), "low", "high")
    return sent.groupBy("low", "high").applyInArrow(compare, "a long, b long").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the least node of its component.

    Large-star and small-star steps in turn, each round written to the shared
    folder in place of the one before, until a round changes nothing; rounds grow
    with the logarithm of the longest path.
    """
    found = written(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if now == state or now[0] == 0:
            break
        state = now
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Every row has a > b here: the larger node passes its least neighbour to all its others.
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        before, found = found, written(small.where("a <> b").distinct(), "edges")
        discard(before)
    return found.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def groups(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, group_id, group_size, n_links and keep: one row for each doc_id, whatever its number of rows.

    group_id is the least doc_id of the connected component of near copies, by every
    pair within the threshold, and the document of that id is kept; n_links is how many other documents it is linked to,
    directly or through others, which is group_size - 1. Exact copies share a
    fingerprint and so a group. A doc_id may be of any type that has an order. Rows
    that share a doc_id are one document, even if their texts differ. Rows with a
    null doc_id are one document for each text; they come after all others, so the
    group_id of a group of such rows alone is null, and one of them is kept. A text
    that is null or blank is a group of its own. Texts are taken whole. Extra
    columns are ignored; an empty table gives no rows.
    """
    found, told = _groups(docs, threshold)
    size = F.coalesce("size", F.lit(1).cast("long"))
    return found.join(told, "fp", "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("group_id"),
        size.alias("group_size"),
        (size - 1).alias("n_links"),
        _is_least().alias("keep"),
    )


def _is_least() -> Column:
    same = F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & F.col("least.text_key").eqNullSafe(F.col("text_key"))
    return F.col("size").isNull() | same


def _groups(docs: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Both written: (doc_id, text_key, fp, rows) of each document, and (fp, least, size) of the groups with copies."""
    key = ["doc_id", "text_key"]
    held = written(fingerprints(docs).groupBy(*key, "fp").agg(F.count(F.lit(1)).alias("rows")), "fingerprints")
    found = written(held.groupBy(*key).agg(F.min("fp").alias("fp"), F.count("fp").alias("fps"), F.sum("rows").alias("rows")), "documents")
    # Documents whose rows have several texts link these texts' fingerprints; mostly there are none.
    many = written(found.where("fps > 1").select(*[F.col(c).alias(f"of_{c}") for c in key], F.col("fp").alias("first")), "many-texts")
    same = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & F.col("text_key").eqNullSafe(F.col("of_text_key"))
    other = written(held.join(many, same).where("fp <> first").select("first", "fp"), "other-texts")
    least = F.struct(F.col("doc_id").isNull().alias("none"), *key)
    source = found.where("fp IS NOT NULL").select("fp", F.lit(1).alias("n"), least.alias("least"))
    source = source.unionByName(other.select("fp", F.lit(0).alias("n"), F.lit(None).cast(source.schema["least"].dataType).alias("least")))
    reps = source.groupBy("fp").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "distinct")
    node = reps.select("node", "fp")
    linked = other.join(node.withColumnsRenamed({"fp": "first", "node": "a"}), "first").join(node.withColumnRenamed("node", "b"), "fp").select("a", "b")
    count = reps.count()
    roots = _joined(node, count, components(near_pairs(node, count, threshold).unionByName(linked)), threshold)
    members = reps.join(roots, "node")
    sums = members.groupBy("root").agg(F.sum("n").alias("size"), F.min("least").alias("least"))
    near = members.select("fp", "root").join(sums, "root").select("fp", "least", "size")
    alone = reps.join(roots, "node", "left_anti").where("n > 1").select("fp", "least", F.col("n").alias("size"))
    told = written(near.unionByName(alone), "groups")
    for table in (held, many, other, reps):
        discard(table)
    return found, told


def _joined(nodes: DataFrame, n: int, roots: DataFrame, threshold: int) -> DataFrame:
    """(node, root) of all components: those of the grids, joined by what ``missed`` finds between them; single nodes are left out."""
    told = written(nodes.join(roots, "node", "left").select("node", "fp", "root"), "roots")
    own = F.coalesce("root", "node")
    over = components(missed(told.select("node", "fp", own.alias("root")), n, threshold)).select(F.col("node").alias("of"), F.col("root").alias("over"))
    both = told.join(over, own == F.col("of"), "left")
    return both.select("node", F.coalesce("over", "root").alias("root")).where("root IS NOT NULL")


def deduplicate(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: one row of each group stays.

    The document that ``groups`` keeps stays. Of rows that share a doc_id, or a text and
    a null doc_id, the one of least text stays. Null and blank texts stay, one row for
    each doc_id. What becomes of the documents that go or have several rows is decided
    on ids and fingerprints and joined to the rows once.
    """
    doc_id, text_key_, keep, rows, turn = (f"__plumbline_{x}" for x in ("doc_id", "text_key", "keep", "rows", "turn"))
    found, told = _groups(docs, threshold)
    acts = found.join(told, "fp", "left").select(F.col("doc_id").alias(doc_id), F.col("text_key").alias(text_key_), _is_least().alias(keep), F.col("rows").alias(rows))
    acts = written(acts.where(~F.col(keep) | (F.col(rows) > 1)), "copies")
    own = text_key(F.col("doc_id"), F.col("text").cast("string"))
    both = docs.join(acts, F.col("doc_id").eqNullSafe(F.col(doc_id)) & own.eqNullSafe(F.col(text_key_)), "left")
    first = Window.partitionBy(doc_id, text_key_).orderBy("text")
    twice = both.where(keep).withColumn(turn, F.row_number().over(first)).where(F.col(turn) == 1)
    return both.where(F.col(keep).isNull()).select(*docs.columns).unionByName(twice.select(*docs.columns))
