"""Embedding near-duplicates: exact threshold pairs by a cover-tree dual traversal.

Unit vectors with cosine of at least c lie within the distance sqrt(2 - 2c), so
pairs are found in metric terms and confirmed by the cosine in double precision.

1. Equal vectors become one point with a multiplicity; only points of one
   length meet in what follows.
2. The top of the tree: pivots from a bounded seeded sample of each length. A
   point's home is the cell of its nearest pivot, and it also visits the cells whose
   bisecting plane is near enough that a partner may live behind it.
3. A cell's points are dealt by a hash to tiles of bounded size, each stored once in
   the shared folder; a task gets the names of pairs of tiles whose cells visit each other, a block of
   few tiles by few, reads these, builds their nested levels with halving radii,
   and walks pairs of nodes, dropping those whose centres are farther apart
   than their covering radii and the threshold allow. Bounds are taken in
   single precision with a margin above its error; points of node pairs at the bottom
   alone are compared themselves, in double precision at last.
4. Tasks give link counts and the edges of a spanning forest, never all pairs.

Every point is indexed; the sample only places pivots, and a bad sample costs
time, not links.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components have no link and are their own component; so do rows without
vec_id, which no link can name. Vectors of different
lengths are never linked; repeated rows with one vec_id are points of their own that share the
id; an empty table gives no rows. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, map_batches, new_path, read_table, skewed_join, written

MAX_PIVOTS = 1_024
#: Points that a pivot should have at least, so small tables get few cells.
CELL_POINTS = 8_192
TILE_POINTS = 8_192
LEAF_POINTS = 48
#: Distances that are held at once, and linked pairs.
BLOCK_DISTANCES = 1_000_000
BLOCK_PAIRS = 500_000
#: Points whose balls are drawn at once.
SAMPLE = 128
#: Above the error of a cosine in single precision.
MARGIN = 1e-4
#: Tiles a side of a block of pairs, whose trees a task keeps; smaller while there are few blocks.
BLOCK_TILES = 8
SPREAD = 24
MAX_TASKS = 20_000
SEED = 9
NONE = np.zeros(0, dtype=np.int64)
EMPTY_TILE = pa.table({"unit": pa.array([], pa.binary()), "point": pa.array([], pa.int64()), "copies": pa.array([], pa.int64())})


class CoverTree:
    """Nested levels over unit vectors: a node's children lie within its radius, and radii halve downwards.

    The last level is the one whose radii fall under half the reach: points of
    such a node, or of two such neighbours, are all about as near as the
    threshold asks, so they are compared themselves. A node that holds its centre alone
    has radius 0 and no levels below it.
    """

    def __init__(self, points: np.ndarray, reach: float):
        self.points = points
        self.rough = points.astype(np.float32)
        self.reach = reach
        self.centres: list[int] = []
        self.radii: list[float] = []
        self.children: list[np.ndarray] = []
        self.members: list[np.ndarray] = []
        self._grow(np.arange(len(points)), 0)

    def _node(self, at: np.ndarray, centre: int, radius: float) -> int:
        self.centres.append(centre)
        self.radii.append(radius)
        self.children.append(NONE)
        self.members.append(at)
        return len(self.radii) - 1

    def _grow(self, at: np.ndarray, centre: int) -> int:
        me = self._node(at, centre, float(_apart(self.points[at], self.points[[centre]])[:, 0].max()))
        if len(at) > LEAF_POINTS and self.radii[me] > self.reach / 2:
            parts = self._balls(at, self.radii[me] / 2)
            if len(parts) > 1:
                # most balls of scattered points hold their centre alone
                self.children[me] = np.array([self._grow(part, c) if len(part) > 1 else self._node(part, c, 0.0) for c, part in parts])
        return me

    def _balls(self, at: np.ndarray, half: float) -> list[tuple[int, np.ndarray]]:
        """Covers the points by balls whose centres are farther apart than their radius."""
        parts = []
        while len(at):
            some = at[:SAMPLE]
            # which ball takes a point is free; radii are measured afterwards
            near = self.rough[at] @ self.rough[some].T >= 1.0 - half * half / 2
            near[np.arange(len(some)), np.arange(len(some))] = True
            chosen, covered = [], np.zeros(len(some), dtype=bool)
            for k in range(len(some)):
                if not covered[k]:
                    chosen.append(k)
                    covered |= near[: len(some), k]
            within = near[:, chosen]
            taken, ball = within.any(1), within.argmax(1)
            ball[chosen] = np.arange(len(chosen))
            order = np.argsort(ball[taken], kind="stable")
            groups = np.split(at[taken][order], np.cumsum(np.bincount(ball[taken], minlength=len(chosen)))[:-1])
            parts += [(int(some[k]), g) for k, g in zip(chosen, groups)]
            at = at[~taken]
        return parts


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    found = x @ y.T
    found *= -2.0
    found += 2.0
    np.maximum(found, 0.0, out=found)
    return np.sqrt(found, out=found)


def dual_pairs(a: CoverTree, b: CoverTree) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Points that may be linked; for one tree with itself, each unordered pair of nodes once.

    Yields two lists of points of which each of the one may be linked with each of the
    other (False), or two lists of pairs (True): nodes that hold one point.
    """
    same = a is b
    radii_a, radii_b = np.array(a.radii), np.array(b.radii)
    centres_a, centres_b = a.rough[a.centres], b.rough[b.centres]
    points_a, points_b = np.array(a.centres), np.array(b.centres)
    alone_a, alone_b = (np.array([len(m) == 1 for m in t.members]) for t in (a, b))
    slack = a.reach + 1e-6
    # a distance is at most s where the cosine is at least 1 - s * s / 2
    least = lambda s: 1.0 - s * s / 2 - MARGIN
    stack = [(0, 0)]
    while stack:
        x, y = stack.pop()
        cx, cy = a.children[x], b.children[y]
        if not len(cx) and not len(cy):
            yield a.members[x], b.members[y], False
            continue
        cx = cx if len(cx) else np.array([x])
        cy = cy if len(cy) else np.array([y])
        step = max(1, BLOCK_DISTANCES // len(cy))
        for at in range(0, len(cx), step):
            some = cx[at : at + step]
            cosine = centres_a[some] @ centres_b[cy].T
            i, j = np.nonzero(cosine >= least(radii_a[some].max() + radii_b[cy].max() + slack))
            near = cosine[i, j] >= least(radii_a[some][i] + radii_b[cy][j] + slack)
            if same and x == y:
                near &= j >= i + at
            i, j = some[i[near]], cy[j[near]]
            one = alone_a[i] & alone_b[j]
            if one.any():
                yield points_a[i[one]], points_b[j[one]], True
            stack += zip(i[~one].tolist(), j[~one].tolist())


def link_tiles(left: CoverTree | np.ndarray, right: CoverTree | np.ndarray | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine of at least ``least``: within ``left``, or between ``left`` and ``right``."""
    if any(isinstance(side, np.ndarray) and not len(side) for side in (left, right)):
        return
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * least))
    grown = lambda side: CoverTree(side, reach) if isinstance(side, np.ndarray) else side
    a = grown(left)
    b = a if right is None else grown(right)
    for x, y, paired in dual_pairs(a, b):
        step = len(x) if paired else max(1, BLOCK_DISTANCES // len(y))
        for at in range(0, len(x), step):
            if paired:
                i, j = x, y
            else:
                i, j = np.nonzero(a.rough[x[at : at + step]] @ b.rough[y].T >= least - MARGIN)
                i, j = x[at + i], y[j]
            if right is None and (paired or x is y):
                once = i != j if paired else i < j
                i, j = i[once], j[once]
            exact = np.concatenate([np.zeros(0, dtype=bool)] + [(a.points[i[k : k + step]] * b.points[j[k : k + step]]).sum(1) >= least for k in range(0, len(i), step)])
            i, j = i[exact], j[exact]
            if len(i):
                yield i, j


def _unit(vector: list | None) -> np.ndarray | None:
    if not vector or any(x is None for x in vector):
        return None
    v = np.asarray(vector, dtype=np.float64)
    size = np.abs(v).max()
    if not np.isfinite(v).all() or size == 0.0:
        return None
    v = v / size  # keeps squares in range
    return v / np.sqrt((v * v).sum())


def unite(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> None:
    """Joins the pairs in ``label``, in which every index names the least of its component."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label[:] = label[label]


def tile_links(units: np.ndarray, copies: np.ndarray, p: np.ndarray, q: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each point and labels of components: within ``p``, or between ``p`` and ``q``."""
    return tree_links(units[p], None if q is None else units[q], copies, p, q, least)


def tree_links(
    a: CoverTree | np.ndarray, b: CoverTree | np.ndarray | None, copies: np.ndarray, p: np.ndarray, q: np.ndarray | None, least: float
) -> tuple[np.ndarray, np.ndarray]:
    """As ``tile_links``, of points or trees; ``p`` and ``q`` are the places of their points among all."""
    links, label = np.zeros(len(copies), dtype=np.int64), np.arange(len(copies))
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []

    def count() -> None:
        i, j = np.concatenate(left), np.concatenate(right)
        for x, y in ((i, j), (j, i)):
            links[:] += np.bincount(x, copies[y], len(copies)).astype(np.int64)
        unite(i, j, label)
        left.clear()
        right.clear()

    held = 0
    for i, j in link_tiles(a, b, least):
        left.append(p[i])
        right.append((p if q is None else q)[j])
        held += len(i)
        if held >= BLOCK_PAIRS:
            count()
            held = 0
    if left:
        count()
    return links, label


def _pivots(points: DataFrame, seed: int) -> dict[int, np.ndarray]:
    """Pivots of each width from a sample that is bounded by ``MAX_PIVOTS``; one row a width is counted on the driver."""
    sizes = {r.width: r for r in points.groupBy("width").agg(F.count("*").alias("n"), F.min("unit").alias("first")).collect()}
    wanted = {w: max(1, min(MAX_PIVOTS, r.n // CELL_POINTS)) for w, r in sizes.items()}
    if not sizes:
        return {}
    shares = points.sparkSession.createDataFrame([(w, 4.0 * wanted[w] / r.n) for w, r in sizes.items() if wanted[w] > 1], "width int, share double")
    place = F.xxhash64("unit", F.lit(seed)).cast("double") / 2.0**64 + 0.5
    found: dict[int, list[bytes]] = {}
    for r in points.join(F.broadcast(shares), "width").where(place < F.col("share")).select("width", "unit").collect():
        found.setdefault(r.width, []).append(bytes(r.unit))
    chosen = {w: sorted(found.get(w, [bytes(r.first)]))[: wanted[w]] for w, r in sizes.items()}
    return {w: np.array([np.frombuffer(u, dtype=np.float64) for u in units]) for w, units in chosen.items()}


def near_vectors(rows: DataFrame, least: float = 0.95, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``rows`` (vec_id, embedding)."""
    vectors = rows.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("embedding"))

    def normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, units = [], []
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                unit = None if vec_id is None else _unit(vector)
                ids.append(vec_id)
                units.append(None if unit is None else unit.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(units, pa.binary())], names=["vec_id", "unit"])

    spark = rows.sparkSession
    every = written(map_batches(vectors, normalised, "vec_id bigint, unit binary").withColumn("mark", F.unhex(F.sha2("unit", 256))), "units")
    points = every.where("unit is not null and vec_id is not null").groupBy("unit").agg(F.min("vec_id").alias("point"), F.count("*").alias("copies"))
    points = written(points.withColumn("width", (F.octet_length("unit") / 8).cast("int")), "points")
    pivots = _pivots(points, seed)
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * least)) + 1e-9

    def measured(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Rows of each width, their home cells, and which cells each one visits."""
        widths = batch.column(3).to_numpy(zero_copy_only=False)
        for width in np.unique(widths):
            table = pivots[int(width)]
            between = np.sqrt(np.maximum(2.0 - 2.0 * table @ table.T, 0.0))
            part = batch.take(pa.array(np.flatnonzero(widths == width)))
            x = np.frombuffer(b"".join(part.column(0).to_pylist()), dtype=np.float64).reshape(-1, width)
            squared = np.maximum(2.0 - 2.0 * x @ table.T, 0.0)
            home = squared.argmin(1)
            own = squared[np.arange(len(x)), home]
            # distance from the plane between the home pivot and another one
            gap = between[home]
            plane = (squared - own[:, None]) / np.maximum(2.0 * gap, 1e-12)
            yield int(width), part, home, (plane <= reach) | (gap < 1e-9)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part, home, _ in measured(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home.astype(np.int64))], names=["unit", "point", "copies", "width", "cell"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, home, visits in measured(batch):
                seen = met.setdefault(width, np.zeros((len(pivots[width]),) * 2, dtype=bool))
                for cell in np.unique(home):
                    seen[cell] |= visits[home == cell].any(0)
        for width, seen in met.items():
            low, high = np.nonzero(np.triu(seen | seen.T, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(low), width), pa.int32()), pa.array(low), pa.array(high)], names=["width", "a_cell", "b_cell"])

    rows = points.select("unit", "point", "copies", "width")
    placed = map_batches(rows, place, "unit binary, point bigint, copies bigint, width int, cell bigint")
    sizes = placed.groupBy("width", "cell").agg(F.ceil(F.count("*") / TILE_POINTS).alias("tiles"))
    sizes = written(sizes, "cells")  # MAX_PIVOTS for each width at most
    n_tiles = sizes.agg(F.sum("tiles")).first()[0] or 1
    placed = placed.join(F.broadcast(sizes), ["width", "cell"]).withColumn("tile", F.pmod(F.xxhash64("point"), F.col("tiles"))).drop("tiles")
    folder = new_path(spark, "tiles")
    # one folder a tile: each point is stored once, however many tiles its own is compared with
    placed.repartition(int(min(MAX_TASKS, n_tiles)), "width", "cell", "tile").write.partitionBy("width", "cell", "tile").parquet(folder)
    tiles = sizes.select("width", "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("tile"))
    step = int(max(1, min(BLOCK_TILES, n_tiles // SPREAD)))
    number = F.row_number().over(Window.partitionBy("width").orderBy("cell", "tile")) - 1
    tiles = written(tiles.withColumn("block", F.floor(number / step)), "tile-blocks")
    side = lambda name: tiles.select("width", *(F.col(c).alias(f"{name}_{c}") for c in ("cell", "tile", "block")))
    alone = side("a").join(side("b"), "width").where((F.col("a_cell") == F.col("b_cell")) & (F.col("a_tile") <= F.col("b_tile")))
    visits = map_batches(rows, visit, "width int, a_cell bigint, b_cell bigint").distinct()
    apart = visits.join(side("a"), ["width", "a_cell"]).join(side("b"), ["width", "b_cell"])
    columns = ["width", "a_cell", "a_tile", "a_block", "b_cell", "b_tile", "b_block"]
    tasks = written(alone.select(*columns).unionByName(apart.select(*columns)), "tile-pairs")
    names = ["width", "a_block", "b_block"]
    n_blocks = tasks.select(*names).distinct().count()

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        width = int(key[0])
        system, root = fs.FileSystem.from_uri(folder)
        held: dict[tuple[int, int], tuple[CoverTree, np.ndarray, np.ndarray]] = {}

        def tile(cell: int, number: int) -> tuple[CoverTree, np.ndarray, np.ndarray]:
            if (cell, number) not in held:
                path = f"{root}/width={width}/cell={cell}/tile={number}"
                # a hash may leave a tile without points
                empty = system.get_file_info(path).type == fs.FileType.NotFound
                table = EMPTY_TILE if empty else pq.read_table(path, columns=["unit", "point", "copies"], filesystem=system, partitioning=None)
                table = table.sort_by("point")
                units = np.frombuffer(b"".join(table["unit"].to_pylist()), dtype=np.float64).reshape(-1, width)
                tree = CoverTree(units, math.sqrt(max(0.0, 2.0 - 2.0 * least))) if len(units) else None
                held[cell, number] = tree, table["point"].to_numpy(), table["copies"].to_numpy()
            return held[cell, number]

        out = []
        for a_cell, a_tile, b_cell, b_tile in zip(*(pdf[c].tolist() for c in ("a_cell", "a_tile", "b_cell", "b_tile"))):
            first, second = tile(a_cell, a_tile), tile(b_cell, b_tile)
            if first[0] is None or second[0] is None:
                continue
            alone = first is second
            points, copies = (first[1], first[2]) if alone else (np.concatenate([first[k], second[k]]) for k in (1, 2))
            # a label is the least index of a component, so points ascend
            order = np.argsort(points, kind="stable")
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            n = len(first[1])
            links, label = tree_links(first[0], None if alone else second[0], copies[order], rank[:n], None if alone else rank[n:], least)
            found = np.flatnonzero(links)
            out.append(pd.DataFrame({"point": points[order][found], "links": links[found], "to": points[order][label[found]]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"point": NONE, "links": NONE, "to": NONE})

    # blocks of pairs of tiles are the units of work: dealt to as many tasks, none of which is worth merging with another
    dealt = tasks.repartition(int(min(MAX_TASKS, max(1, n_blocks))), *names)
    linked = written(dealt.groupBy(*names).applyInPandas(link, "point bigint, links bigint, to bigint"), "links")
    totals = linked.groupBy("point").agg(F.sum("links").alias("links"))
    parts = components(linked.select(F.col("point").alias("a"), F.col("to").alias("b")), "vectors")
    named = points.join(totals, "point", "left").join(parts.withColumnRenamed("node", "point"), "point", "left")
    named = named.select(F.unhex(F.sha2("unit", 256)).alias("mark"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "point").alias("component"))
    # results find their rows by a digest of the vector, which is a sixteenth of it
    joined = skewed_join(every.select("vec_id", "mark"), written(named, "named"), "mark", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
