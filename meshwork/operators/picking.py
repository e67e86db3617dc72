"""Many rays against many nodes.

Nodes are stored in blocks of bounded size; rays are dealt to tasks, and a task walks the tree of each block
with all its rays at once. So a ray is shuffled once, however many nodes it passes.

More nodes than tasks should read one block after another meet rays through a uniform grid:
nodes lie in the cells that their balls touch, two an axis at most; a ray is walked
slab by slab along its steepest axis, where it touches few cells of each slab. Rays
and nodes meet by cell, and crowded cells are dealt to several tasks.
A pair is tested in the one cell that holds the ray's nearest point to the node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.sources.shared import map_batches, new_path

from .balltree import BallTree
from .dealing import BOUND, dealt_join, stored
from .validate import non_finite

#: Cells an axis at most, and cells a node on average.
MOST_CELLS = 1 << 20
CELLS_PER_NODE = 1.0
#: Nodes of a block, which a task holds at once, and how many such blocks rays pass at most.
BLOCK_CELLS = 500_000
MOST_BLOCKS = 64
#: Rays that walk a tree at once.
WALK_RAYS = 300_000
#: Rays that a task gets at most and at least, on average; between these, rays are dealt to so many tasks.
MOST_RAYS, LEAST_RAYS, SPREAD = 200_000, 5_000, 24
#: Rays a line from which on each line is walked once for all its rays.
REPEATS = 4
#: Share of a cell by which touching is widened against rounding.
SLACK = 1e-6
AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Grid:
    """Equal cells over the nodes' box: low corner, cell size and cells along each axis."""

    low: tuple[float, float, float]
    size: float
    cells: tuple[int, int, int]

    @staticmethod
    def over(nodes: DataFrame) -> Grid | None:
        """Cells are as wide as the largest ball at least; one row of bounds is read."""
        box = nodes.agg(
            F.count("*").alias("n"), F.max("radius").alias("radius"), *(F.min(F.col(a) - F.col("radius")).alias(f"low_{a}") for a in AXES), *(F.max(F.col(a) + F.col("radius")).alias(f"high_{a}") for a in AXES)
        ).first()
        if not box.n:
            return None
        low = tuple(box[f"low_{a}"] for a in AXES)
        extent = [box[f"high_{a}"] - at for a, at in zip(AXES, low)]
        volume = 1.0
        for e in extent:
            volume *= max(e, 1e-9)
        size = max(2.0 * box.radius, (volume / (CELLS_PER_NODE * box.n)) ** (1 / 3), max(extent) / MOST_CELLS, 1e-9)
        return Grid(low, size, tuple(int(e // size) + 1 for e in extent))

    def cell(self, axis: int, at: Column, by: float = 0.0) -> Column:
        """The cell's number along an axis, within the grid; ``by`` moves the place by a share of a cell."""
        number = F.floor((at - F.lit(self.low[axis])) / F.lit(self.size) + F.lit(by))
        return F.greatest(F.lit(0), F.least(number, F.lit(self.cells[axis] - 1))).cast("bigint")

    def number(self, cells: list[Column]) -> Column:
        return (cells[0] * self.cells[1] + cells[1]) * self.cells[2] + cells[2]


def node_cells(nodes: DataFrame, grid: Grid) -> DataFrame:
    """Each node in every cell that its ball touches."""
    out = nodes
    for k, a in enumerate(AXES):
        first, last = grid.cell(k, F.col(a) - F.col("radius"), -SLACK), grid.cell(k, F.col(a) + F.col("radius"), SLACK)
        out = out.withColumn(f"_{a}", F.explode(F.sequence(first, last)))
    return out.withColumn("_cell", grid.number([F.col(f"_{a}") for a in AXES])).drop("_x", "_y", "_z")


def ray_cells(rays: DataFrame, grid: Grid) -> DataFrame:
    """Each ray (origin ox, oy, oz; unit direction dx, dy, dz) in every cell that it touches."""
    steep = [F.abs(f"d{a}") for a in AXES]
    most = F.greatest(*steep)
    main = F.when(steep[0] == most, 0).when(steep[1] == most, 1).otherwise(2)
    rays = rays.where(most > 0).withColumn("_main", main)
    parts = []
    for u in range(3):
        v, w = (u + 1) % 3, (u + 2) % 3
        origin, towards = [[F.col(f"{kind}{AXES[k]}") for k in (u, v, w)] for kind in "od"]
        low, high = F.lit(grid.low[u]), F.lit(grid.low[u] + grid.size * grid.cells[u])
        begin = F.when(towards[0] > 0, F.greatest(origin[0], low)).otherwise(low)
        end = F.when(towards[0] > 0, high).otherwise(F.least(origin[0], high))
        mine = rays.where((F.col("_main") == u) & (begin <= end))
        slab = F.explode(F.sequence(grid.cell(u, begin, -SLACK), grid.cell(u, end, SLACK)))
        mine = mine.withColumn("_u", slab)
        # where the ray is within the slab, a little widened; it begins at its origin
        edges = [low + (F.col("_u") - SLACK) * grid.size, low + (F.col("_u") + (1 + SLACK)) * grid.size]
        times = [F.greatest((e - origin[0]) / towards[0], F.lit(0.0)) for e in edges]
        for k, axis in ((1, v), (2, w)):
            at = [origin[k] + t * towards[k] for t in times]
            least, largest = F.least(*at), F.greatest(*at)
            mine = mine.where((largest >= grid.low[axis] - SLACK * grid.size) & (least <= grid.low[axis] + grid.size * (grid.cells[axis] + SLACK)))
            mine = mine.withColumn(f"_{k}", F.explode(F.sequence(grid.cell(axis, least, -SLACK), grid.cell(axis, largest, SLACK))))
        named = {u: F.col("_u"), v: F.col("_1"), w: F.col("_2")}
        parts.append(mine.withColumn("_cell", grid.number([named[k] for k in range(3)])).drop("_u", "_1", "_2", "_main"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def tested_pairs(nodes: DataFrame, rays: DataFrame, grid: Grid, bound: int = BOUND) -> DataFrame:
    """Rays and nodes that meet: ray_id, id, depth along the ray and hits.

    The nodes of one block that a ray meets are one row, with the nearest of them and how many these are. Beyond
    ``MOST_BLOCKS`` blocks, both sides are shuffled by cell, and each pair is a row.
    """
    nodes = nodes.select(F.col("id").cast("bigint").alias("id"), *(F.col(c).cast("double").alias(c) for c in (*AXES, "radius")), F.col("_copies") if "_copies" in nodes.columns else F.lit(1).cast("bigint").alias("_copies"))
    blocks = -(-nodes.count() // BLOCK_CELLS)
    if blocks <= MOST_BLOCKS:
        return _walked(nodes, rays, max(blocks, 1))
    met = dealt_join(stored(node_cells(nodes, grid), "node-cells"), ray_cells(rays, grid), ["_cell"], bound)
    offset = [F.col(a) - F.col(f"o{a}") for a in AXES]
    dot = lambda xs, ys: xs[0] * ys[0] + xs[1] * ys[1] + xs[2] * ys[2]
    met = met.withColumn("depth", dot(offset, [F.col(f"d{a}") for a in AXES]))
    met = met.withColumn("away", dot(offset, offset) - F.col("depth") * F.col("depth"))
    nearest = grid.number([grid.cell(k, F.col(f"o{a}") + F.col("depth") * F.col(f"d{a}")) for k, a in enumerate(AXES)])
    hit = met.where((F.col("_cell") == nearest) & (F.col("depth") > 0) & (F.col("away") <= F.col("radius") * F.col("radius")))
    return hit.select("ray_id", "id", "depth", F.col("_copies").alias("hits"))


def _walked(nodes: DataFrame, rays: DataFrame, blocks: int) -> DataFrame:
    """Each block is stored once and read by every task, which holds one block and about ``WALK_RAYS`` rays at a time."""
    folder = new_path(nodes.sparkSession, "node-blocks")
    block = F.pmod(F.xxhash64(*AXES, "radius"), F.lit(blocks))
    nodes.withColumn("_block", block).repartition(blocks, "_block").write.partitionBy("_block").parquet(folder)
    tasks = max(-(-(n := rays.count()) // MOST_RAYS), min(SPREAD, -(-n // LEAST_RAYS)), 1)

    def tree(k: int) -> BallTree | None:
        system, root = fs.FileSystem.from_uri(folder)
        path = f"{root}/_block={k}"
        # a hash may leave a block without nodes
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        held = pq.read_table(path, filesystem=system, partitioning=None)
        column = lambda name: held[name].to_numpy()
        return BallTree(column("id"), np.stack([column(a) for a in AXES], axis=1), column("radius"), column("_copies"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, BallTree | None] = -1, None
        for some in _gathered(batches):
            lines = np.stack([some[c].to_numpy() for c in some.column_names[1:]], axis=1)
            there = np.flatnonzero(np.isfinite(lines).all(1))  # nulls are no numbers here
            ids, origin, towards = some["ray_id"].take(pa.array(there)), lines[there, :3], lines[there, 3:]
            for k in range(blocks):
                last = last if last[0] == k else (k, tree(k))
                if last[1] is None or not len(there):
                    continue
                with np.errstate(all="ignore"):
                    found = dict(zip(("id", "depth", "hits"), last[1].pick(origin, towards)))
                met = np.flatnonzero(found["hits"])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(met)).combine_chunks(), *(pa.array(c[met]) for c in found.values())], names=["ray_id", *found])

    dealt = rays.select("ray_id", *(F.col(f"{kind}{a}").cast("double") for kind in "od" for a in AXES)).repartition(tasks, "ray_id")
    kind = rays.schema["ray_id"].dataType.simpleString()
    return map_batches(dealt, walk, f"ray_id {kind}, id bigint, depth double, hits bigint")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= WALK_RAYS:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def pick_along_rays(nodes: DataFrame, rays: DataFrame, bound: int = BOUND) -> DataFrame:
    """For each ray (ray_id, origin, unit direction) that meets a node (id, x, y, z, radius): the nearest node, its depth and how many it meets.

    A node counts when it lies ahead of the origin and the ray passes within its radius. Of equally near
    nodes the one with the smallest id is picked.
    """
    # what is nowhere is met by no ray
    nodes = nodes.where(~non_finite(*(F.col(a) for a in AXES)) & F.col("radius").isNotNull())
    grid = Grid.over(nodes)
    if grid is None:
        return rays.where("false").select("ray_id", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("double").alias("depth"), F.lit(0).cast("bigint").alias("hits"))
    lines = [f"{k}{a}" for k in "od" for a in AXES]
    rays = rays.select("ray_id", *lines)
    size = rays.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(*lines)).alias("kinds")).first()
    if size.n < REPEATS * size.kinds:
        return _picked(nodes, rays, grid, bound)
    # rays that run along one line meet the same
    once = stored(rays.groupBy(*lines).agg(F.min("ray_id").alias("ray_id")), "lines")
    told = stored(once.join(_picked(nodes, once, grid, bound), "ray_id").drop("ray_id"), "line-picks")
    told = F.broadcast(told) if told.count() <= BLOCK_CELLS else told
    return rays.join(told, lines).select("ray_id", "id", "depth", "hits")


def _picked(nodes: DataFrame, rays: DataFrame, grid: Grid, bound: int) -> DataFrame:
    # balls that are equal are met once
    balls = nodes.groupBy(*AXES, "radius").agg(F.min("id").alias("id"), F.count("*").alias("_copies"))
    met = tested_pairs(balls, rays, grid, bound)
    return met.groupBy("ray_id").agg(F.min_by("id", F.struct("depth", "id")).alias("id"), F.min("depth").alias("depth"), F.sum("hits").alias("hits"))
