"""Polylines: variable-length point lists of strokes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_points(ranges: DataFrame, points: DataFrame, key: str = "stroke") -> DataFrame:
    """One row a stroke with its points, from (key, first_point, point_count) and (point, x, y, z).

    Points find their stroke by the numbers in its range, so nothing but a stroke's own points is gathered.
    """
    wanted = ranges.select(key, F.explode(F.sequence(F.col("first_point"), F.col("first_point") + F.col("point_count") - 1)).alias("point"))
    joined = wanted.join(points, "point")
    rows = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("point", "x", "y", "z"))).alias("p"))
    return rows.select(key, F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))).alias("points"))


def range_violations(ranges: DataFrame, n_points: int) -> DataFrame:
    """Ranges that reach beyond the points."""
    return ranges.where((F.col("first_point") < 0) | (F.col("first_point") + F.col("point_count") > n_points))


def edge_paths(edges: DataFrame, layout: DataFrame, style: str) -> DataFrame:
    """(slot, points) of edges (slot, source, target as node slots): straight 2, curved 3 or bundled 4 points.

    A curve bends by a small amount that the edge's slot fixes; a bundle runs
    through the first node of each end's hundred.
    """
    at = lambda name: layout.select(F.col("slot").alias(name), F.struct("x", "y", "z").alias(f"{name}_at"))
    rows = edges.select("slot", "source", "target").join(at("source"), "source").join(at("target"), "target")
    ends = (F.col("source_at"), F.col("target_at"))
    if style == "straight":
        return rows.select("slot", F.array(*ends).alias("points"))
    if style == "curved":
        bend = F.col("slot") % 17 * F.lit(0.035) - 0.28
        shift = {"x": -bend, "y": bend, "z": bend * 0.5}
        middle = F.struct(*(((ends[0][a] + ends[1][a]) * 0.5 + shift[a]).alias(a) for a in "xyz"))
        return rows.select("slot", F.array(ends[0], middle, ends[1]).alias("points"))
    if style == "bundled":
        hub = lambda end: F.floor(F.col(end) / 100) * 100
        rows = rows.withColumn("hub_a", hub("source")).withColumn("hub_b", hub("target")).join(at("hub_a"), "hub_a").join(at("hub_b"), "hub_b")
        return rows.select("slot", F.array(ends[0], F.col("hub_a_at"), F.col("hub_b_at"), ends[1]).alias("points"))
    raise ValueError(f"unknown path style {style}")
