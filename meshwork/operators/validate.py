"""Checks as violation frames: (rule, order_key, entity_id, detail); empty means valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, rule: str, bad: Column, entity: str, order: Column, phase: int, detail: Column | None = None) -> DataFrame:
    """Rows for which ``bad`` holds. order_key sorts as the checks are made: phase, place of the row, rule."""
    key = F.struct(F.lit(phase).alias("phase"), order.cast("bigint").alias("place"), F.lit(rule).alias("rule"))
    about = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return rows.where(bad).select(F.lit(rule).alias("rule"), key.alias("order_key"), F.col(entity).cast("bigint").alias("entity_id"), about.alias("detail"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def first_violation(frame: DataFrame) -> DataFrame:
    """The violation that a check in order would meet first; no row when there is none."""
    first = frame.agg(F.min_by(F.struct("rule", "entity_id", "detail"), "order_key").alias("v"))
    return first.where("v is not null").select("v.*")


def require_valid(frame: DataFrame) -> None:
    """Raises the first violation before anything is written."""
    row = first_violation(frame).first()
    if row:
        raise ValueError(f"{row.rule}({row.entity_id}{'' if row.detail is None else ', ' + row.detail})")


def non_finite(*columns: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in columns])


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key no row of ``others`` has."""
    return rows.join(others.select(F.col(other_key).alias(key)).distinct(), key, "left_anti")


def snapshot_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All rules of a graph snapshot; nodes (ord, id, x, y, z, radius, color) before edges (ord, id, source, target, width, color)."""
    color_bad = F.exists("color", lambda c: F.isnan(c) | (F.abs(c) == float("inf")))
    bad_node = non_finite(F.col("x"), F.col("y"), F.col("z"), F.col("radius")) | (F.col("radius") < 0) | color_bad
    bad_edge = non_finite(F.col("width")) | (F.col("width") < 0) | color_bad
    again = lambda df: df.join(df.groupBy("id").agg(F.min("ord").alias("first")), "id").where("ord > first")
    return union(
        [
            violations(nodes, "InvalidNodeVisual", bad_node, "id", F.col("ord"), 0),
            violations(again(nodes), "DuplicateNode", F.lit(True), "id", F.col("ord"), 0),
            violations(edges, "InvalidEdgeVisual", bad_edge, "id", F.col("ord"), 1),
            violations(again(edges), "DuplicateEdge", F.lit(True), "id", F.col("ord"), 1),
            violations(missing(edges, "source", nodes, "id"), "MissingSourceNode", F.lit(True), "id", F.col("ord"), 1, F.col("source")),
            violations(missing(edges, "target", nodes, "id"), "MissingTargetNode", F.lit(True), "id", F.col("ord"), 1, F.col("target")),
        ]
    )
