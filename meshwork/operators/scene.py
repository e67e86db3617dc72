"""Assembling scenes from pages and answering view queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.functions.masks import edge_visible, node_visible
from meshwork.types import View


def assemble_nodes(identity: DataFrame, style: DataFrame, positions: DataFrame, manifold: str) -> DataFrame:
    """One row per slot from three pages; only the wanted layout's partition is read."""
    return identity.join(style, "slot").join(positions.where(F.col("manifold") == manifold).drop("manifold"), "slot")


def endpoint_slots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with source_slot and target_slot; edges without both endpoints do not appear."""
    ids = nodes.select("id", "slot")
    source = ids.select(F.col("id").alias("source"), F.col("slot").alias("source_slot"))
    target = ids.select(F.col("id").alias("target"), F.col("slot").alias("target_slot"))
    return edges.join(source, "source").join(target, "target")


def switch_layout(state: DataFrame, positions: DataFrame, manifold: str) -> DataFrame:
    """The same rows and slots with another layout's coordinates."""
    return state.drop("x", "y", "z").join(positions.where(F.col("manifold") == manifold).select("slot", "x", "y", "z"), "slot")


def visible_nodes(nodes: DataFrame, view: View, indexed: bool = True) -> DataFrame:
    return nodes.where(node_visible(view, indexed))


def visible_edges(edges: DataFrame, view: View, indexed: bool = True) -> DataFrame:
    return edges.where(edge_visible(view, indexed))


def packed_flags(kind: Column, flags: Column, hovered: Column, selected: Column) -> Column:
    """Kind in the high half-word; hover and selection are bits 0 and 1 of the flags."""
    low = flags.cast("bigint").bitwiseOR(hovered.cast("bigint")).bitwiseOR(F.shiftleft(selected.cast("bigint"), 1))
    return F.shiftleft(kind.cast("bigint"), 16).bitwiseOR(low)


def project_dirty(state: DataFrame, dirty: DataFrame) -> DataFrame:
    """A row for each dirty slot: the live row, or a tombstone of zeros where the slot is empty."""
    joined = dirty.select("slot").distinct().join(state, "slot", "left")
    live = F.col("id").isNotNull()
    return joined.select("slot", live.alias("live"), *(F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) for c, t in state.dtypes if c != "slot"))


def page_inventory(positions: DataFrame) -> DataFrame:
    """Rows per layout; a scene is whole when all counts are equal."""
    return positions.groupBy("manifold").agg(F.count("*").alias("nodes"))


def identity_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Slots at which two pages (slot, id) name different ids or only one has a row."""
    a, b = left.select("slot", F.col("id").alias("left_id")), right.select("slot", F.col("id").alias("right_id"))
    return a.join(b, "slot", "full_outer").where(~F.col("left_id").eqNullSafe(F.col("right_id")))


def over_hot_budget(pages: DataFrame, budget: int) -> DataFrame:
    """Layouts whose optional pages (manifold, page, bytes) exceed the budget, with the page at which they do."""
    from pyspark.sql import Window

    running = F.sum("bytes").over(Window.partitionBy("manifold").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    over = pages.withColumn("running", running).where(F.col("running") > budget)
    return over.groupBy("manifold").agg(F.min("page").alias("page"), F.min("running").alias("bytes"))
