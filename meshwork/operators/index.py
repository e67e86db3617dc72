"""The product index: binding, lookups, section and label offsets, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.masks import bit_for
from meshwork.types import ACCEPTED, ALL_BITS

from .slots import RANGE, before, ranged
from .validate import union, violations


def binding_mismatches(index: DataFrame, archive: DataFrame) -> DataFrame:
    """First mismatching slot per resource of two identity lists (resource, slot, id)."""
    a = index.select("resource", "slot", F.col("id").alias("index_id"))
    b = archive.select("resource", "slot", F.col("id").alias("archive_id"))
    wrong = a.join(b, ["resource", "slot"], "full_outer").where(~F.col("index_id").eqNullSafe(F.col("archive_id")))
    return wrong.groupBy("resource").agg(F.min("slot").alias("slot"), F.count("*").alias("n"))


def entity_nodes(mappings: DataFrame, entities: DataFrame) -> DataFrame:
    return mappings.join(entities.select("entity_id"), "entity_id").select("entity_id", "node_id")


def mapping_violations(mappings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Zero and repeated entities, repeated nodes, nodes that do not exist."""
    rows = mappings.select("entity_id", "node_id")
    lost = rows.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti")
    repeated = lambda key: rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return union(
        [
            violations(rows, "ZeroEntity", F.col("entity_id") == 0, "entity_id", F.col("entity_id"), 0),
            violations(repeated("entity_id"), "DuplicateEntity", F.lit(True), "entity_id", F.col("entity_id"), 1),
            violations(repeated("node_id"), "DuplicateNode", F.lit(True), "node_id", F.col("node_id"), 2),
            violations(lost, "MissingNode", F.lit(True), "entity_id", F.col("entity_id"), 3, F.col("node_id")),
        ]
    )


def running_offsets(rows: DataFrame, order: str, size: Column) -> DataFrame:
    """``rows`` with offset: the summed size of all rows before in order of a unique key.

    Sums run within ranges of the key in parallel; only the ranges' totals are summed in one place.
    """
    sized = ranged(rows.withColumn("_size", size.cast("bigint")), order)
    totals = F.broadcast(before(sized.groupBy(RANGE).agg(F.sum("_size").alias("_total")), "_total", "_before"))
    local = F.coalesce(F.sum("_size").over(Window.partitionBy(RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("_local", local).join(totals, RANGE).withColumn("offset", F.col("_before") + F.col("_local")).drop("_size", RANGE, "_local", "_before")


def from_scene(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The product rows of a scene: family by kind, all scopes, accepted; an edge's relation is its family."""
    shared = lambda: (bit_for(F.col("kind")).alias("family_mask"), F.lit(ALL_BITS).cast("bigint").alias("scope_mask"))
    accepted = F.lit(ACCEPTED).cast("bigint").alias("review_mask")
    return (
        nodes.select(F.col("id").alias("node_id"), *shared(), accepted),
        edges.select(F.col("id").alias("edge_id"), *shared(), bit_for(F.col("kind")).alias("relation_mask"), accepted),
    )


def binding(scene: DataFrame) -> DataFrame:
    """What binds an index to a scene (generation, cohort_hash): both must be equal."""
    return scene.select(F.struct("generation", "cohort_hash").alias("binding"))


def cohort_digest(descriptors: DataFrame, order: str, value: Column) -> DataFrame:
    """One digest over all descriptors in order: digests of blocks in parallel, then a digest of those."""
    blocks = descriptors.groupBy(F.floor(F.col(order) / 4096).alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))).alias("rows"))
    blocks = blocks.select("block", F.sha2(F.array_join(F.transform("rows", lambda r: r["v"]), ","), 256).alias("d"))
    top = blocks.agg(F.array_sort(F.collect_list(F.struct("block", "d"))).alias("rows"))
    return top.select(F.sha2(F.array_join(F.transform("rows", lambda r: r["d"]), ","), 256).alias("digest"))


def bad_references(products: DataFrame, reference: str, count: int) -> DataFrame:
    return products.where(F.col(reference).isNotNull() & ((F.col(reference) < 0) | (F.col(reference) >= count)))
