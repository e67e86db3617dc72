"""Verified spans of documents and their colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.text import byte_slice, is_boundary

from .registry import family_rows
from .validate import union, violations


def overlapping(anchors: DataFrame) -> DataFrame:
    """Anchors that begin before the end of the one before them in their document."""
    order = Window.partitionBy("document").orderBy("start", "end", "node_id")
    return anchors.withColumn("previous_end", F.lag("end").over(order)).where(F.col("start") < F.col("previous_end"))


def wrong_surface(anchors: DataFrame) -> DataFrame:
    """Anchors whose bytes are not their surface, or that cut a character."""
    good = is_boundary(F.col("content"), F.col("start")) & is_boundary(F.col("content"), F.col("end"))
    good = good & (byte_slice(F.col("content"), F.col("start"), F.col("end")) == F.col("surface"))
    return anchors.where(~F.coalesce(good, F.lit(False)))


def anchor_violations(anchors: DataFrame) -> DataFrame:
    """Range, overlap and surface rules in order of place."""
    cut = ~(is_boundary(F.col("content"), F.col("start")) & is_boundary(F.col("content"), F.col("end")))
    outside = (F.col("start") >= F.col("end")) | (F.col("end") > F.octet_length("content"))
    return union(
        [
            violations(anchors, "InvalidAnchorRange", outside | F.coalesce(cut, F.lit(True)), "node_id", F.col("start"), 0),
            violations(overlapping(anchors), "OverlappingAnchors", F.lit(True), "node_id", F.col("start"), 0),
            violations(wrong_surface(anchors), "SurfaceMismatch", F.lit(True), "node_id", F.col("start"), 0),
        ]
    )


def highlights(anchors: DataFrame) -> DataFrame:
    """Spans (document, start, end, family) with the two colours of their family; the palette has eight rows."""
    return anchors.join(F.broadcast(family_rows(anchors.sparkSession)), "family").select("document", "start", "end", "family", "primary_rgb", "secondary_rgb")


def for_lease(mentions: DataFrame, lease: DataFrame) -> DataFrame:
    """Active mentions whose document, revision and content hash are those of a lease."""
    return mentions.where("active").join(lease.select("document", "document_revision", "content_hash"), ["document", "document_revision", "content_hash"])
