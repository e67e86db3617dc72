"""Views of a scene as rows: whether they may be applied, and which one each session shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.types import ALL_BITS, REVIEW_BITS

#: What a view shows, and what it was made for.
MASKS = ("families", "scopes", "relations")
AUTHORITY = ("generation", "cohort_hash", "index_hash")


def is_unfiltered() -> Column:
    """Whether a view (families, scopes, relations, reviews) hides nothing."""
    return reduce(Column.__and__, [F.col(m) == ALL_BITS for m in MASKS]) & (F.col("reviews") == sum(REVIEW_BITS.values()))


def authority_error(scene: str = "scene") -> Column:
    """Why a view may not be applied to a scene (a struct of the same authority columns), null when it may."""
    bound = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{scene}.{c}")) for c in AUTHORITY])
    return F.when(~is_unfiltered() & F.col(f"{scene}.index_hash").isNull(), "ProductIndexRequiredForFilteredView").when(~bound, "StaleGraphViewAuthority")


def style_error(revision: Column, node_scale: Column) -> Column:
    """Why a style may not replace a view's style, null when it may."""
    fine = (revision != 0) & (node_scale > 0) & (node_scale < float("inf"))  # NaN is above infinity
    return F.when(~F.coalesce(fine, F.lit(False)), "InvalidStyle")


def checked_views(views: DataFrame, scenes: DataFrame) -> DataFrame:
    """Each view against the scene that it names (``scene_id``): adds unfiltered, error and style_error; a view of no scene is stale."""
    resident = scenes.select("scene_id", F.struct(*AUTHORITY).alias("scene"))
    told = views.join(resident, "scene_id", "left")
    error = F.when(F.col("scene").isNull(), "StaleGraphViewAuthority").otherwise(authority_error())
    return told.withColumns({"unfiltered": is_unfiltered(), "error": error, "style_error": style_error(F.col("style_revision"), F.col("node_scale"))}).drop("scene")


def applied_views(checked: DataFrame) -> DataFrame:
    """(session, view_id): the newest view of each session that could be applied; refused ones change nothing."""
    good = checked.where("error is null and style_error is null")
    return good.groupBy("session").agg(F.max_by("view_id", "sequence").alias("view_id"))


def bound_views(scenes: DataFrame) -> DataFrame:
    """The unfiltered view that a scene starts with, bound to its authority."""
    masks = [F.lit(ALL_BITS).cast("bigint").alias(m) for m in MASKS]
    return scenes.select("scene_id", *masks, F.lit(sum(REVIEW_BITS.values())).alias("reviews"), *AUTHORITY)
