"""What changed between two versions of a keyed table, lane by lane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validate import union


def _lanes(df: DataFrame, key: str) -> list[str]:
    return [c for c in df.columns if c != key]


def _digest(df: DataFrame, key: str) -> DataFrame:
    """(key, digest): 256 bits of the row's lanes with their nulls, told apart by their lengths."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _lanes(df, key)]
    marks = [F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.octet_length(s).cast("string")) for c, s in zip(_lanes(df, key), shown)]
    return df.select(key, F.unhex(F.sha2(F.concat_ws("|", *marks, *shown).cast("binary"), 256)).alias("digest"))


def scene_delta(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(op, key, changed, lanes of the new version) of rows that were added, removed or updated; keys are unique.

    Only keys and digests of all rows are joined. Whole rows of both versions
    are met for the keys that differ alone, and say which lanes did.
    """
    lanes = _lanes(after, key)
    old, new = _digest(before.select(key, *lanes), key), _digest(after, key)
    joined = old.withColumnRenamed("digest", "old").join(new.withColumnRenamed("digest", "new"), key, "full_outer")
    op = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").otherwise("update")
    touched = joined.where(~F.col("old").eqNullSafe(F.col("new"))).select(key, op.alias("op"))
    was = before.select(key, F.struct(*lanes).alias("was"))
    rows = touched.join(after.select(key, F.struct(*lanes).alias("now")), key, "left").join(was, key, "left")
    differs = [F.when(~F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}")), F.lit(c)) for c in lanes]
    changed = F.when(F.col("op") == "update", F.filter(F.array(*differs), lambda c: c.isNotNull())).otherwise(F.array().cast("array<string>"))
    return rows.select("op", key, changed.alias("changed"), "now.*")


def apply_delta(before: DataFrame, delta: DataFrame, key: str = "id") -> DataFrame:
    """The version that a delta leads to."""
    kept = before.join(delta.select(key), key, "left_anti").select(*before.columns)
    return kept.unionByName(delta.where("op <> 'remove'").select(*before.columns))


def sync_scene(loaded: DataFrame | None, loaded_generation: int | None, scene: DataFrame, generation: int, key: str = "id") -> DataFrame:
    """What a consumer takes over: a delta within a generation, all rows as loads for a new one."""
    if loaded is not None and loaded_generation == generation:
        return scene_delta(loaded, scene, key)
    lanes = _lanes(scene, key)
    return scene.select(F.lit("load").alias("op"), key, F.array().cast("array<string>").alias("changed"), *lanes)


def changes_by_lane(delta: DataFrame, lanes: list[str]) -> DataFrame:
    """(op, lane, n): rows per kind of change, and updates per lane."""
    whole = delta.groupBy("op").agg(F.count("*").alias("n")).select("op", F.lit("").alias("lane"), "n")
    one = lambda lane: delta.where(F.array_contains("changed", lane)).agg(F.count("*").alias("n")).select(F.lit("update").alias("op"), F.lit(lane).alias("lane"), "n")
    return union([whole, *(one(lane) for lane in lanes)])
