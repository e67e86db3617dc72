"""Digests of pages in a tree of levels: a root for all pages, and the way down to the ones that changed.

A node of a level is the digest of at most ``fanout`` digests of the level below, in
order, so no row gathers more, and a changed page is found by comparing one
path of nodes, not all pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dealing import stored
from .slots import assign_slots
from .validate import union

FANOUT = 64


def page_digests(pages: DataFrame, order: str, content: Column) -> DataFrame:
    """(place, digest): SHA-256 of each page, in order of a unique key."""
    told = pages.select(F.col(order).alias("_order"), F.sha2(content.cast("binary"), 256).alias("digest"))
    return assign_slots(told, "_order", "place").select(F.col("place").cast("bigint").alias("place"), "digest")


def levels(pages: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels (place, digest) from the pages up to one root; each is written, and one ``fanout``-th of the one below."""
    found = [stored(pages, "digests")]
    size = found[0].count()
    while size > 1:
        group = F.floor(F.col("place") / fanout).cast("bigint")
        inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda d: d["digest"]), "")
        above = found[-1].groupBy(group.alias("group")).agg(F.sha2(inner.cast("binary"), 256).alias("digest"))
        found.append(stored(above.select(F.col("group").alias("place"), "digest"), "digests"))
        size = -(-size // fanout)
    return found


def root(tree: list[DataFrame]) -> DataFrame:
    """(digest, levels) of the whole; no row for no pages."""
    return tree[-1].select("digest", F.lit(len(tree)).alias("levels"))


def changed_pages(before: list[DataFrame], after: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """Places of pages that differ, or that one side lacks: only children of nodes that differ are compared."""
    depth = max(len(before), len(after))
    suspects = None
    for level in range(depth - 1, -1, -1):
        if level >= min(len(before), len(after)):
            continue  # one side is too small to have this level, so all below may differ
        old, new = before[level].withColumnRenamed("digest", "old"), after[level].withColumnRenamed("digest", "new")
        if suspects is not None:
            under = suspects.select(F.explode(F.sequence(F.col("place") * fanout, F.col("place") * fanout + (fanout - 1))).alias("place"))
            old, new = old.join(under, "place", "left_semi"), new.join(under, "place", "left_semi")
        suspects = stored(old.join(new, "place", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("place"), "suspects")
    return suspects


def all_levels(tree: list[DataFrame]) -> DataFrame:
    """(level, place, digest) of the whole tree."""
    return union([rows.withColumn("level", F.lit(k)).select("level", "place", "digest") for k, rows in enumerate(tree)])
