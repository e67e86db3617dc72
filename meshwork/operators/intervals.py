"""Overlaps of half-open intervals within documents, without comparing all with all.

``overlap_pairs`` meets intervals in bins as wide as the longer of the two; a pair is
given in the one bin where its common part begins.

``overlap_neighbours`` finds for each of a sequence of intervals the last overlapping
one before it and the first after it, however many overlap: intervals are cut
into dyadic pieces, and two overlap exactly when a piece of one is a piece of
the other or lies in one. So each piece asks two questions: what came to its place or
below it, and what came to a place above it. Rows grow with the logarithm of
the longest interval, never with the number of overlapping pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dealing import BOUND, dealt_join

#: Intervals up to 2 to this power share the finest bins.
LEAST_LEVEL = 3
_shift = lambda name: lambda value, by: F.call_function(name, value.cast("bigint"), by)
_left, _right = _shift("shiftleft"), _shift("shiftright")


def _level(start: Column, end: Column) -> Column:
    """The least power of two, not below ``LEAST_LEVEL``, that is as wide as the interval."""
    return F.greatest(F.ceil(F.log2((end - start).cast("double"))), F.lit(LEAST_LEVEL)).cast("int")


def overlap_pairs(left: DataFrame, right: DataFrame, on: str, bound: int = BOUND) -> DataFrame:
    """Pairs of rows of one key whose (start, end) and (other_start, other_end) overlap; empty intervals overlap nothing.

    An interval touches at most two bins of its own level or a coarser one. Levels are
    few, so both sides know which ones the other side has.
    """
    left = left.where("start < end").withColumn("_level", _level(F.col("start"), F.col("end")))
    right = right.where("other_start < other_end").withColumn("_other_level", _level(F.col("other_start"), F.col("other_end")))
    levels = [sorted(r[0] for r in df.select(name).distinct().collect()) for df, name in ((left, "_level"), (right, "_other_level"))]  # at most 62 each

    def binned(df: DataFrame, own: str, start: str, end: str, others: list[int]) -> DataFrame:
        # a pair meets at the coarser of both levels
        wanted = F.array_distinct(F.concat(F.array(F.col(own)), F.filter(F.array(*(F.lit(k) for k in others)).cast("array<int>"), lambda k: k > F.col(own))))
        at = df.withColumn("_at", F.explode(wanted))
        first, last = _right(F.col(start), F.col("_at")), _right(F.col(end) - 1, F.col("_at"))
        return at.withColumn("_bin", F.explode(F.sequence(first, last)))

    met = dealt_join(binned(left, "_level", "start", "end", levels[1]), binned(right, "_other_level", "other_start", "other_end", levels[0]), [on, "_at", "_bin"], bound)
    met = met.where((F.col("start") < F.col("other_end")) & (F.col("other_start") < F.col("end")) & (F.greatest("_level", "_other_level") == F.col("_at")))
    met = met.where(_right(F.greatest("start", "other_start"), F.col("_at")) == F.col("_bin"))
    return met.drop("_level", "_other_level", "_at", "_bin")


def dyadic_pieces(start: Column, end: Column) -> Column:
    """The fewest aligned blocks (level, block) that make up an interval from ``start`` (not below 0) to ``end``."""
    one = F.lit(1).cast("bigint")

    def at(level: Column) -> Column:
        low, high = _right(start + _left(one, level) - 1, level), _right(end, level)
        some = low < high
        piece = lambda odd, block: F.when(some & (odd % 2 == 1), F.struct(level.alias("level"), block.alias("block")))
        return F.array(piece(low, low), piece(high, high - 1))

    most = F.floor(F.log2((end - start).cast("double"))).cast("int")
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), most), at)), lambda p: p.isNotNull())


def overlap_neighbours(rows: DataFrame, on: str, order: str) -> DataFrame:
    """``rows`` with ``previous`` and ``next``: the orders of the nearest overlapping rows of the key before and after each row.

    ``rows`` has start (not below 0) and end, and at most one row for each key and
    order. Empty intervals overlap nothing.
    """
    spans = rows.where("start < end").select(on, F.col(order).cast("bigint").alias("_order"), "start", "end")
    top = spans.agg(F.max(F.floor(F.log2((F.col("end") - F.col("start")).cast("double"))))).first()[0]
    if top is None:
        return rows.withColumn("previous", F.lit(None).cast("bigint")).withColumn("next", F.lit(None).cast("bigint"))
    pieces = spans.select(on, "_order", F.explode(dyadic_pieces(F.col("start"), F.col("end"))).alias("p")).select(on, "_order", "p.level", "p.block")
    # longer intervals than the longest one have no pieces, so the way up ends there
    above = lambda first: F.filter(F.sequence(F.lit(0), F.lit(int(top))), lambda k: k >= first)
    up = lambda first: F.explode(F.transform(above(first), lambda k: F.struct(k.alias("level"), _right(F.col("block"), k - F.col("level")).alias("block"))))
    marks = lambda df, asks, kind: df.select(on, "_order", F.lit(kind).alias("_kind"), F.col("at.level").alias("_level"), F.col("at.block").alias("_block"), F.lit(asks).alias("_asks"))
    here = pieces.withColumn("at", F.struct("level", "block"))
    below = marks(pieces.withColumn("at", up(F.col("level"))), False, "below"), marks(here, True, "below")
    exact = marks(here, False, "exact"), marks(pieces.withColumn("at", up(F.col("level") + 1)), True, "exact")
    place = [on, "_kind", "_level", "_block"]
    told = below[0].unionByName(exact[0]).distinct()
    asked = below[1].unionByName(exact[1])
    # only places that are both told and asked matter
    both = told.join(asked.select(*place).distinct(), place, "left_semi").unionByName(asked.join(told.select(*place).distinct(), place, "left_semi"))
    order_at = Window.partitionBy(*place).orderBy("_order")
    said = F.when(~F.col("_asks"), F.col("_order"))
    near = both.withColumn("_previous", F.max(said).over(order_at.rangeBetween(Window.unboundedPreceding, -1)))
    near = near.withColumn("_next", F.min(said).over(order_at.rangeBetween(1, Window.unboundedFollowing))).where("_asks")
    found = near.groupBy(on, "_order").agg(F.max("_previous").alias("previous"), F.min("_next").alias("next"))
    return rows.withColumn("_order", F.col(order).cast("bigint")).join(found, [on, "_order"], "left").drop("_order")
