"""Batches admitted in order while they fit, without walking them one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dealing import stored
from .slots import RANGE, ranged
from .validate import union

#: Lanes up to this number are broadcast.
BROADCAST_LANES = 100_000
LAST = 2**63 - 1


def _running(rows: DataFrame) -> DataFrame:
    """Adds ``before``: what the small rows before each one in its lane take together; one row a lane and range is summed across ranges."""
    amount = F.when(F.col("small"), F.col("size")).otherwise(0)
    rows = rows.withColumn("amount", amount)
    totals = rows.groupBy("lane", RANGE).agg(F.sum("amount").alias("total"))
    ahead = Window.partitionBy("lane").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("lane", RANGE, F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    local = F.sum("amount").over(Window.partitionBy("lane", RANGE).orderBy("order")) - F.col("amount")
    return rows.withColumn("local", local).join(totals, ["lane", RANGE]).withColumn("before", F.col("ahead") + F.col("local"))


def admitted_batches(batches: DataFrame, capacity: int) -> DataFrame:
    """(lane, order, size, accepted) of batches (lane, order, size): in order, a batch is accepted if its lane still has room for it, and a refused one takes none.

    Sizes are whole numbers, not negative, and orders are unique in a lane. In a round all
    lanes skip ahead together: of batches up to half the room all are accepted until they no longer
    fit, and of larger ones the first that does. Either event at least halves the
    room, so there are as many rounds as the capacity has binary digits, whatever the
    number of batches; each takes prefix sums over ranges.
    """
    placed = ranged(batches.select("lane", "order", F.col("size").cast("bigint").alias("size")), "lane", "order")
    state = placed.groupBy("lane").agg(F.lit(-LAST).cast("bigint").alias("after"), F.lit(capacity).cast("bigint").alias("room"))
    state, rounds = stored(state, "lanes"), []
    lanes = state.count()
    while lanes:
        open_lanes = F.broadcast(state) if lanes <= BROADCAST_LANES else state
        left = placed.join(open_lanes, "lane").where((F.col("order") > F.col("after")) & (F.col("size") <= F.col("room")))
        left = _running(left.withColumn("small", F.col("size") * 2 <= F.col("room")))
        full = F.col("small") & (F.col("before") + F.col("size") > F.col("room"))
        taken = ~F.col("small") & (F.col("before") + F.col("size") <= F.col("room"))
        event = F.struct("order", "before", "size", taken.alias("taken"))
        cuts = left.where(full | taken).groupBy("lane").agg(F.min_by(event, "order").alias("cut"))
        done = stored(state.join(cuts, "lane", "left").select("lane", "after", "room", F.coalesce("cut.order", F.lit(LAST)).alias("upto"), F.coalesce("cut.taken", F.lit(False)).alias("taken"), F.coalesce("cut.before", F.lit(0)).alias("before"), F.coalesce("cut.size", F.lit(0)).alias("last")), "rounds")
        rounds.append(done)
        cost = F.col("before") + F.when(F.col("taken"), F.col("last")).otherwise(0)
        state = done.where(F.col("upto") < LAST).select("lane", F.col("upto").alias("after"), (F.col("room") - cost).alias("room"))
        lanes = state.count()
    if not rounds:
        return placed.select("lane", "order", "size", F.lit(False).alias("accepted"))
    told = union(rounds).select("lane", "after", "upto", "room", "taken")
    met = placed.join(told, (placed["lane"] == told["lane"]) & (F.col("order") > F.col("after")) & (F.col("order") <= F.col("upto")))
    accepted = F.when(F.col("order") == F.col("upto"), F.col("taken")).otherwise(F.col("size") * 2 <= F.col("room"))
    return met.select(placed["lane"], "order", "size", F.coalesce(accepted, F.lit(False)).alias("accepted"))
