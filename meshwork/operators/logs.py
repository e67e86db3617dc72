"""Command and event logs: replay, conflation, admission, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.types import LIMITS

from .quantiles import nearest_ranks, sliding_ranks


def replay(events: DataFrame, after: int) -> DataFrame:
    return events.where(F.col("sequence") > after)


def tail(events: DataFrame, size: int = LIMITS["event_ring"]) -> DataFrame:
    """The newest events: a bounded ring that drops the oldest."""
    return events.orderBy(F.desc("sequence")).limit(size)


def latest(events: DataFrame, *keys: str) -> DataFrame:
    """Only the newest event of each key (hover conflation)."""
    columns = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*columns), "sequence").alias("e")).select(*keys, "e.*")


def changed_only(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Rows that differ from the one before; equal neighbours are one."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    return rows.withColumn("_new", first | ~F.col(value).eqNullSafe(before)).where("_new").drop("_new")


def command_metrics(log: DataFrame, step: Column) -> DataFrame:
    """Submitted, completed, rejected, pending and the highest pending count; ``step`` is +1 on submit, -1 on an end.

    The running count is taken per block of sequences and then across blocks.
    """
    block = F.shiftright("sequence", 12)
    rows = log.withColumn("_step", step).withColumn("_block", block)
    local = F.sum("_step").over(Window.partitionBy("_block").orderBy("sequence"))
    blocks = rows.withColumn("_run", local).groupBy("_block").agg(
        F.sum("_step").alias("total"), F.max("_run").alias("peak"), F.count_if(F.col("status") == "submitted").alias("submitted"),
        F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "rejected").alias("rejected"),
    )
    before = F.coalesce(F.sum("total").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("before", before)
    return blocks.agg(
        F.sum("submitted").alias("submitted"), F.sum("completed").alias("completed"), F.sum("rejected").alias("rejected"),
        F.sum("total").alias("pending"), F.greatest(F.max(F.col("before") + F.col("peak")), F.lit(0)).alias("high_water"),
    )


def nearest_rank(values: DataFrame, value: str, share: float = 0.95) -> DataFrame:
    return nearest_ranks(values, value, share).select(F.col(value).alias("p95"), "n")


def ring_percentile(rows: DataFrame, key: str, order: str, value: str, size: int = LIMITS["sample_ring"], share: float = 0.95) -> DataFrame:
    """At each row, the nearest-rank percentile over the newest ``size`` samples of its key."""
    return sliding_ranks(rows, key, order, value, size, share, "p95")


def admitted(commands: DataFrame, drained: Column, capacity: int = LIMITS["event_log"]) -> DataFrame:
    """Commands by whether the event log had room: events so far in an epoch (between drains) below capacity."""
    epoch = F.sum(drained.cast("int")).over(Window.partitionBy("lane").orderBy("sequence"))
    rows = commands.withColumn("epoch", epoch)
    place = F.row_number().over(Window.partitionBy("lane", "epoch").orderBy("sequence"))
    return rows.withColumn("accepted", place <= capacity)


def dragged(events: DataFrame, key: str, press: str) -> DataFrame:
    """Whether a pointer has moved 4 pixels or more since its press; sticky within the press."""
    window = Window.partitionBy(key, press).orderBy("sequence")
    far = (F.col("x") - F.first("x").over(window)) ** 2 + (F.col("y") - F.first("y").over(window)) ** 2 >= 16
    return events.withColumn("far", far).withColumn("dragging", F.max("far").over(window)).drop("far")


def pick_request(requests: DataFrame) -> DataFrame:
    """The request that a pass answers per frame: a selection before any hover, else the newest."""
    rank = F.struct((F.col("intent") == "select").alias("s"), F.col("sequence").alias("n"))
    return requests.groupBy("frame").agg(F.max_by(F.struct("sequence", "intent", "x", "y"), rank).alias("r")).select("frame", "r.*")


def order_breaks(log: DataFrame, key: str) -> DataFrame:
    """Rows whose sequence does not grow."""
    before = F.lag("sequence").over(Window.partitionBy(key).orderBy("arrival"))
    return log.withColumn("before", before).where(F.col("sequence") <= F.col("before"))
