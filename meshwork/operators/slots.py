"""Dense positions, LIFO slot reuse, and ranges of touched slots.

Order over all rows is taken by ranges of the key that hold about equally many
rows, however the keys are spread; only one row a range is summed in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.sources.shared import new_path

RANGE = "_range"


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with the number of their range in this order, as many ranges as there are shuffle partitions.

    Ranges are cut by a sample, so the rows are written once and all that follows sees the same cut.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(ranges, *order).withColumn(RANGE, F.spark_partition_id())
    path = new_path(spark, "ranged")
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def before(totals: DataFrame, amount: str, name: str) -> DataFrame:
    """(range, name): what the ranges before hold together; one row a range."""
    window = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(RANGE, F.coalesce(F.sum(amount).over(window), F.lit(0)).alias(name))


def assign_slots(rows: DataFrame, key: str, slot: str = "slot") -> DataFrame:
    """Adds the 0-based position in order of a unique key."""
    placed = ranged(rows, key)
    counts = F.broadcast(before(placed.groupBy(RANGE).count(), "count", "_before"))
    local = F.row_number().over(Window.partitionBy(RANGE).orderBy(key))
    placed = placed.withColumn("_local", local).join(counts, RANGE)
    return placed.withColumn(slot, F.col("_before") + F.col("_local") - 1).drop(RANGE, "_before", "_local")


def allocate_slots(added: DataFrame, free: DataFrame, capacity: int) -> DataFrame:
    """(ord, id, slot): the k-th added id takes the k-th free slot from the top of the stack, then new slots.

    ``added`` is (ord, id) with ord from 1; ``free`` is (pos, slot) with the top at the highest pos.
    """
    size = free.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("n_free"))
    taken = free.crossJoin(F.broadcast(size)).select((F.col("n_free") - F.col("pos") + 1).alias("ord"), F.col("slot").alias("reused"))
    joined = added.crossJoin(F.broadcast(size)).join(taken, "ord", "left")
    fresh = F.lit(capacity) + F.col("ord") - F.col("n_free") - 1
    return joined.select("ord", "id", F.coalesce("reused", fresh).cast("bigint").alias("slot"))


def coalesced_ranges(touched: DataFrame, slot: str = "slot") -> DataFrame:
    """(first, count) of maximal runs of consecutive slots among the distinct touched ones.

    Runs are found within ranges of slots in parallel; only each range's first
    and last run can go on in another one, and only those are joined in one place.
    """
    placed = ranged(touched.select(F.col(slot).alias("s")).distinct(), "s")
    local = placed.withColumn("g", F.col("s") - F.row_number().over(Window.partitionBy(RANGE).orderBy("s")))
    runs = local.groupBy(RANGE, "g").agg(F.min("s").alias("first"), F.max("s").alias("last"))
    ends = runs.groupBy(RANGE).agg(F.min("first").alias("low"), F.max("last").alias("high"))
    runs = runs.join(F.broadcast(ends), RANGE).withColumn("inner", (F.col("first") != F.col("low")) & (F.col("last") != F.col("high")))
    order = Window.orderBy("first")
    starts = F.when(F.lag("last").over(order) + 1 == F.col("first"), 0).otherwise(1)
    outer = runs.where(~F.col("inner")).withColumn("start", starts).withColumn("run", F.sum("start").over(order))
    merged = outer.groupBy("run").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("first", "last")
    every = merged.unionByName(runs.where("inner").select("first", "last"))
    return every.select("first", (F.col("last") - F.col("first") + 1).alias("count"))


def next_power(slots: Column) -> Column:
    """The least power of two that holds so many slots."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(slots, F.lit(1)).cast("double")))).cast("bigint")


def buffer_error(capacity: Column, element: Column, limit: Column) -> Column:
    """Why a buffer of so many elements cannot be made, null when it can."""
    size = F.try_multiply(capacity.cast("bigint"), element.cast("bigint"))
    return F.when(size.isNull(), "BufferSizeOverflow").when(size > limit, "DeviceBufferLimit")


def next_revision(revision: Column) -> Column:
    """The revision after this one, null after the last."""
    return F.try_add(revision.cast("bigint"), F.lit(1).cast("bigint"))
