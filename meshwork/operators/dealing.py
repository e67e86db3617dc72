"""Joins whose crowded keys are dealt to several tasks, and shuffles whose tasks get a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.sources.shared import new_path

#: Rows of one key that one task gets from either side, at most.
BOUND = 20_000
#: Rows of distinct keys that a task of a sized shuffle gets on average, and rows of one key from which its partners are broadcast.
TASK_ROWS = 500_000
HOT_ROWS = 100_000
#: Crowded keys up to this number are broadcast.
BROADCAST_KEYS = 100_000


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: lineage ends here."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(rows: int) -> int:
    """How many tasks so many rows are dealt to: by rows, since sorted keys take few bytes in a shuffle and many in memory."""
    return max(1, -(-rows // TASK_ROWS))


def sized_join(many: DataFrame, one: DataFrame, key: str, other: str, tasks: int, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` where ``key`` equals ``other``, in so many tasks; ``one`` has few rows a key.

    Keys that very many rows of ``many`` have are few: their partners are broadcast.
    """
    met = F.col(key) == F.col(other)
    if tasks == 1:
        return many.join(one, met, how)
    dealt = lambda df: df.join(one.repartition(tasks, other), met, how)
    hot = [r[0] for r in many.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > HOT_ROWS).collect()]  # at most a row for HOT_ROWS rows
    if not hot:
        return dealt(many.repartition(tasks, key))
    crowded = F.coalesce(F.col(key).isin(hot), F.lit(False))
    apart = many.where(crowded).join(F.broadcast(one.where(F.col(other).isin(hot))), met, how)
    return dealt(many.where(~crowded).repartition(tasks, key)).unionByName(apart)


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], bound: int = BOUND) -> DataFrame:
    """Inner join on keys of which some hold very many rows on either side.

    A key with more than ``bound`` rows on a side gets a grid of slots: rows of that
    side are dealt to slots by a hash of the whole row, and copied along the other axis,
    so each pair of rows meets in one task, and no task gets more than about
    ``bound`` rows of a key from either side. Both sides are read twice.
    """
    count = lambda df, name: df.groupBy(*on).agg(F.count("*").alias(name))
    slots = lambda name: F.ceil(F.col(name) / F.lit(bound)).cast("int")
    both = count(left, "_l").join(count(right, "_r"), on)
    crowded = stored(both.where((F.col("_l") > bound) | (F.col("_r") > bound)).select(*on, slots("_l").alias("_lefts"), slots("_r").alias("_rights")), "crowded")
    keys = crowded.count()
    if not keys:
        return left.join(right, on)
    crowded = F.broadcast(crowded) if keys <= BROADCAST_KEYS else crowded

    def spread(df: DataFrame, own: str, other: str, mine: str, others: str) -> DataFrame:
        slot = F.coalesce(F.pmod(F.xxhash64(*df.columns), F.col(mine)), F.lit(0)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(others), F.lit(1)) - 1))
        return df.join(crowded, on, "left").select(*df.columns, slot.alias(own), copies.alias(other))

    rows = spread(left, "_row", "_column", "_lefts", "_rights").join(spread(right, "_column", "_row", "_rights", "_lefts"), [*on, "_row", "_column"])
    return rows.drop("_row", "_column")
