"""Exact order statistics without sorting all values in one place."""

from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .dealing import stored
from .slots import RANGE, before, ranged

#: Buckets that one pass counts, for each key.
BUCKETS = 4_096
#: Keys up to this number are broadcast.
BROADCAST_KEYS = 100_000
#: Rows of a ring's piece.
PIECE_ROWS = 8_192


def nearest_ranks(rows: DataFrame, value: str, share: float, *keys: str) -> DataFrame:
    """(keys, value, n): the nearest-rank quantile of the finite values of each key, exact.

    A pass counts values in equal buckets between the bounds that are left, and goes on in
    the bucket that holds the rank, with that bucket's own least and greatest value
    as bounds; it ends when these are one. Each pass hands on at most ``BUCKETS``
    rows a key and task, whatever the number of values.
    """
    by = list(keys) or ["_all"]
    v = F.col(value).cast("double")
    values = rows.select(*([F.col(k) for k in keys] or [F.lit(0).alias("_all")]), v.alias("_v")).where("_v is not null and not isnan(_v) and abs(_v) < double('infinity')")
    found = values.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    state = stored(found.select(*by, "n", F.greatest(F.ceil(F.col("n") * F.lit(share)), F.lit(1)).alias("_rank"), F.lit(0).cast("bigint").alias("_below"), "_low", "_high"), "quantiles")
    open_keys = state.where("_low < _high").count()
    while open_keys:
        left = state.where("_low < _high")
        left = F.broadcast(left) if open_keys <= BROADCAST_KEYS else left
        met = values.join(left, by).where("_v between _low and _high")
        width = F.col("_high") - F.col("_low")
        # halves keep large differences finite
        halves = (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
        part = F.when(width < float("inf"), (F.col("_v") - F.col("_low")) / width).otherwise(halves)
        met = met.withColumn("_bucket", F.least(F.floor(part * BUCKETS), F.lit(BUCKETS - 1)))
        counts = met.groupBy(*by, "_bucket", "n", "_rank", "_below").agg(F.count("*").alias("_count"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        running = F.sum("_count").over(Window.partitionBy(*by).orderBy("_bucket")) + F.col("_below")
        counts = counts.withColumn("_upto", running).where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_count") < F.col("_rank")))
        chosen = counts.select(*by, "n", "_rank", (F.col("_upto") - F.col("_count")).alias("_below"), "_low", "_high")
        state = stored(state.where("_low >= _high").unionByName(chosen), "quantiles")
        open_keys = state.where("_low < _high").count()
    return state.select(*keys, F.col("_low").alias(value), "n")


def sliding_ranks(rows: DataFrame, key: str, order: str, value: str, size: int, share: float, name: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``rows`` with the nearest-rank quantile over the newest ``size`` values of the row's key up to the row.

    Rows are placed in order of key and order, and cut to pieces of ``piece_rows`` that also
    get the ``size - 1`` rows before them: a key with very many rows is many pieces. A piece
    keeps its ring sorted as rows come, with one insertion and one removal a row.
    Null values count for nothing.
    """
    placed = ranged(rows, key, order)
    counts = F.broadcast(before(placed.groupBy(RANGE).count(), "count", "_before"))
    local = F.row_number().over(Window.partitionBy(RANGE).orderBy(key, order))
    placed = placed.withColumn("_local", local).join(counts, RANGE).withColumn("_place", F.col("_before") + F.col("_local") - 1).drop(RANGE, "_before", "_local")
    first = F.floor(F.col("_place") / piece_rows)
    last = F.floor((F.col("_place") + (size - 1)) / piece_rows)
    pieces = placed.withColumn("_key", F.xxhash64(key)).withColumn("_piece", F.explode(F.sequence(first, last)))

    def ring(number: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place").reset_index(drop=True)
        held: list[float] = []  # sorted
        newest: list[float | None] = []  # in order, from the key's first row on
        out, current = [], None
        for k, v in zip(pdf["_key"].tolist(), pdf[value].astype(float).tolist()):
            if k != current:
                held, newest, current = [], [], k
            known = not math.isnan(v)
            newest.append(v if known else None)
            if known:
                bisect.insort(held, v)
            if len(newest) > size and (gone := newest[-size - 1]) is not None:
                del held[bisect.bisect_left(held, gone)]
            out.append(held[math.ceil(len(held) * share) - 1] if held else None)
        pdf[name] = pd.Series(out, dtype=float)
        return pdf[pdf["_place"] // piece_rows == number[0]][columns]

    columns = [*rows.columns, name]
    schema = StructType([*rows.schema.fields, StructField(name, DoubleType())])
    return pieces.groupBy("_piece").applyInPandas(ring, schema)
