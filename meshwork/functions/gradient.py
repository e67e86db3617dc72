"""Colour bands over the graphemes of a text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import graphemes


def channels(rgb: int) -> tuple[float, float, float]:
    return ((rgb >> 16 & 255) / 255.0, (rgb >> 8 & 255) / 255.0, (rgb & 255) / 255.0)


def unpack(rgb: Column) -> tuple[Column, Column, Column]:
    """Channels of a packed 0xRRGGBB column, 0 to 1."""
    return tuple(F.shiftright(rgb, n).bitwiseAND(F.lit(255)) / F.lit(255.0) for n in (16, 8, 0))


def pack(red: Column, green: Column, blue: Column) -> Column:
    whole = [F.round(c * 255).cast("bigint") for c in (red, green, blue)]
    return F.shiftleft(whole[0], 16) + F.shiftleft(whole[1], 8) + whole[2]


def clean_phase(phase: float) -> float:
    return phase % 1.0 if math.isfinite(phase) else 0.0


def clean_cycles(cycles: float) -> float:
    return min(max(abs(cycles), 0.01), 64.0) if math.isfinite(cycles) else 1.0


def sample(position: Column, palette: list[int]) -> tuple[Column, Column, Column]:
    """Cyclic linear interpolation of a palette (two colours or more) at a position modulo 1."""
    if len(palette) < 2:
        raise ValueError("a palette needs at least two colours")
    finite = F.when(F.isnan(position) | (F.abs(position) == float("inf")), F.lit(0.0)).otherwise(position)
    scaled = F.pmod(finite, F.lit(1.0)) * len(palette)
    low = F.pmod(F.floor(scaled), F.lit(len(palette))).cast("int")
    high = F.pmod(low + 1, F.lit(len(palette))).cast("int")
    amount = scaled - F.floor(scaled)
    found = []
    for k in range(3):
        table = F.array(*(F.lit(channels(c)[k]) for c in palette))
        a, b = F.element_at(table, low + 1), F.element_at(table, high + 1)
        found.append(a + (b - a) * amount)
    return tuple(found)


def color_runs(rows: DataFrame, text: str, palette: list[int], phase: float = 0.0, cycles: float = 1.0, max_runs: int = 64) -> DataFrame:
    """One row per band: run, byte_start, byte_len and its colour at the band's midpoint."""
    split = rows.withColumn("graphemes", graphemes(F.col(text))).withColumn("n", F.size("graphemes")).where("n > 0")
    bands = split.withColumn("k", F.least("n", F.lit(max(1, max_runs)))).withColumn("run", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    at = lambda run: F.floor(run * F.col("n") / F.col("k")).cast("int")
    bands = bands.withColumn("first", at(F.col("run"))).withColumn("last", at(F.col("run") + 1))
    size = lambda first, count: F.octet_length(F.array_join(F.slice("graphemes", first + 1, count), ""))
    middle = (F.col("first") + F.col("last")) * 0.5 / F.col("n")
    red, green, blue = sample(middle * clean_cycles(cycles) + clean_phase(phase), palette)
    return bands.withColumns(
        {
            "byte_start": size(F.lit(0), F.col("first")).cast("bigint"),
            "byte_len": size(F.col("first"), F.col("last") - F.col("first")).cast("bigint"),
            "rgb": pack(red, green, blue),
        }
    ).drop("graphemes", "n", "k", "first", "last")
