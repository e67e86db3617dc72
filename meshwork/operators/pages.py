"""The page catalogue: descriptors, their rules, offsets and totals; classes of load errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.text import align_up
from meshwork.types import LIMITS

from .slots import next_power
from .validate import union, violations

# Page kinds that exist once per manifold, prefixes of statuses to act on, and classes of load errors by rule.
MANIFOLD_PAGES = ("positions", "guides", "straight_paths", "curved_paths", "bundled_paths")
ACTIONABLE = ("BLOCKED", "SAVE BLOCKED", "GRAPH BLOCKED", "CONFIRM")
ERROR_CLASSES = {
    "MISSING": ("MissingArchive", "MissingPage"),
    "OVERSIZED": ("OversizedArchive", "OversizedPage", "HotPageBudgetExceeded"),
    "UNSUPPORTED": ("UnsupportedFormatVersion", "UnsupportedPageKind", "UnsupportedPageVersion"),
}


def placed(pages: DataFrame, start: int) -> DataFrame:
    """``pages`` (kind_number, manifold, length) with their aligned offsets, in order of kind and manifold, shared pages first.

    At most ``LIMITS["pages"]`` descriptors, so one ordered window is enough.
    """
    order = Window.orderBy("kind_number", F.col("manifold").asc_nulls_first())
    before = F.coalesce(F.sum(align_up(F.col("length"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pages.withColumn("offset", before + start)


def page_violations(pages: DataFrame, data_start: int, file_length: int) -> DataFrame:
    """Scope, size, alignment, bounds and overlap of descriptors (kind, manifold, offset, length)."""
    scoped = F.col("kind").isin(*MANIFOLD_PAGES) == F.col("manifold").isNotNull()
    outside = (F.col("offset") < data_start) | (F.col("offset") + F.col("length") > file_length)
    order = Window.orderBy("offset")
    overlapping = pages.withColumn("before", F.lag(F.col("offset") + F.col("length")).over(order)).where("offset < before")
    rule = lambda rows, name, bad: violations(rows, name, bad, "offset", F.col("offset"), 0)
    return union(
        [
            rule(pages, "InvalidPageScope", ~scoped),
            rule(pages, "OversizedPage", F.col("length") > LIMITS["page_bytes"]),
            rule(pages, "MisalignedPage", F.col("offset") % 64 != 0),
            rule(pages, "PageOutOfBounds", outside),
            rule(overlapping, "OverlappingPages", F.lit(True)),
        ]
    )


def allocation(counts: DataFrame, record_bytes: dict[str, int]) -> DataFrame:
    """Bytes that buffers of (name, slots) take: the next power of two of slots times the record's size."""
    size = reduce(lambda acc, kv: acc.when(F.col("name") == kv[0], kv[1]), record_bytes.items(), F.when(F.lit(False), 0))
    capacity = next_power(F.col("slots"))
    return counts.select("name", capacity.alias("capacity"), (capacity * size).alias("bytes"))


def error_class(rule: Column) -> Column:
    """The stable class of a load error; what is not listed is corrupt."""
    found = reduce(lambda acc, kv: acc.when(rule.isin(*kv[1]), kv[0]), ERROR_CLASSES.items(), F.when(F.lit(False), ""))
    return found.otherwise("CORRUPT")


def actionable(status: Column) -> Column:
    return reduce(lambda a, b: a | b, (status.startswith(p) for p in ACTIONABLE))


def palette_violations(palette: DataFrame) -> DataFrame:
    """Colours (family_slot, channels) with a channel that is not finite or not within 0 to 1."""
    bad = F.exists("channels", lambda c: c.isNull() | F.isnan(c) | (c < 0) | (c > 1))
    return violations(palette, "InvalidPalette", bad, "family_slot", F.col("family_slot"), 0)
