"""Bit masks and visibility predicates as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshwork.types import View


def overlap(mask: Column | str, wanted: int) -> Column:
    """Whether two 64-bit masks share a bit."""
    column = F.col(mask) if isinstance(mask, str) else mask
    return column.cast("bigint").bitwiseAND(F.lit(wanted).cast("bigint")) != 0


def bit_for(kind: Column) -> Column:
    """1 << kind, null where kind is not within 0 to 63 (a shift by 64 would wrap)."""
    shifted = F.call_function("shiftleft", F.lit(1).cast("bigint"), kind.cast("int"))
    return F.when((kind >= 0) & (kind < 64), shifted)


def node_visible(view: View, indexed: bool = True) -> Column:
    """Without an index everything shows; with one, a zero mask hides a row even from an unfiltered view."""
    if not indexed:
        return F.lit(True)
    return overlap("family_mask", view.families) & overlap("scope_mask", view.scopes) & overlap("review_mask", view.reviews)


def edge_visible(view: View, indexed: bool = True) -> Column:
    """As nodes, and by relation; endpoints do not matter."""
    return node_visible(view, indexed) & (overlap("relation_mask", view.relations) if indexed else F.lit(True))


def split_words(value: Column) -> tuple[Column, Column]:
    """Low and high 32-bit words of a 64-bit pattern."""
    return value.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(value, 32)


def unsigned_order(value: Column) -> Column:
    """Sort key that orders BIGINT patterns as unsigned numbers."""
    return value.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))
