"""Byte-exact text functions: spans are byte offsets into UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshwork.types import LIMITS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The characters with the Unicode property White_Space.
_WHITE = "\\u0009-\\u000D\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def contains_ascii_ci(haystack: Column, needle: Column) -> Column:
    return F.contains(ascii_lower(haystack), ascii_lower(needle))


def trim_white(text: Column) -> Column:
    """Strips all Unicode white space, which SQL's trim does not."""
    return F.regexp_replace(text, f"^[{_WHITE}]+|[{_WHITE}]+$", "")


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Bytes from start to end as text; null where they are not valid UTF-8."""
    raw = F.substring(F.encode(text, "UTF-8"), start.cast("int") + 1, (end - start).cast("int"))
    return F.try_validate_utf8(raw.cast("string"))


def is_boundary(text: Column, offset: Column) -> Column:
    """Whether a byte offset lies between characters; the end of the text counts."""
    byte = F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), offset.cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    size = F.octet_length(text)
    return (offset == size) | ((offset >= 0) & (offset < size) & (byte.bitwiseAND(F.lit(0xC0)) != 0x80))


def occurrence_offsets(text: Column, surface: Column) -> Column:
    """Byte offsets of the non-overlapping occurrences from left to right; none of an empty surface."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(surface, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    parts = F.when(F.length(surface) > 0, F.split(text, quoted))
    size = F.octet_length(surface)
    none = F.array().cast("array<bigint>")
    # a running sum over what lies between the occurrences
    running = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1),
        F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("found")),
        lambda acc, p: F.struct(
            (acc["at"] + F.octet_length(p) + size).cast("bigint").alias("at"),
            F.concat(acc["found"], F.array((acc["at"] + F.octet_length(p)).cast("bigint"))).alias("found"),
        ),
    )
    return F.coalesce(running["found"], none)


def occurrences(text: Column, surface: Column) -> Column:
    """Non-overlapping occurrences from left to right, by the length that removing them takes away."""
    return F.when(
        F.length(surface) > 0, ((F.length(text) - F.length(F.replace(text, surface, F.lit("")))) / F.length(surface)).cast("bigint")
    ).otherwise(F.lit(0).cast("bigint"))


def quote_prefix(text: Column, start: Column, size: int = LIMITS["context_chars"]) -> Column:
    return F.right(byte_slice(text, F.lit(0), start), F.lit(size))


def quote_suffix(text: Column, end: Column, size: int = LIMITS["context_chars"]) -> Column:
    return F.left(byte_slice(text, end, F.octet_length(text)), F.lit(size))


def name_error(name: Column) -> Column:
    """Why an entry name is invalid, null when it is valid: after trimming, 1 to 96 bytes, no control or path characters."""
    trimmed = trim_white(name)
    bad = F.octet_length(trimmed) > LIMITS["name_bytes"]
    return F.when(F.length(trimmed) == 0, "EmptyName").when(bad | trimmed.rlike(r'[\p{Cc}/\\<>:"|?*]'), "InvalidName")


def graphemes(text: Column) -> Column:
    """User-perceived characters."""
    return F.regexp_extract_all(text, F.lit(r"(\X)"), 1)


def digest(text: Column) -> Column:
    """Content digest as lowercase hex (SHA-256)."""
    return F.sha2(text.cast("binary"), 256)


def stable_id(*parts: Column) -> Column:
    """A positive-or-negative non-zero 64-bit id from the digest of its parts."""
    head = F.conv(F.left(F.sha2(F.concat_ws(":", *parts), 256), F.lit(16)), 16, -10).cast("bigint")
    return F.when(head == 0, F.lit(1).cast("bigint")).otherwise(head)


def generation_stem(generation: Column) -> Column:
    return F.concat(F.lit("generation-"), F.lpad(F.lower(F.hex(generation)), 16, "0"))


def align_up(value: Column, alignment: int = 64) -> Column:
    return (value + (alignment - 1)).bitwiseAND(F.lit(-alignment).cast("bigint"))
