"""Exact deduplication by a content sort, with DataFrame functions only.

1. Texts are normalised: each run of white space becomes one space.
2. Sampled splitters deal rows to ranges of normalised text. A splitter holds a
   text's first ``HEAD_CHARS`` characters, its 64-bit mark and a slot, so samples stay
   small however long texts are, and texts with one beginning still part.
3. Each range is sorted externally by its whole texts, then by identifier, so
   equal texts are adjacent. The window over (text) compares each row's full text
   with its neighbour's and closes the group where they differ; a mark never
   decides that two texts are equal.
4. A mark with more than ``SLOT_ROWS`` rows, and with more than one row in
   ``HOT_SHARE``, is counted beforehand and its rows dealt to slots by their
   identifier, so a group of copies of any size is sorted by many tasks. Each
   slot hands on one row a text; these are compared as whole texts again, and what
   they say of the text's group goes back to its rows.

Rows of several slots find their text's totals by its SHA-256. There are at
most ``HOT_SHARE`` marks with slots and twice as many slots, whatever the
table's size, so both small tables are broadcast.

Defined results: a null text counts as empty, and empty texts are copies of
each other. Identifiers sort with nulls last, so a null one is kept only if the
group has no other; keep_id is then null. Of rows that share text and
identifier one is kept. An empty table gives no rows. Texts of any length are
compared whole. Other columns, whatever their names, stay out of the way:
``mark_copies`` reads the two it is told, and ``drop_copies`` hands rows back
as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

#: Characters of a text that a splitter may hold.
HEAD_CHARS = 48
#: Rows of one text that are sorted in one slot, at least.
SLOT_ROWS = 1_000
#: A text gets slots when it has more than one in so many of all rows.
HOT_SHARE = 100_000


def normalised(text: Column) -> Column:
    """White space of ASCII in runs becomes one space; null becomes empty.

    Single characters are replaced first, so only texts with longer runs meet a
    regular expression.
    """
    spaced = F.coalesce(text.cast("string"), F.lit(""))
    for space in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    return F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced)


def _slots(texts: DataFrame) -> DataFrame:
    """(mark, slots) of the marks that have too many rows for one slot."""
    counted = written(texts.groupBy("mark").agg(F.count("*").alias("n")).where(F.col("n") > SLOT_ROWS), "marks")
    if not counted.limit(1).count():
        return counted.select("mark", F.lit(1).cast("bigint").alias("slots"))
    share = F.greatest(F.lit(SLOT_ROWS), F.ceil(F.lit(texts.count() / HOT_SHARE))).cast("bigint")
    return counted.where(F.col("n") > share).select("mark", F.ceil(F.col("n") / share).cast("bigint").alias("slots"))


def _sorted_copies(rows: DataFrame, copy_id: Column, text: Column, payload: Column | None = None) -> DataFrame:
    """copy_id, keep_id, group_size, kept and text_sha256 of each row, and its payload."""
    body = normalised(text).alias("body")
    texts = rows.select(copy_id.alias("copy_id"), body, *([] if payload is None else [payload.alias("payload")]))
    texts = texts.withColumn("mark", F.xxhash64("body"))
    hot = F.broadcast(_slots(texts.select("mark")))
    slot = F.coalesce(F.pmod(F.xxhash64("copy_id"), F.col("slots")), F.lit(0))
    dealt = texts.join(hot, "mark", "left").withColumn("slot", slot).withColumn("head", F.substring("body", 1, HEAD_CHARS))
    ranged = dealt.repartitionByRange("head", "mark", "slot")
    # one order serves the marks of first rows and the totals
    order = Window.partitionBy("head", "mark", "slot", "body").orderBy(F.col("copy_id").asc_nulls_last())
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.row_number().over(order) == 1
    found = ranged.select(
        "copy_id",
        F.min("copy_id").over(group).alias("keep_id"),
        F.count("*").over(group).alias("group_size"),
        first.alias("kept"),
        F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"),
        "slot",
        F.when(first & (F.col("slots") > 1), F.col("body")).alias("hot_body"),
        (F.coalesce("slots", F.lit(1)) > 1).alias("hot"),
        *([] if payload is None else ["payload"]),
    )
    found = written(found, "copies")
    # what the slots of one text say, compared as whole texts once more
    order = Window.partitionBy("hot_body").orderBy(F.col("keep_id").asc_nulls_last(), "slot")
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = found.where("hot and kept").withColumn("rank", F.row_number().over(order)).withColumn("all_rows", F.sum("group_size").over(group))
    heads = heads.where("rank = 1")
    whole = heads.select("text_sha256", F.col("keep_id").alias("all_id"), "all_rows", F.col("slot").alias("all_slot"))
    joined = found.join(F.broadcast(whole), "text_sha256", "left")
    return joined.select(
        "copy_id",
        F.when(F.col("hot"), F.col("all_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(F.col("hot"), F.col("all_rows")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("kept") & (~F.col("hot") | (F.col("slot") == F.col("all_slot")))).alias("kept"),
        "text_sha256",
        *([] if payload is None else ["payload"]),
    )


def mark_copies(rows: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Identifier, keep_id, group_size, kept and text_sha256 of every row."""
    found = _sorted_copies(rows, rows[id_column], rows[text_column])
    return found.select(F.col("copy_id").alias(id_column), "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(rows: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    found = _sorted_copies(rows, rows[id_column], rows[text_column], F.struct(*(rows[c] for c in rows.columns)))
    return found.where("kept").select("payload.*")


def op12_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(read_table(spark, sf_dir, "documents"))
