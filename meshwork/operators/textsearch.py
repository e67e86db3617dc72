"""Search of many queries in many texts.

White space parts texts and queries alike, so a text that contains a query contains its longest
word within one of its own words. Queries are few as a rule: then each task looks up the distinct words of
its texts, most of which it has met before, and no text is shuffled.

Queries too many to broadcast go through an inverted index of character trigrams.
A text that contains a query holds all its trigrams, so each query looks only at the
texts of its rarest one and compares these in full. Queries of one or two
characters are met by grams of their own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from meshwork.functions.text import ascii_lower, trim_white
from meshwork.sources.shared import map_batches

from .dealing import BOUND, dealt_join, stored
from .validate import union

GRAM = 3
#: Grams of queries, and queries, up to this number are broadcast.
BROADCAST_ROWS = 100_000
#: Bytes of all queries up to which these are broadcast.
BROADCAST_BYTES = 8 << 20
#: Words up to this many bytes are remembered by a task, and this many of them.
WORD_BYTES, WORDS = 64, 400_000
#: Bytes of a beginning by which needles are met.
HEAD = 4


def grams(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters, read from left to right once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def find_texts(texts: DataFrame, queries: DataFrame, bound: int = BOUND, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(query_id, id) of each query and text (id, text) that contains it, ignoring ASCII case and white space around the query.

    A blank query is in every text and is not listed; null texts and queries meet nothing.
    ``id`` and ``query_id`` are unique.
    """
    wanted = queries.select("query_id", ascii_lower(trim_white(F.col("query"))).alias("query")).where("length(query) > 0")
    wanted = stored(wanted.withColumn("size", F.least(F.length("query"), F.lit(GRAM))), "queries")
    size = wanted.agg(F.count("*").alias("n"), F.sum(F.octet_length("query")).alias("bytes")).first()
    if not size.n:
        return texts.where("false").select(F.lit(None).cast(wanted.schema["query_id"].dataType).alias("query_id"), "id")
    if size.n <= broadcast_rows and size.bytes <= BROADCAST_BYTES:
        return _scanned(texts, wanted)
    return _indexed(texts.select("id", ascii_lower(F.col("text")).alias("text")).where("text is not null"), wanted, bound)


class _Heads(dict):
    """For each beginning of ``HEAD`` bytes met so far: the numbers of needles that it begins with, and the sizes of those that begin with it."""

    def __init__(self, needles: dict[bytes, tuple[int, ...]]):
        self.needles = needles
        self.sizes: dict[bytes, set[int]] = {}
        for needle in needles:
            if len(needle) > HEAD:
                self.sizes.setdefault(needle[:HEAD], set()).add(len(needle))

    def __missing__(self, head: bytes) -> tuple[tuple[int, ...], tuple[int, ...]]:
        short = {k for size in range(1, len(head) + 1) for k in self.needles.get(head[:size], ())}
        return _kept(self, head, (tuple(short), tuple(self.sizes.get(head, ()))))


class _Held(dict):
    """The numbers of the queries whose longest word lies in a word, for each word met so far."""

    def __init__(self, queries: list[bytes]):
        self.needles: dict[bytes, tuple[int, ...]] = {}
        for k, query in enumerate(queries):
            needle = max(query.split(), key=len)
            self.needles[needle] = (*self.needles.get(needle, ()), k)
        self.heads = _Heads(self.needles)

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found: set[int] = set()
        heads, needles = self.heads, self.needles
        for at in range(len(word)):
            short, sizes = heads[word[at : at + HEAD]]
            if short:
                found.update(short)
            for size in sizes:
                found.update(needles.get(word[at : at + size], ()))
        return _kept(self, word, tuple(found))


def _kept(memory: dict, key: bytes, value: tuple) -> tuple:
    """``value``, remembered unless the key is long."""
    if len(key) <= WORD_BYTES:
        if len(memory) >= WORDS:
            memory.clear()
        memory[key] = value
    return value


def _scanned(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pairs of ``find_texts`` where queries are few enough to be broadcast: a task reads each text once."""
    spark = texts.sparkSession
    rows = wanted.select("query_id", F.col("query").cast("binary").alias("query")).collect()  # at most BROADCAST_ROWS
    shared = spark.sparkContext.broadcast([bytes(r.query) for r in rows])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        held = _Held(queries)
        # a query of several words has only shown one of them
        phrases = {k for k, query in enumerate(queries) if len(query.split()) > 1}
        for batch in batches:
            numbers, sizes = [], []
            for text in batch.column(1):
                text = text.as_py().lower()  # of bytes: ASCII only
                found = set().union(*map(held.__getitem__, set(text.split())))
                found = found.difference(k for k in phrases & found if queries[k] not in text)
                numbers.extend(found)
                sizes.append(len(found))
            at = np.repeat(np.arange(batch.num_rows), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), batch.column(0).take(pa.array(at))], names=["number", "id"])

    pairs = map_batches(
        texts.where("text is not null").select("id", F.col("text").cast("binary").alias("text")), search, StructType([StructField("number", IntegerType()), texts.schema["id"]])
    )
    names = spark.createDataFrame([(k, r.query_id) for k, r in enumerate(rows)], StructType([StructField("number", IntegerType()), wanted.schema["query_id"]]))
    return pairs.join(F.broadcast(names), "number").select("query_id", "id")


def _indexed(lowered: DataFrame, wanted: DataFrame, bound: int) -> DataFrame:
    """The same pairs through the index of grams."""
    sizes = sorted(r.size for r in wanted.select("size").distinct().collect())  # at most GRAM numbers
    exploded = lambda df, column, key, k: df.select(key, F.explode(grams(F.col(column), k)).alias("gram"))
    asked = stored(union([exploded(wanted.where(F.col("size") == k), "query", "query_id", k) for k in sizes]), "query-grams")
    held = union([exploded(lowered, "text", "id", k) for k in sizes])
    postings = stored(held.join(_small(asked.select("gram").distinct()), "gram", "left_semi"), "postings")
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no text holds rules its query out
    rarest = asked.join(counts, "gram", "left").groupBy("query_id").agg(F.min_by(F.struct("gram", "n"), F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("r"))
    rarest = rarest.where("r.n is not null").select("query_id", F.col("r.gram").alias("gram"))
    candidates = dealt_join(postings, rarest, ["gram"], bound).select("query_id", "id")
    candidates = stored(candidates.join(_small(wanted.select("query_id", "query")), "query_id"), "candidates")
    # a query that is one gram is in all texts that hold the gram
    whole = F.length("query") > GRAM
    met = candidates.where(whole).join(lowered, "id").where(F.contains("text", F.col("query")))
    return candidates.where(~whole).select("query_id", "id").unionByName(met.select("query_id", "id"))
