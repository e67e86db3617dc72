"""Pieces that the training-data operators share.

Intermediate tables are written to the folder that ``spark.checkpoint.dir``
names, which driver and executors share, so a lost executor costs a re-read
and not a recomputation of the lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.sources.shared import map_batches, new_path

__all__ = ["components", "crc_mod", "map_batches", "new_path", "read_table", "skewed_join", "unused", "written"]

#: A key with more than one in so many rows is hot in a join; so many rows of the other side are broadcast at most.
HOT_ROWS = 2_000
#: Keys with fewer rows than this are never hot.
LEAST_HOT = 1_000

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it while ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(column: Column, modulus: int) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def skewed_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has at most one row a key; both are read several times. Hot keys are not shuffled.

    Keys that hold more than one in ``HOT_ROWS`` of the rows of ``many`` are
    counted first (there are fewer than that), and their rows of ``one`` are
    broadcast. Null keys of a left join never meet a partner and stay apart.
    """
    counts = written(many.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= LEAST_HOT), "key-counts")
    rows = many.count()
    hot = written(counts.where(F.col("count") * HOT_ROWS > rows).select(key), "hot")
    if not hot.limit(1).count():
        return many.join(one, key, how)
    hot = F.broadcast(hot)
    few = written(one.join(hot, key, "left_semi"), "hot-rows")
    apart = many.join(hot, key, "left_semi").join(F.broadcast(few), key, how)
    rest = many.join(hot, key, "left_anti").join(one, key, how)
    return rest.unionByName(apart)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of the undirected edges (a, b), both bigint.

    Returns (node, component) for every node that has an edge to another one;
    component is the smallest node of its component. Alternates large-star and
    small-star steps, each a minimum per node and a join, so no neighbour list
    is ever gathered; every round is written and its edges compared by a sum.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = written(pairs.distinct(), label)
    before = None
    while True:
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = mark
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Every edge now runs from a larger node to a smaller one.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        small = small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        pairs = written(small, label)
