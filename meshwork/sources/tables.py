"""The warehouse tables read as the scene, registry and log model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions.masks import bit_for
from meshwork.functions.text import occurrence_offsets
from meshwork.operators.dealing import stored
from meshwork.operators.slots import assign_slots
from meshwork.types import ENTITY_KINDS

SUPPLIER_BASE, PART_BASE = 10_000_001, 20_000_001
KEY_WORDS, KEY_CHARACTERS = 3, 3
#: Keys of surfaces up to this number are broadcast; beyond, keys are shuffled.
BROADCAST_ROWS = 100_000
#: Where pairs of texts and surfaces that may meet are no more than this, only their texts are shuffled.
BROADCAST_PAIRS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def review_bit(key: Column) -> Column:
    return bit_for(key % 3)


def node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with their product masks: id, radius, kind, label, family_mask, scope_mask, review_mask."""
    parts = [
        (table(spark, sf_dir, "customer"), "c_custkey", 1, 1, "c_nationkey", "c_name", F.abs("c_acctbal") / 1000 + 1),
        (table(spark, sf_dir, "supplier"), "s_suppkey", SUPPLIER_BASE, 2, "s_nationkey", "s_name", F.abs("s_acctbal") / 1000 + 1),
        (table(spark, sf_dir, "part"), "p_partkey", PART_BASE, 3, None, "p_name", F.col("p_size").cast("double")),
    ]
    rows = []
    for df, key, base, kind, nation, label, radius in parts:
        key = F.col(key).cast("bigint")
        scope = F.col(nation) if nation else key % 25
        rows.append(
            df.select(
                (key + base).alias("id"),
                radius.alias("radius"),
                F.lit(kind).alias("kind"),
                F.col(label).alias("label"),
                bit_for(F.lit(kind)).alias("family_mask"),
                bit_for((scope % 64).cast("int")).alias("scope_mask"),
                review_bit(key).alias("review_mask"),
            )
        )
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_slots(node_rows(spark, sf_dir), "id")


def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges supplier -> part of line items, with product masks; kind by return flag."""
    line = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(3)
    number = F.col("l_linenumber").cast("int")
    return line.select(
        (F.col("l_orderkey").cast("bigint") * 8 + number).alias("id"),
        (F.col("l_suppkey").cast("bigint") + SUPPLIER_BASE).alias("source"),
        (F.col("l_partkey").cast("bigint") + PART_BASE).alias("target"),
        kind.alias("kind"),
        F.col("l_quantity").cast("double").alias("width"),
        bit_for(kind).alias("family_mask"),
        bit_for((F.col("l_suppkey") % 25).cast("int")).alias("scope_mask"),
        bit_for(number % 64).alias("relation_mask"),
        review_bit(F.col("l_orderkey").cast("bigint")).alias("review_mask"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts from vector components: manifold k takes components 3k to 3k + 2; slot = vec_id."""
    vectors = table(spark, sf_dir, "embeddings")
    rows = vectors.select(
        F.col("vec_id").alias("slot"), (F.col("vec_id") + 1).alias("id"), F.col("label").alias("kind"),
        F.explode(F.array(*(
            F.struct(F.lit(name).alias("manifold"), *(F.element_at("embedding", 3 * k + j + 1).cast("double").alias(a) for j, a in enumerate("xyz")))
            for k, name in enumerate(("hybrid", "hopf", "caps", "transit", "siegel"))
        ))).alias("p"),
    )
    return rows.select("slot", "id", "kind", "p.*")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A valid change log: revision = event_id + 1; a user's first of ten events adds, the tenth removes, others update."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    op = F.when(k % 10 == 1, "add").when(k % 10 == 0, "remove").otherwise("update")
    return events.select((F.col("event_id") + 1).alias("revision"), (F.col("user_id") + 1).cast("bigint").alias("id"), op.alias("op"), F.col("value").alias("value"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry entities from nations (ids from 1) and parts (ids from 1001)."""
    kinds = F.array(*(F.lit(k) for k, _, _ in ENTITY_KINDS))
    sources = [
        (table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("bigint"), F.col("n_name"), 1),
        (table(spark, sf_dir, "part"), F.col("p_partkey").cast("bigint"), F.col("p_name"), 1001),
    ]
    rows = []
    for df, key, label, base in sources:
        kind = F.element_at(kinds, (key % 7).cast("int") + 1)
        rows.append(
            df.select(
                (key + base).alias("id"),
                label.alias("label"),
                kind.alias("kind"),
                F.when(kind == "custom", F.lit("TRIBE")).alias("custom_kind"),
                F.struct((key % 3 != 0).alias("ner"), (key % 3 != 1).alias("user_tagged")).alias("sources"),
                F.when(key % 3 != 0, key % 9 + 1).otherwise(0).cast("bigint").alias("ner_mention_count"),
            )
        )
    return rows[0].unionByName(rows[1])


def ner_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming named entities: the nations, under the ids of the registry, and suppliers from 5,000,001."""
    kinds = F.array(*(F.lit(k) for k, _, _ in ENTITY_KINDS))
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    rows = []
    for df, key, label, base in ((nation, F.col("n_nationkey").cast("bigint"), F.col("n_name"), 1), (supplier, F.col("s_suppkey").cast("bigint"), F.col("s_name"), 5_000_001)):
        kind = F.element_at(kinds, (key % 7).cast("int") + 1)
        rows.append(
            df.select(
                (key + base).alias("stable_id"), label.alias("label"), kind.alias("kind"), F.when(kind == "custom", F.lit("TRIBE")).alias("custom_kind"),
                (key % 9 + 1).alias("mention_count"),
            )
        )
    return rows[0].unionByName(rows[1])


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of registry entities: event_id as place; active unless the event's id divides by 5."""
    n = table(spark, sf_dir, "nation").count()
    events = table(spark, sf_dir, "events")
    return events.select(
        (F.col("user_id") % n + 1).cast("bigint").alias("entity_id"),
        (F.col("user_id") % 40 + 1).cast("bigint").alias("document"),
        (F.col("event_id") * 7 % 1000).alias("start"),
        (F.col("event_id") * 7 % 1000 + F.col("event_id") % 13 + 1).alias("end"),
        (F.col("event_id") % 5 != 0).alias("active"),
    )


def _candidates(docs: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(doc_id, item_id) that may hold a surface: no pair that does is missing, and texts meet by key, never all with all.

    Words inside a surface, all but its first and last, are whole words of any
    text that holds it, whatever its ends are glued to: up to ``KEY_WORDS`` of
    them make a key. Surfaces of one or two words are met by their first characters.
    """
    words = lambda c: F.split(c, r"\s+")
    named = surfaces.where(F.length("surface") > 0).withColumn("w", words("surface"))
    inner = F.size("w") - 2
    named = named.withColumn("m", F.when(inner > 0, F.least(inner, F.lit(KEY_WORDS))).otherwise(-F.least(F.length("surface"), F.lit(KEY_CHARACTERS))))
    tokens = docs.select("doc_id", words("content").alias("w"))
    found = []
    for m in sorted(r.m for r in named.select("m").distinct().collect()):  # at most KEY_WORDS + KEY_CHARACTERS numbers
        if m > 0:
            key = lambda parts: F.xxhash64(F.lit(m), *parts).alias("key")
            keys = named.where(F.col("m") == m).select("item_id", key(F.element_at("w", 2 + k) for k in range(m)))
            # shifted copies side by side: functions over each element would cost three times as much
            runs = F.arrays_zip(*(F.slice("w", k + 1, F.greatest(F.size("w") - (m - 1), F.lit(0))).alias(f"_{k}") for k in range(m)))
            grams = tokens.select("doc_id", F.explode(F.when(F.size("w") >= m, runs)).alias("run")).select("doc_id", key(F.col(f"run._{k}") for k in range(m)))
        else:
            keys = named.where(F.col("m") == m).select("item_id", F.left("surface", F.lit(-m)).alias("key"))
            at = F.sequence(F.lit(1), F.length("content") + (m + 1))
            long_enough = docs.where(F.length("content") >= -m)
            grams = long_enough.select("doc_id", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring("content", i, F.lit(-m))))).alias("key"))
        small = keys.count() <= BROADCAST_ROWS
        found.append(grams.join(F.broadcast(keys) if small else keys, "key").select("doc_id", "item_id"))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
    return reduce(DataFrame.unionByName, found).distinct()


def spans_of(docs: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Every place (from left to right, not overlapping) of each surface (item_id, surface) in each text (doc_id, content)."""
    candidates = stored(_candidates(docs, surfaces), "candidates")
    held = candidates.select("doc_id").distinct()
    held = docs.join(F.broadcast(held), "doc_id", "left_semi") if candidates.count() <= BROADCAST_PAIRS else docs
    pairs = candidates.join(surfaces, "item_id").join(held, "doc_id").where(F.contains("content", "surface"))
    start = F.explode(occurrence_offsets(F.col("content"), F.col("surface")))
    placed = pairs.select("doc_id", "item_id", "surface", "content", start.alias("start"))
    return placed.select(
        (F.col("doc_id") + 1).alias("document"), "start", (F.col("start") + F.octet_length("surface")).cast("bigint").alias("end"),
        (F.col("item_id") + 1).alias("node_id"), "surface", "content",
    )


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of benchmark texts within documents, as byte offsets: document, start, end, node_id, surface, content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return spans_of(docs, table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("surface")))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree: root 1, regions 10+, nations 100+, customers 1,000,000+ as folders, orders 100,000,000+ as notes."""
    root = spark.range(1).select(F.lit(1).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("parent"), F.lit("folder").alias("kind"), F.lit("World").alias("name"))
    t = lambda name: table(spark, sf_dir, name)
    big = lambda c: F.col(c).cast("bigint")
    region = t("region").select((big("r_regionkey") + 10).alias("id"), F.lit(1).cast("bigint").alias("parent"), F.lit("folder").alias("kind"), F.col("r_name").alias("name"))
    nation = t("nation").select((big("n_nationkey") + 100).alias("id"), (big("n_regionkey") + 10).alias("parent"), F.lit("folder").alias("kind"), F.col("n_name").alias("name"))
    customer = t("customer").select((big("c_custkey") + 1_000_000).alias("id"), (big("c_nationkey") + 100).alias("parent"), F.lit("folder").alias("kind"), F.col("c_name").alias("name"))
    orders = t("orders").select(
        (big("o_orderkey") + 100_000_000).alias("id"), (big("o_custkey") + 1_000_000).alias("parent"), F.lit("note").alias("kind"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("name")
    )
    return root.unionByName(region).unionByName(nation).unionByName(customer).unionByName(orders)
