"""Snapshots, workspaces and registries as JSON, and documents under leases."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions.text import digest
from meshwork.operators.slots import assign_slots
from meshwork.types import ENTITY_SCHEMA, ENTRY_SCHEMA, LIMITS, MENTION_SCHEMA, SNAPSHOT_SCHEMA

#: Rows of one stored document.
DOCUMENT_ROWS = 65_536


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph snapshot in JSON, with ord = place among the stored ones and the revision."""
    rows = spark.read.schema(SNAPSHOT_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    found = []
    for name in ("nodes", "edges"):
        items = rows.select("revision", "first", F.posexplode(name).alias("at", "item")).select("revision", (F.coalesce("first", F.lit(0)) + F.col("at")).alias("ord"), "item.*")
        if name == "nodes":
            items = items.select("*", *(F.element_at("position", k + 1).alias(a) for k, a in enumerate("xyz")))
        found.append(items)
    return found[0], found[1]


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    schema = f"format string, revision bigint, next_id bigint, entries array<struct<{ENTRY_SCHEMA}>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("entries"))


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and mentions; files from before sources existed count all their entities as user-tagged."""
    schema = f"revision bigint, ner_revision bigint, entities array<struct<{ENTITY_SCHEMA}>>, mentions array<struct<{MENTION_SCHEMA}>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    legacy = F.struct(F.lit(False).alias("ner"), F.lit(True).alias("user_tagged"))
    entities = rows.select(F.inline("entities")).withColumn("sources", F.coalesce("sources", legacy)).fillna(0, ["ner_mention_count"])
    return entities, rows.select(F.inline("mentions"))


def seed_entries(spark: SparkSession) -> DataFrame:
    """The tree that a new workspace begins with."""
    # The five entries of a new workspace.
    rows = [(1, 0, "folder", "Workspace"), (2, 1, "folder", "Notes"), (3, 2, "note", "Welcome"), (4, 1, "folder", "Research"), (5, 4, "note", "Graph notes")]
    return spark.createDataFrame(rows, ENTRY_SCHEMA)


def load_or_seed(spark: SparkSession, path: str) -> DataFrame:
    """The tree stored at ``path``; the seed when nothing is there."""
    try:
        return read_entries(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return seed_entries(spark)


def write_json(rows: DataFrame, name: str, path: str, **fields: int) -> None:
    """JSON documents with the fields and up to ``DOCUMENT_ROWS`` rows each under ``name``, in order of the first column: what the readers above read.

    A file holds one document, and ``first`` says at which place its rows begin, so
    documents are written side by side and none grows with the table.
    """
    placed = assign_slots(rows, rows.columns[0], "_place")
    item = F.struct("_place", F.struct(*rows.columns).alias("row"))
    held = F.transform(F.array_sort(F.collect_list(item)), lambda i: i["row"])
    documents = placed.groupBy(F.floor(F.col("_place") / DOCUMENT_ROWS).alias("_document")).agg(F.min("_place").cast("bigint").alias("first"), held.alias(name))
    told = documents.select(*(F.lit(v).alias(k) for k, v in fields.items()), "first", name)
    told.write.option("ignoreNullFields", False).option("maxRecordsPerFile", 1).json(path)


def leases(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """A row (entry_id, revision, content_hash, content) for each entry; a document never saved has revision 0 and no content."""
    found = entries.select("entry_id").distinct().join(documents, "entry_id", "left")
    content = F.coalesce("content", F.lit(""))
    return found.select("entry_id", F.coalesce("revision", F.lit(0)).cast("bigint").alias("revision"), digest(content).alias("content_hash"), content.alias("content"))


def lease(documents: DataFrame, entry: int) -> DataFrame:
    return leases(documents, documents.sparkSession.range(1).select(F.lit(entry).cast("bigint").alias("entry_id")))


def judged(documents: DataFrame, saves: DataFrame) -> DataFrame:
    """``saves`` (entry_id, revision, content_hash, content; one a document) with their outcome.

    A token that is not the document's is stale; equal content changes nothing, also of a document never saved.
    """
    held = leases(documents, saves).select("entry_id", F.col("revision").alias("_revision"), F.col("content_hash").alias("_hash"), F.col("content").alias("_content"))
    fresh = (F.col("revision") == F.col("_revision")) & (F.col("content_hash") == F.col("_hash"))
    outcome = F.when(F.octet_length("content") > LIMITS["document_bytes"], "DocumentTooLarge").when(~fresh, "StaleDocumentLease")
    outcome = outcome.when(F.col("content") == F.col("_content"), "unchanged").otherwise("saved")
    return saves.join(held, "entry_id").withColumn("outcome", outcome).drop("_revision", "_hash", "_content")


def commit_all(documents: DataFrame, saves: DataFrame) -> DataFrame:
    """The documents after all saves whose outcome is ``saved``."""
    good = judged(documents, saves).where("outcome = 'saved'")
    rows = good.select("entry_id", (F.col("revision") + 1).alias("revision"), digest(F.col("content")).alias("content_hash"), "content")
    return documents.join(rows.select("entry_id"), "entry_id", "left_anti").unionByName(rows.select(*documents.columns))


def commit(documents: DataFrame, entry: int, revision: int, content_hash: str, content: str) -> DataFrame:
    """The documents after one save under a lease token (revision, hash)."""
    saves = documents.sparkSession.createDataFrame([(entry, revision, content_hash, content)], "entry_id bigint, revision bigint, content_hash string, content string")
    outcome = judged(documents, saves).first().outcome
    if outcome == "unchanged":
        return documents
    if outcome != "saved":
        raise ValueError(f"{outcome}({entry})")
    return commit_all(documents, saves)
