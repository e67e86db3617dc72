"""Commands over documents and the registry, composed of the operators.

Each command writes the tables it changes to the shared folder and returns a
version that reads them, so versions are immutable and plans do not grow.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.functions.text import byte_slice, quote_prefix, quote_suffix, stable_id, trim_white
from meshwork.sources import documents as leases
from meshwork.sources.shared import new_path

from . import registry
from .validate import require_valid


@dataclass(frozen=True)
class Workspace:
    """A version of all that a command reads and writes; commands return a new one."""

    documents: DataFrame
    entities: DataFrame
    mentions: DataFrame
    revision: int = 1
    ner_revision: int = 0
    sequence: int = 0


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _reanchored(mentions: DataFrame, entry: int, lease: DataFrame) -> DataFrame:
    """Mentions of a document placed in its leased content; others unchanged."""
    mine = mentions.where(F.col("document") == entry)
    fields = lease.select(F.col("entry_id").alias("document"), F.col("revision").alias("new_revision"), F.col("content_hash").alias("new_hash"), "content")
    moved = registry.relocate(mine.join(fields, "document"))
    keep = lambda new, old: F.when(F.col("active"), F.col(new)).otherwise(F.col(old)).alias(old)
    moved = moved.withColumn("p", quote_prefix(F.col("content"), F.col("start"))).withColumn("s", quote_suffix(F.col("content"), F.col("end")))
    special = {"document_revision": "new_revision", "content_hash": "new_hash", "prefix": "p", "suffix": "s"}
    moved = moved.select(*(keep(special[c], c) if c in special else F.col(c) for c in mentions.columns))
    return mentions.where(F.col("document") != entry).unionByName(moved)


def save_document(w: Workspace, entry: int, revision: int, content_hash: str, content: str) -> Workspace:
    """Compare-and-set of the content, then all mentions of the document find their new places."""
    saved = _stored(leases.commit(w.documents, entry, revision, content_hash, content), "documents")
    mentions = _stored(_reanchored(w.mentions, entry, leases.lease(saved, entry)), "mentions")
    return replace(w, documents=saved, mentions=mentions, revision=w.revision + 1, sequence=w.sequence + 1)


def tag(w: Workspace, entry: int, start: int, end: int, kind: str, custom_kind: str | None = None) -> tuple[Workspace, int]:
    """Tags a span: an active mention of the same span keeps its entity, overlapped ones go. Returns the entity's id too."""
    lease = leases.lease(w.documents, entry)
    span = lease.select(byte_slice(F.col("content"), F.lit(start), F.lit(end)).alias("surface"), "content", "revision", "content_hash",
                        quote_prefix(F.col("content"), F.lit(start)).alias("prefix"), quote_suffix(F.col("content"), F.lit(end)).alias("suffix"),
                        stable_id(F.lit(entry), F.lit(start), F.lit(end), F.lit(w.revision)).alias("fresh"))
    row = span.withColumn("trimmed", trim_white(F.col("surface"))).first()
    if not row.surface or row.surface != row.trimmed or (kind == "custom") != bool(custom_kind and custom_kind.strip()):
        raise ValueError("InvalidEntityTag")
    custom = custom_kind.strip().upper() if custom_kind else None
    here = w.mentions.where(F.col("active") & (F.col("document") == entry))
    same = here.where((F.col("start") == start) & (F.col("end") == end)).join(w.entities.select(F.col("id").alias("entity_id")), "entity_id").select("entity_id").first()
    spark = w.documents.sparkSession
    if same:
        entity = same.entity_id
        mine = F.col("id") == entity
        sources = F.struct(F.col("sources.ner").alias("ner"), F.lit(True).alias("user_tagged"))
        entities = w.entities.withColumns({
            "label": F.when(mine, F.lit(row.surface)).otherwise(F.col("label")), "kind": F.when(mine, F.lit(kind)).otherwise(F.col("kind")),
            "custom_kind": F.when(mine, F.lit(custom)).otherwise(F.col("custom_kind")), "sources": F.when(mine, sources).otherwise(F.col("sources")),
        })
    else:
        entity = row.fresh
        while not w.entities.where(F.col("id") == entity).isEmpty():
            entity += 1
        entities = w.entities.unionByName(spark.createDataFrame([(entity, row.surface, kind, custom, entry, (False, True), 0)], w.entities.schema))
    tags = spark.createDataFrame([(entry, start, end)], "document bigint, tag_start bigint, tag_end bigint")
    gone = registry.tag_evictions(here, tags).select("document", "start", "end")
    kept = w.mentions.join(gone, ["document", "start", "end"], "left_anti")
    again = (F.col("entity_id") == entity) & (F.col("document") == entry) & (F.col("start") == start) & (F.col("end") == end)
    new = spark.createDataFrame([(entity, entry, row.revision, row.content_hash, start, end, row.surface, row.prefix, row.suffix, True)], w.mentions.schema)
    mentions = kept.where(~again).select(*w.mentions.columns).unionByName(new)
    return replace(w, entities=_stored(entities, "entities"), mentions=_stored(mentions, "mentions"), revision=w.revision + 1, sequence=w.sequence + 1), entity


def publish_entities(w: Workspace, ner_revision: int, batch: DataFrame) -> Workspace:
    """A named-entity batch: stale revisions and invalid batches change nothing."""
    if ner_revision <= w.ner_revision:
        raise ValueError(f"StaleNerRevision({w.ner_revision}, {ner_revision})")
    require_valid(registry.ner_violations(w.entities, batch))
    return replace(w, entities=_stored(registry.ner_merge(w.entities, batch), "entities"), ner_revision=ner_revision, revision=w.revision + 1, sequence=w.sequence + 1)
