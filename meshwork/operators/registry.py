"""The entity registry: atlas, tagging, named-entity batches, re-anchoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.functions.masks import bit_for
from meshwork.functions.text import ascii_lower, byte_slice, contains_ascii_ci, is_boundary, occurrence_offsets, occurrences, quote_prefix, quote_suffix, stable_id, trim_white
from meshwork.types import ENTITY_KINDS, FAMILIES, LIMITS

from .dealing import stored
from .intervals import overlap_neighbours, overlap_pairs
from .validate import union, violations


def kind_rows(spark: SparkSession) -> DataFrame:
    """kind, kind_label, family and toolbar place; seven rows."""
    return spark.createDataFrame([(k, label, family, i) for i, (k, label, family) in enumerate(ENTITY_KINDS)], "kind string, kind_label string, family string, place int")


def family_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, s, p, q) for f, s, p, q in FAMILIES], "family string, family_slot int, primary_rgb bigint, secondary_rgb bigint")


def mention_counts(mentions: DataFrame) -> DataFrame:
    return mentions.where("active").groupBy("entity_id").agg(F.count("*").alias("n"))


def atlas(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities with their kind's label and all mentions: active ones and those that the batch reported."""
    counts = mention_counts(mentions).withColumnRenamed("entity_id", "id")
    kinds = F.broadcast(kind_rows(entities.sparkSession).select("kind", "kind_label"))  # seven rows
    total = F.coalesce("n", F.lit(0)) + F.col("ner_mention_count")
    return entities.join(counts, "id", "left").join(kinds, "kind").select("id", "label", "kind", "kind_label", "sources", total.alias("mention_count"))


def source_counts(entities: DataFrame) -> DataFrame:
    return entities.agg(F.count_if("sources.ner").alias("ner"), F.count_if("sources.user_tagged").alias("user_tagged"))


def kind_summary(entities: DataFrame) -> DataFrame:
    """Entities per kind with the kind's place in the toolbar; kinds without entities do not appear."""
    counts = entities.groupBy("kind").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(kind_rows(entities.sparkSession)), "kind").select("place", "kind", "n")


def search(entities: DataFrame, query: str) -> DataFrame:
    """Entities whose label, kind or custom kind contains the query, ignoring ASCII case; a blank query matches all."""
    query = query.strip()
    if not query:
        return entities
    kinds = F.broadcast(kind_rows(entities.sparkSession).select("kind", "kind_label"))
    hit = contains_ascii_ci(F.col("label"), F.lit(query)) | contains_ascii_ci(F.col("kind_label"), F.lit(query))
    hit = hit | F.coalesce(contains_ascii_ci(F.col("custom_kind"), F.lit(query)), F.lit(False))
    return entities.join(kinds, "kind").where(hit).drop("kind_label")


def without_source(sources: str = "sources") -> Column:
    """Whether neither a batch nor a user stands behind an entity."""
    return ~F.col(f"{sources}.ner") & ~F.col(f"{sources}.user_tagged")


def native_kind(label: Column) -> Column:
    """The registry's kind for a toolbar label, ignoring ASCII case; null when there is none."""
    kinds = [F.when(ascii_lower(label) == shown.lower(), kind) for kind, shown, _ in ENTITY_KINDS]
    return F.coalesce(*kinds)


def source_flags(sources: str = "sources") -> Column:
    return F.col(f"{sources}.ner").cast("int") + F.shiftleft(F.col(f"{sources}.user_tagged").cast("int"), 1)


def ner_conflicts(entities: DataFrame, batch: DataFrame) -> DataFrame:
    """Ids that users tagged and the batch names otherwise."""
    tagged = entities.where("sources.user_tagged").select(F.col("id").alias("stable_id"), F.col("label").alias("l"), F.col("kind").alias("k"), F.col("custom_kind").alias("c"))
    joined = batch.join(tagged, "stable_id")
    same = F.col("label").eqNullSafe(F.col("l")) & F.col("kind").eqNullSafe(F.col("k")) & F.col("custom_kind").eqNullSafe(F.col("c"))
    return joined.where(~same).select("stable_id")


def ner_violations(entities: DataFrame, batch: DataFrame) -> DataFrame:
    """Rules of an incoming batch: duplicate ids, invalid records, conflicts with tagged entities."""
    again = batch.groupBy("stable_id").agg(F.count("*").alias("n")).where("n > 1")
    custom = F.col("kind") == "custom"
    kind_bad = custom & (F.col("custom_kind").isNull() | (F.length(trim_white(F.col("custom_kind"))) == 0) | (F.octet_length(trim_white(F.col("custom_kind"))) > LIMITS["custom_kind_bytes"]))
    kind_bad = kind_bad | (~custom & F.col("custom_kind").isNotNull())
    bad = (F.col("stable_id") == 0) | (F.length(trim_white(F.col("label"))) == 0) | (F.col("label") != trim_white(F.col("label")))
    bad = bad | (F.octet_length("label") > LIMITS["surface_bytes"]) | (F.col("mention_count") == 0)
    return union(
        [
            violations(again, "DuplicateNerIdentity", F.lit(True), "stable_id", F.col("stable_id"), 0),
            violations(batch, "InvalidEntityKind", kind_bad, "stable_id", F.col("stable_id"), 1),
            violations(batch, "InvalidNerEntity", bad, "stable_id", F.col("stable_id"), 1),
            violations(ner_conflicts(entities, batch), "EntityIdentityConflict", F.lit(True), "stable_id", F.col("stable_id"), 1),
        ]
    )


def ner_merge(entities: DataFrame, batch: DataFrame) -> DataFrame:
    """The registry after a valid batch: its entities come or are rewritten; of the others, only tagged ones stay."""
    b = batch.select(F.col("stable_id").alias("id"), F.col("label").alias("b_label"), F.col("kind").alias("b_kind"), F.col("custom_kind").alias("b_custom"), "mention_count")
    joined = entities.join(b, "id", "full_outer")
    hit = F.col("mention_count").isNotNull()
    pick = lambda new, old: F.when(hit, F.col(new)).otherwise(F.col(old))
    tagged = F.coalesce("sources.user_tagged", F.lit(False))
    extra = [c for c in entities.columns if c not in ("id", "label", "kind", "custom_kind", "sources", "ner_mention_count")]
    merged = joined.select(
        "id",
        pick("b_label", "label").alias("label"),
        pick("b_kind", "kind").alias("kind"),
        pick("b_custom", "custom_kind").alias("custom_kind"),
        F.struct(hit.alias("ner"), tagged.alias("user_tagged")).alias("sources"),
        F.coalesce("mention_count", F.lit(0)).cast("bigint").alias("ner_mention_count"),
        *extra,
    )
    return merged.where("sources.ner or sources.user_tagged")


def tag_evictions(mentions: DataFrame, tags: DataFrame) -> DataFrame:
    """Active mentions with each new tag (document, tag_start, tag_end) that overlaps them."""
    spans = tags.withColumnsRenamed({"tag_start": "other_start", "tag_end": "other_end"})
    met = overlap_pairs(mentions.where("active"), spans, "document")
    return met.withColumnsRenamed({"other_start": "tag_start", "other_end": "tag_end"})


def eviction_totals(mentions: DataFrame, tags: DataFrame) -> DataFrame:
    """Of each span (document, start, end) of active mentions: pairs with overlapping tags (document, sequence, tag_start, tag_end), the first tag and the shared length.

    Equal spans meet equal tags once, with their numbers, so work follows the distinct spans of a
    document and not the pairs of rows.
    """
    spans = mentions.where("active").groupBy("document", "start", "end").agg(F.count("*").alias("_mentions")).withColumn("active", F.lit(True))
    distinct = tags.groupBy("document", "tag_start", "tag_end").agg(F.count("*").alias("_tags"), F.min("sequence").alias("sequence"))
    pairs = F.col("_mentions") * F.col("_tags")
    shared = F.least("end", "tag_end") - F.greatest("start", "tag_start")
    met = tag_evictions(spans, distinct)
    return met.groupBy("document", "start", "end").agg(F.sum(pairs).alias("n_tags"), F.min("sequence").alias("first_tag"), F.sum(pairs * shared).alias("shared"))


def fold_tags(tags: DataFrame) -> DataFrame:
    """What a sequence of tags (document, sequence, start, end, ...) leaves behind, all documents at once.

    A tag evicts every active mention that it overlaps, and takes over the entity of
    one with its very span; else it makes an entity. So a tag's entity is that of the
    overlapping tag just before it if both spans are equal, and a mention stays active
    until the first overlapping tag after it. Mentions that are there already count
    as tags with lower sequences. Adds ``is_new``, ``first`` (the sequence of the tag
    that made the entity), ``entity_id``, ``active`` and ``evicted_by``.
    """
    tags = stored(tags, "tags")  # read many times below
    near = overlap_neighbours(tags, "document", "sequence")
    before = tags.select("document", F.col("sequence").alias("previous"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    same = (F.col("_start") == F.col("start")) & (F.col("_end") == F.col("end"))
    told = near.join(before, ["document", "previous"], "left").withColumn("is_new", ~F.coalesce(same, F.lit(False)))
    made = F.when(F.col("is_new"), F.col("sequence"))
    chain = Window.partitionBy("document", "start", "end").orderBy("sequence")
    told = told.withColumn("first", F.last(made, ignorenulls=True).over(chain))
    parts = (F.col(c).cast("string") for c in ("document", "start", "end", "first"))
    return told.withColumns({"entity_id": stable_id(*parts), "active": F.col("next").isNull(), "evicted_by": F.col("next")}).drop("_start", "_end", "previous", "next")


def tagged_entities(folded: DataFrame) -> DataFrame:
    """The entities that tags made or took over, as the last tag of each names them: entity_id, document, surface, kind."""
    last = F.max_by(F.struct("document", "surface", "kind"), "sequence")
    return folded.groupBy("entity_id").agg(last.alias("e")).select("entity_id", "e.*")


def relocate(mentions: DataFrame) -> DataFrame:
    """Mentions (surface, start, end, prefix, suffix, content) placed in their new content.

    The exact place wins, then a single occurrence, then a single one whose
    context matches; else the mention becomes inactive and keeps its place.
    """
    same = is_boundary(F.col("content"), F.col("start")) & is_boundary(F.col("content"), F.col("end"))
    exact = F.coalesce((F.col("end") <= F.octet_length("content")) & same & (byte_slice(F.col("content"), F.col("start"), F.col("end")) == F.col("surface")), F.lit(False))
    placed = mentions.withColumn("exact", exact).withColumn("size", F.octet_length("surface"))
    placed = placed.withColumn("found", occurrence_offsets(F.col("content"), F.col("surface")))
    fits = F.filter(
        "found",
        lambda at: F.endswith(quote_prefix(F.col("content"), at), F.col("prefix")) & F.startswith(quote_suffix(F.col("content"), at + F.col("size")), F.col("suffix")),
    )
    at = F.when(F.col("exact"), F.col("start")).when(F.size("found") == 1, F.element_at("found", 1)).when(F.size(fits) == 1, F.element_at(fits, 1))
    placed = placed.withColumn("at", at)
    active = F.col("at").isNotNull()
    return placed.withColumns(
        {"start": F.coalesce("at", "start"), "end": F.when(active, F.col("at") + F.col("size")).otherwise(F.col("end")).cast("bigint"), "active": active}
    ).drop("exact", "size", "found", "at")


def occurrence_counts(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("n", occurrences(F.col("content"), F.col("surface")))


def publication(entities: DataFrame) -> DataFrame:
    """Rows of a registry scene: node id, family mask, colour and flags of each entity."""
    spark = entities.sparkSession
    kinds = F.broadcast(kind_rows(spark).select("kind", "family"))
    families = F.broadcast(family_rows(spark))
    rows = entities.join(kinds, "kind").join(families, "family")
    return rows.select("id", "label", "family", bit_for(F.col("family_slot")).alias("family_mask"), F.col("primary_rgb").alias("rgb"), source_flags().alias("flags"))
