"""Rules, lookups, stored forms and commands: queries whose rows SQL states one by one."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.functions import geometry
from meshwork.functions.masks import bit_for, split_words, unsigned_order
from meshwork.operators import anchors as spans
from meshwork.operators import diff, index, logs, pages, paths, registry, scene, slots, tree, validate, views, workflow
from meshwork.sources import documents, generators, store
from meshwork.sources.shared import new_path
from meshwork.sources.tables import PART_BASE, edge_rows, entities, entries, mentions, ner_batch, node_rows, nodes, table
from meshwork.streaming.appliers import POINTER_OUTPUT, pointer_events
from meshwork.types import ENTITY_SCHEMA, LIMITS, MENTION_SCHEMA

from .registering import Book
from .registry_queries import BATCH_SQL, ENTITIES_SQL, ENTRIES_SQL, MENTIONS_SQL
from .scene_queries import EDGES_SQL, NODES_SQL

BOOK = Book()
COPY = 1_000_000_000_000  # place of a row that stands a second time


def _found(frame: DataFrame) -> DataFrame:
    return frame.select("rule", "entity_id", "detail")


# Rules of snapshots, diffs, trees and batches, over tables in which some rows are made to break them.


@BOOK.add(f"""
WITH n AS (SELECT id FROM ({NODES_SQL})), nn AS (SELECT id FROM n UNION ALL SELECT id FROM n WHERE id % 997 = 5),
  e AS (SELECT id, CASE WHEN id % 307 = 1 THEN 0 ELSE source END AS source, CASE WHEN id % 401 = 2 THEN 0 ELSE target END AS target FROM ({EDGES_SQL})),
  ee AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE id % 499 = 3)
SELECT 'InvalidNodeVisual' AS rule, id AS entity_id, NULL::VARCHAR AS detail FROM nn WHERE id % 101 = 7 OR id % 103 = 9
UNION ALL SELECT 'DuplicateNode', id, NULL FROM n WHERE id % 997 = 5
UNION ALL SELECT 'InvalidEdgeVisual', id, NULL FROM ee WHERE id % 211 = 3
UNION ALL SELECT 'DuplicateEdge', id, NULL FROM e WHERE id % 499 = 3
UNION ALL SELECT 'MissingSourceNode', id, source::VARCHAR FROM ee WHERE source NOT IN (SELECT id FROM n)
UNION ALL SELECT 'MissingTargetNode', id, target::VARCHAR FROM ee WHERE target NOT IN (SELECT id FROM n)""")
def snapshot_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    color = F.array(*(F.lit(c) for c in (0.2, 0.4, 0.8, 1.0))).alias("color")
    some = lambda df, share: df.unionByName(df.where(share).withColumn("ord", F.col("ord") + COPY))
    x = F.when(F.col("id") % 101 == 7, F.lit(math.nan)).otherwise(F.lit(1.0))
    radius = F.when(F.col("id") % 103 == 9, F.lit(-1.0)).otherwise(F.lit(1.0))
    zero = F.lit(0.0)
    points = node_rows(spark, sf_dir).select("id", F.col("id").alias("ord"), x.alias("x"), zero.alias("y"), zero.alias("z"), radius.alias("radius"), color)
    width = F.when(F.col("id") % 211 == 3, F.lit(math.inf)).otherwise(F.lit(1.0))
    source = F.when(F.col("id") % 307 == 1, F.lit(0)).otherwise(F.col("source"))
    target = F.when(F.col("id") % 401 == 2, F.lit(0)).otherwise(F.col("target"))
    links = edge_rows(spark, sf_dir).select("id", F.col("id").alias("ord"), source.alias("source"), target.alias("target"), width.alias("width"), color)
    return _found(validate.snapshot_violations(some(points, F.col("id") % 997 == 5), some(links, F.col("id") % 499 == 3)))


@BOOK.add(f"""
WITH n AS (SELECT id FROM ({NODES_SQL})), e AS (SELECT id, source, target FROM ({EDGES_SQL})), gone AS (SELECT id FROM n WHERE id % 10 = 1 OR id % 70 = 0),
  after AS (SELECT id FROM n WHERE id NOT IN (SELECT id FROM gone))
SELECT 'ConflictingNodeMutation' AS rule, id AS entity_id, NULL::VARCHAR AS detail FROM n WHERE id % 70 = 0
UNION ALL SELECT 'NodeAlreadyExists', id, NULL FROM n WHERE id % 10 = 2
UNION ALL SELECT 'NodeNotFound', id + 5000000000, NULL FROM n WHERE id % 10 = 3
UNION ALL SELECT 'EdgeNotFound', id + 7000000000000, NULL FROM e WHERE id % 1024 = 5
UNION ALL SELECT 'MissingSourceNode', id, source::VARCHAR FROM e WHERE id % 16 = 8 AND source NOT IN (SELECT id FROM after)
UNION ALL SELECT 'MissingTargetNode', id, target::VARCHAR FROM e WHERE id % 16 = 8 AND target NOT IN (SELECT id FROM after)
UNION ALL SELECT 'IncidentEdgeNotRemoved', source, id::VARCHAR FROM e WHERE id % 16 NOT IN (0, 8) AND source IN (SELECT id FROM gone)
UNION ALL SELECT 'IncidentEdgeNotRemoved', target, id::VARCHAR FROM e WHERE id % 16 NOT IN (0, 8) AND target IN (SELECT id FROM gone)""")
def diff_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, links = node_rows(spark, sf_dir).select("id"), edge_rows(spark, sf_dir).select("id", "source", "target")
    lane = lambda df, op, by=0, place=0: df.withColumns({"id": F.col("id") + by, "ord": F.col("id") + place, "op": F.lit(op), "revision": F.lit(2).cast("bigint")})
    node_changes = validate.union([
        lane(points.where("id % 10 = 0"), "update"), lane(points.where("id % 10 = 1"), "remove"), lane(points.where("id % 10 = 2"), "add"),
        lane(points.where("id % 10 = 3"), "update", by=5_000_000_000), lane(points.where("id % 70 = 0"), "remove", place=COPY),
    ])
    edge_changes = validate.union([lane(links.where("id % 16 = 0"), "remove"), lane(links.where("id % 16 = 8"), "update"), lane(links.where("id % 1024 = 5"), "remove", by=7_000_000_000_000)])
    return _found(diff.diff_violations(points, links, node_changes, edge_changes, current=1))


TREE_SQL = """
  SELECT 1::BIGINT AS id, 0::BIGINT AS parent, 'folder' AS kind, 'World' AS name
  UNION ALL SELECT r_regionkey + 10, 1, 'folder', r_name FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey + 10, 'folder', n_name FROM nation
  UNION ALL SELECT s_suppkey + 1000000, s_nationkey + 100, 'note', s_name FROM supplier"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as folders, suppliers as notes."""
    row = lambda name, key, base, parent, kind, label: table(spark, sf_dir, name).select(
        (F.col(key).cast("bigint") + base).alias("id"), parent.cast("bigint").alias("parent"), F.lit(kind).alias("kind"), F.col(label).alias("name"))
    root = spark.range(1).select(F.lit(1).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("parent"), F.lit("folder").alias("kind"), F.lit("World").alias("name"))
    return validate.union([
        root, row("region", "r_regionkey", 10, F.lit(1), "folder", "r_name"), row("nation", "n_nationkey", 100, F.col("n_regionkey") + 10, "folder", "n_name"),
        row("supplier", "s_suppkey", 1_000_000, F.col("s_nationkey") + 100, "note", "s_name"),
    ])


@BOOK.add(f"""
WITH RECURSIVE t AS (SELECT id, CASE WHEN id > 1000 AND id % 11 = 0 THEN 77 ELSE parent END AS parent, kind,
    CASE WHEN id > 1000 AND id % 7 = 0 THEN 'a:' || name WHEN id > 1000 AND id % 5 = 0 THEN 'Same' ELSE name END AS name FROM ({TREE_SQL})),
  r AS (SELECT * FROM t UNION ALL SELECT * FROM t WHERE id > 1000 AND id % 17 = 0),
  w AS (SELECT id FROM t WHERE id = 1 UNION SELECT t.id FROM t JOIN w ON t.parent = w.id)
SELECT 'DuplicateEntry' AS rule, id AS entity_id FROM r GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'InvalidName', id FROM r WHERE regexp_matches(name, '[:]') OR strlen(name) > 96
UNION ALL SELECT 'MissingParent', id FROM r WHERE parent = 77
UNION ALL SELECT 'DuplicateName', max(id) FROM r GROUP BY parent, lower(name) HAVING count(*) > 1
UNION ALL SELECT 'InvalidManifest', id FROM r WHERE id NOT IN (SELECT id FROM w)""")
def stored_tree_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("id") > 1000
    rows = _tree(spark, sf_dir).withColumn("parent", F.when(low & (F.col("id") % 11 == 0), F.lit(77).cast("bigint")).otherwise(F.col("parent")))
    name = F.when(low & (F.col("id") % 7 == 0), F.concat(F.lit("a:"), "name")).when(low & (F.col("id") % 5 == 0), "Same").otherwise(F.col("name"))
    rows = rows.withColumn("name", name)
    return tree.tree_violations(rows.unionByName(rows.where(low & (F.col("id") % 17 == 0)))).select("rule", "entity_id")


@BOOK.add(f"""
WITH b0 AS ({BATCH_SQL}), b1 AS (SELECT stable_id, kind, CASE WHEN stable_id % 8 = 3 THEN ' ' || label WHEN stable_id % 3 = 0 THEN label || '!' ELSE label END AS label,
    CASE WHEN stable_id % 2 = 0 THEN NULL ELSE custom_kind END AS custom_kind, CASE WHEN stable_id % 10 = 6 THEN 0 ELSE mention_count END AS mention_count FROM b0),
  b AS (SELECT * FROM b1 UNION ALL SELECT * FROM b1 WHERE stable_id % 9 = 4), e AS ({ENTITIES_SQL})
SELECT 'DuplicateNerIdentity' AS rule, stable_id AS entity_id FROM b1 WHERE stable_id % 9 = 4
UNION ALL SELECT 'InvalidEntityKind', stable_id FROM b WHERE kind = 'custom' AND custom_kind IS NULL
UNION ALL SELECT 'InvalidNerEntity', stable_id FROM b WHERE label LIKE ' %' OR mention_count = 0
UNION ALL SELECT 'EntityIdentityConflict', stable_id FROM b JOIN e ON e.id = b.stable_id WHERE user_tagged AND (e.label, e.kind, e.custom_kind) IS DISTINCT FROM (b.label, b.kind, b.custom_kind)""")
def entity_batch_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("stable_id")
    batch = ner_batch(spark, sf_dir).withColumns({
        "label": F.when(k % 8 == 3, F.concat(F.lit(" "), "label")).when(k % 3 == 0, F.concat("label", F.lit("!"))).otherwise(F.col("label")),
        "custom_kind": F.when(k % 2 == 0, F.lit(None)).otherwise(F.col("custom_kind")),
        "mention_count": F.when(k % 10 == 6, F.lit(0)).otherwise(F.col("mention_count")),
    })
    return registry.ner_violations(entities(spark, sf_dir), batch.unionByName(batch.where("stable_id % 9 = 4"))).select("rule", "entity_id")


@BOOK.add(f"""
WITH p AS (SELECT n_nationkey AS k, ['positions', 'edge', 'guides', 'topology'][(n_nationkey % 4)::INT + 1] AS kind, CASE WHEN n_nationkey % 3 <> 0 THEN 'hopf' END AS manifold,
    (4096 + n_nationkey * 128 + CASE WHEN n_nationkey % 7 = 3 THEN 8 ELSE 0 END)::BIGINT AS o, (CASE WHEN n_nationkey % 5 = 0 THEN 200 WHEN n_nationkey = 23 THEN {LIMITS["page_bytes"]} + 1 ELSE 100 END)::BIGINT AS len FROM nation),
  q AS (SELECT *, lag(o + len) OVER (ORDER BY o) AS before FROM p)
SELECT 'InvalidPageScope' AS rule, o AS entity_id FROM p WHERE (kind IN ('positions', 'guides')) <> (manifold IS NOT NULL)
UNION ALL SELECT 'OversizedPage', o FROM p WHERE len > {LIMITS["page_bytes"]} UNION ALL SELECT 'MisalignedPage', o FROM p WHERE o % 64 <> 0
UNION ALL SELECT 'PageOutOfBounds', o FROM p WHERE o < 4224 OR o + len > 8000 UNION ALL SELECT 'OverlappingPages', o FROM q WHERE o < before""")
def page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    kinds = F.array(*(F.lit(x) for x in ("positions", "edge", "guides", "topology")))
    length = F.when(k % 5 == 0, 200).when(k == 23, LIMITS["page_bytes"] + 1).otherwise(100)
    rows = table(spark, sf_dir, "nation").select(
        F.element_at(kinds, (k % 4 + 1).cast("int")).alias("kind"), F.when(k % 3 != 0, "hopf").alias("manifold"),
        (k * 128 + 4096 + F.when(k % 7 == 3, 8).otherwise(0)).alias("offset"), length.cast("bigint").alias("length"),
    )
    return pages.page_violations(rows, 4224, 8000).select("rule", "entity_id")


_STATES = ("SAVE BLOCKED: disk", "Saved", "CONFIRM delete", "Loading", "GRAPH BLOCKED", "BLOCKED")
_RULES = ("MissingPage", "OversizedArchive", "UnsupportedPageVersion", "CorruptPage", "HotPageBudgetExceeded", "MissingArchive", "UnsupportedFormatVersion")


@BOOK.add(f"""
WITH e AS (SELECT event_id, {list(_STATES)}[(event_id % 6)::INT + 1] AS status, {list(_RULES)}[(event_id % 7)::INT + 1] AS rule FROM events)
SELECT event_id, regexp_matches(status, '^(BLOCKED|SAVE BLOCKED|GRAPH BLOCKED|CONFIRM)') AS act,
  CASE WHEN rule LIKE 'Missing%' THEN 'MISSING' WHEN rule LIKE 'Oversized%' OR rule LIKE 'Hot%' THEN 'OVERSIZED' WHEN rule LIKE 'Unsupported%' THEN 'UNSUPPORTED' ELSE 'CORRUPT' END AS class FROM e""")
def status_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names: F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("event_id") % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", pages.actionable(pick(_STATES)).alias("act"), pages.error_class(pick(_RULES)).alias("class"))


@BOOK.add("""
WITH c AS (SELECT c_custkey AS id, (c_custkey * 977)::BIGINT AS slots FROM customer), a AS (SELECT *, pow(2, ceil(log2(greatest(slots, 1))))::BIGINT AS capacity FROM c)
SELECT id, capacity, capacity * 48 AS bytes, CASE WHEN slots * 48 > 10000000 THEN 'DeviceBufferLimit' END AS error, CASE WHEN id % 50 <> 0 THEN slots + 1 END AS next FROM a""")
def buffer_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey").cast("bigint") * 977).alias("slots"), F.lit("nodes").alias("name"))
    sized = pages.allocation(rows.select("name", "slots").distinct(), {"nodes": 48}).distinct()
    last = F.when(F.col("id") % 50 == 0, F.lit((1 << 63) - 1)).otherwise(F.col("slots"))
    out = rows.withColumn("capacity", slots.next_power(F.col("slots"))).join(sized, "capacity")
    return out.select("id", "capacity", "bytes", slots.buffer_error(F.col("slots"), F.lit(48), F.lit(10_000_000)).alias("error"), slots.next_revision(last).alias("next"))


@BOOK.add("""
WITH p AS (SELECT n_nationkey AS k, n_nationkey / 20.0::DOUBLE AS c FROM nation) SELECT 'InvalidPalette' AS rule, k AS entity_id FROM p WHERE c > 1 OR k % 6 = 5""")
def palette_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(k.alias("family_slot"), F.array(F.lit(0.5), k / F.lit(20.0), F.when(k % 6 == 5, F.lit(math.nan)).otherwise(F.lit(1.0))).alias("channels"))
    return pages.palette_violations(rows).select("rule", "entity_id")


@BOOK.add("""
WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey * 7 % 300 - 3 END AS ref, p_partkey % 90 AS first, p_partkey % 13 + 1 AS n FROM part)
SELECT 'reference' AS what, id FROM p WHERE ref < 0 OR ref >= 250 UNION ALL SELECT 'range', id FROM p WHERE first + n > 95""")
def reference_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("bigint")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 5 != 0, k * 7 % 300 - 3).alias("ref"), k.alias("stroke"), (k % 90).alias("first_point"), (k % 13 + 1).alias("point_count"))
    bad = index.bad_references(rows, "ref", 250).select(F.lit("reference").alias("what"), "id")
    return bad.unionByName(paths.range_violations(rows, 95).select(F.lit("range").alias("what"), "id"))


# Publication: one writer, monotonic generations, and what a reader then opens.


def _publish(spark: SparkSession, sf_dir: str) -> tuple[store.GenerationStore, list[tuple]]:
    """Registry, full scene, then a registry and a stale scene that are refused; with the outcome of each."""
    placed = nodes(spark, sf_dir)
    identity = placed.select("slot", "id", F.col("kind").cast("int").alias("kind"))
    product = placed.select("slot", F.col("id").alias("node_id"), "family_mask", "scope_mask", "review_mask")
    edge = slots.assign_slots(edge_rows(spark, sf_dir).select("id").distinct(), "id")
    layout = placed.select("slot", F.lit("hybrid").alias("manifold"), F.col("slot").cast("double").alias("x"))
    registry_tables = {"node_identity": identity, "node_product": product}
    full = registry_tables | {"positions": layout, "edge": edge}
    scenes = store.GenerationStore(spark, new_path(spark, "scenes"))
    outcomes = []
    for attempt, (generation, kind, tables) in enumerate(((1, store.REGISTRY_ONLY, registry_tables), (2, store.FULL, full), (3, store.REGISTRY_ONLY, registry_tables), (2, store.FULL, full))):
        try:
            receipt = scenes.publish(generation, kind, attempt, tables)
            outcomes.append((attempt, "published", receipt.generation, receipt.node_count, receipt.edge_count))
        except store.PublicationError as error:
            outcomes.append((attempt, str(error).split("(")[0], scenes.current_receipt().generation, 0, 0))
    return scenes, outcomes


_EDGE_COUNT = f"(SELECT count(DISTINCT id) FROM ({EDGES_SQL}))"


@BOOK.add(f"""
WITH n AS (SELECT count(*) AS n FROM ({NODES_SQL}))
SELECT 0::BIGINT AS attempt, 'published' AS outcome, 1::BIGINT AS generation, n AS nodes, 0::BIGINT AS edges FROM n UNION ALL SELECT 1, 'published', 2, n, {_EDGE_COUNT} FROM n
UNION ALL SELECT 2, 'FullGenerationProtected', 2, 0, 0 UNION ALL SELECT 3, 'StaleGeneration', 2, 0, 0""")
def publication_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, outcomes = _publish(spark, sf_dir)
    return spark.createDataFrame(outcomes, "attempt bigint, outcome string, generation bigint, nodes bigint, edges bigint")


@BOOK.add(f"""
SELECT row_number() OVER (ORDER BY id) - 1 AS slot, id, kind::BIGINT AS kind, family_mask, (row_number() OVER (ORDER BY id) - 1)::DOUBLE AS x FROM ({NODES_SQL})""")
def published_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes, _ = _publish(spark, sf_dir)
    opened = scenes.open_current()
    rows = scene.assemble_nodes(opened["node_identity"], opened["node_product"].select("slot", "family_mask"), opened["positions"], "hybrid")
    return rows.select("slot", "id", F.col("kind").cast("bigint").alias("kind"), "family_mask", "x")


@BOOK.add(f"""
SELECT 'node' AS what, id, 1::BIGINT << kind AS family_mask, -1::BIGINT AS scope_mask, NULL::BIGINT AS relation_mask, 1::BIGINT AS review_mask, 7::BIGINT AS generation FROM ({NODES_SQL})
UNION ALL SELECT 'edge', id, 1::BIGINT << kind, -1, 1::BIGINT << kind, 1, 7 FROM ({EDGES_SQL})""")
def index_from_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, links = index.from_scene(node_rows(spark, sf_dir), edge_rows(spark, sf_dir))
    bound = index.binding(spark.createDataFrame([(7, "hash")], "generation bigint, cohort_hash string"))
    rows = points.select(F.lit("node").alias("what"), F.col("node_id").alias("id"), "family_mask", "scope_mask", F.lit(None).cast("bigint").alias("relation_mask"), "review_mask")
    rows = rows.unionByName(links.select(F.lit("edge").alias("what"), F.col("edge_id").alias("id"), "family_mask", "scope_mask", "relation_mask", "review_mask"))
    return rows.withColumn("generation", F.lit(bound.first().binding.generation).cast("bigint"))


# Documents under leases, tags, batches.


@BOOK.add("""
WITH d AS (SELECT doc_id AS entry_id, CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END AS revision, CASE WHEN doc_id % 3 <> 0 THEN coalesce(text, '') ELSE '' END AS held, coalesce(text, '') AS text FROM documents),
  s AS (SELECT *, CASE WHEN entry_id % 5 = 0 OR entry_id % 7 = 0 THEN 'StaleDocumentLease' WHEN entry_id % 4 = 0 THEN 'unchanged' ELSE 'saved' END AS outcome FROM d)
SELECT entry_id, outcome, (revision + (outcome = 'saved')::INT)::BIGINT AS revision, sha256(CASE WHEN outcome = 'saved' THEN text || '!' ELSE held END) AS content_hash FROM s""")
def document_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("entry_id")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.coalesce("text", F.lit("")).alias("content"))
    held = texts.where(k % 3 != 0).select("entry_id", F.lit(1).cast("bigint").alias("revision"), F.sha2("content", 256).alias("content_hash"), "content")
    tokens = documents.leases(held, texts).withColumnRenamed("content", "old").join(texts, "entry_id")
    saves = tokens.select(
        "entry_id", F.when(k % 5 == 0, F.lit(9)).otherwise(F.col("revision")).cast("bigint").alias("revision"), F.when(k % 7 == 0, "x").otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(k % 4 == 0, F.col("old")).otherwise(F.concat("content", F.lit("!"))).alias("content"),
    )
    after = documents.leases(documents.commit_all(held, saves), texts).select("entry_id", "revision", "content_hash")
    return documents.judged(held, saves).select("entry_id", "outcome").join(after, "entry_id")


@BOOK.add(f"""
WITH m AS ({MENTIONS_SQL}) SELECT entity_id, document, start, "end", (start % 3)::BIGINT AS document_revision FROM m WHERE active AND start % 3 = document % 3""")
def lease_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mentions(spark, sf_dir).withColumns({"document_revision": F.col("start") % 3, "content_hash": F.concat(F.lit("h"), F.col("document"))})
    held = spark.range(1, 41).select(F.col("id").alias("document"), (F.col("id") % 3).alias("document_revision"), F.concat(F.lit("h"), F.col("id")).alias("content_hash"))
    return spans.for_lease(rows, held).select("entity_id", "document", "start", "end", "document_revision")


@BOOK.add("""
WITH b AS (SELECT item_id + 1 AS document, text, strpos(text, ' ') - 1 AS n FROM benchmark WHERE item_id < 2)
SELECT document, CASE document WHEN 1 THEN 11 ELSE 0 END::BIGINT AS start, (n + CASE document WHEN 1 THEN 11 ELSE 0 END)::BIGINT AS "end", left(text, n) AS surface, true AS active,
  CASE document WHEN 1 THEN 3 ELSE 2 END::BIGINT AS document_revision, 'location' AS kind FROM b""")
def tag_and_save_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents are saved, their first words tagged twice, then the first one is saved with a new beginning."""
    texts = {r.item_id + 1: r.text for r in table(spark, sf_dir, "benchmark").where("item_id < 2").collect()}
    held = spark.createDataFrame([(i, 1, "", "") for i in texts], "entry_id bigint, revision bigint, content_hash string, content string").withColumn("content_hash", F.sha2("content", 256))
    w = workflow.Workspace(held, spark.createDataFrame([], ENTITY_SCHEMA), spark.createDataFrame([], MENTION_SCHEMA))
    for entry, text in sorted(texts.items()):
        token = documents.lease(w.documents, entry).first()
        w = workflow.save_document(w, entry, token.revision, token.content_hash, text)
        for kind in ("character", "location"):
            w, _ = workflow.tag(w, entry, 0, text.index(" "), kind)
    token = documents.lease(w.documents, 1).first()
    w = workflow.save_document(w, 1, token.revision, token.content_hash, "Yesterday, " + texts[1])
    kinds = w.entities.select(F.col("id").alias("entity_id"), "kind")
    return w.mentions.join(kinds, "entity_id").select("document", "start", "end", "surface", "active", "document_revision", "kind")


@BOOK.add(f"""
WITH e AS ({ENTITIES_SQL}), b AS ({BATCH_SQL})
SELECT coalesce(e.id, b.stable_id) AS id, b.stable_id IS NOT NULL AS ner, coalesce(b.mention_count, 0) AS mention_count, 3::BIGINT AS ner_revision, 2::BIGINT AS revision
FROM e FULL JOIN b ON e.id = b.stable_id WHERE b.stable_id IS NOT NULL OR e.user_tagged""")
def entity_batch_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    registered = entities(spark, sf_dir).withColumn("origin_document", F.lit(None).cast("bigint"))
    empty = spark.createDataFrame([], "entry_id bigint, revision bigint, content_hash string, content string")
    w = workflow.publish_entities(workflow.Workspace(empty, registered, spark.createDataFrame([], MENTION_SCHEMA)), 3, ner_batch(spark, sf_dir))
    return w.entities.select("id", "sources.ner", F.col("ner_mention_count").alias("mention_count"), F.lit(w.ner_revision).cast("bigint").alias("ner_revision"), F.lit(w.revision).cast("bigint").alias("revision"))


@BOOK.add(f"""
WITH e AS ({ENTITIES_SQL}) SELECT id, NOT ner AND NOT user_tagged AS sourceless, CASE WHEN id % 3 = 0 THEN kind WHEN id % 3 = 1 THEN NULL ELSE 'npc' END AS native FROM e""")
def entity_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entities(spark, sf_dir)
    labels = F.when(F.col("id") % 3 == 0, F.upper("kind")).when(F.col("id") % 3 == 1, F.lit("Person")).otherwise(F.lit("NPC"))
    return rows.select("id", registry.without_source().alias("sourceless"), registry.native_kind(labels).alias("native"))


# Trees: commands and lookups.


@BOOK.add(f"""
WITH RECURSIVE t AS ({TREE_SQL}), gone AS (SELECT id FROM t WHERE id = 12 UNION SELECT t.id FROM t JOIN gone ON t.parent = gone.id)
SELECT id, parent, kind, CASE WHEN id = 100 THEN 'Renamed' ELSE name END AS name FROM t WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 5000000, 10, 'folder', 'Drafts' UNION ALL SELECT 5000001, 5000000, 'note', 'Chapter 1'""")
def workspace_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tree(spark, sf_dir)
    rows = tree.create(rows, 10, "folder", " Drafts ", 5_000_000, limit=None)
    rows = tree.create(rows, 5_000_000, "note", "Chapter 1", 5_000_001, limit=None)
    rows = tree.rename(rows, 100, "Renamed")
    return tree.delete(rows, rows.where("id = 12").select("id")).select("id", "parent", "kind", "name")


@BOOK.add(f"""
WITH t AS ({ENTRIES_SQL}), r AS (SELECT event_id AS request, CASE event_id % 3 WHEN 0 THEN 80 + user_id % 50 WHEN 1 THEN 1000000 + user_id * 11 ELSE 100000000 + event_id END AS id FROM events)
SELECT request, r.id, t.name, CASE WHEN t.id IS NULL THEN 'MissingEntry' END AS error, CASE WHEN t.id IS NULL THEN 'MissingEntry' WHEN t.kind <> 'note' THEN 'NotNote' END AS note_error,
       CASE WHEN t.kind = 'folder' THEN t.id ELSE t.parent END AS home FROM r LEFT JOIN t USING (id)""")
def entry_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of many requests finds in the tree."""
    k = F.col("event_id")
    wanted = F.when(k % 3 == 0, F.col("user_id") % 50 + 80).when(k % 3 == 1, F.col("user_id") * 11 + 1_000_000).otherwise(k + 100_000_000)
    requests = table(spark, sf_dir, "events").select(k.alias("request"), wanted.alias("id"))
    return tree.find_entries(entries(spark, sf_dir), requests).select("request", "id", "name", "error", "note_error", "home")


_NAME_REQUESTS_SQL = """
  SELECT event_id AS request, 10 + event_id % 5 AS parent, CASE WHEN event_id % 2 = 0 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN event_id % 7 = 0 THEN 100 + n_nationkey ELSE 0 END AS besides
  FROM events JOIN nation ON n_nationkey = user_id % 25"""


@BOOK.add(f"""
WITH t AS ({ENTRIES_SQL}), w AS ({_NAME_REQUESTS_SQL})
SELECT request, parent, name FROM w WHERE EXISTS (SELECT 1 FROM t WHERE t.parent = w.parent AND lower(t.name) = lower(w.name) AND t.id <> w.besides)""")
def taken_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of many new names a sibling has already."""
    k = F.col("event_id")
    joined = table(spark, sf_dir, "events").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("user_id") % 25)
    wanted = joined.select(
        k.alias("request"), (k % 5 + 10).alias("parent"), F.when(k % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"), F.when(k % 7 == 0, F.col("n_nationkey") + 100).otherwise(0).alias("besides")
    )
    return tree.names_taken(entries(spark, sf_dir), wanted).select("request", "parent", "name")


@BOOK.add(f"SELECT parent, min(id) AS id FROM ({ENTRIES_SQL}) WHERE kind = 'note' GROUP BY parent")
def first_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.first_notes(entries(spark, sf_dir))


@BOOK.add(f"SELECT id, CASE WHEN kind = 'note' THEN id END AS document FROM ({ENTRIES_SQL})")
def active_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.active_document(entries(spark, sf_dir))


# Stored forms: JSON documents written and read again.


@BOOK.add(f"""
SELECT 'stored' AS source, id, parent, kind, name FROM ({TREE_SQL})
UNION ALL SELECT 'seed', * FROM (VALUES (1, 0, 'folder', 'Workspace'), (2, 1, 'folder', 'Notes'), (3, 2, 'note', 'Welcome'), (4, 1, 'folder', 'Research'), (5, 4, 'note', 'Graph notes'))""")
def stored_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "workspace")
    documents.write_json(_tree(spark, sf_dir), "entries", path, revision=1)
    loaded = documents.load_or_seed(spark, path).withColumn("source", F.lit("stored"))
    seeded = documents.load_or_seed(spark, new_path(spark, "nothing-here")).withColumn("source", F.lit("seed"))
    return loaded.unionByName(seeded)


@BOOK.add(f"WITH e AS ({BATCH_SQL}) SELECT stable_id AS id, label, kind, custom_kind, stable_id % 2 = 0 AS ner, stable_id % 2 = 1 AS user_tagged, CASE WHEN stable_id % 2 = 0 THEN mention_count ELSE 0 END AS n FROM e")
def stored_registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities without sources, from before those existed, are read as tagged by a user."""
    new = F.col("stable_id") % 2 == 0
    rows = ner_batch(spark, sf_dir).select(
        F.col("stable_id").alias("id"), "label", "kind", "custom_kind", F.when(new, F.struct(F.lit(True).alias("ner"), F.lit(False).alias("user_tagged"))).alias("sources"),
        F.when(new, F.col("mention_count")).alias("ner_mention_count"),
    )
    path = new_path(spark, "registry")
    documents.write_json(rows, "entities", path, revision=4, ner_revision=2)
    found, _ = documents.read_registry(spark, path)
    return found.select("id", "label", "kind", "custom_kind", "sources.ner", "sources.user_tagged", F.col("ner_mention_count").alias("n"))


@BOOK.add("""
SELECT 'node' AS what, n_nationkey + 1 AS id, n_nationkey * 0.5::DOUBLE AS x, n_regionkey AS kind, NULL::BIGINT AS target FROM nation
UNION ALL SELECT 'edge', s_suppkey, 1.0, 0, s_nationkey + 1 FROM supplier""")
def stored_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    color = F.array(*(F.lit(c).cast("float") for c in (0, 0, 0, 1))).alias("color")
    k = F.col("n_nationkey").cast("bigint")
    position = F.array((k * 0.5).cast("float"), F.lit(0).cast("float"), F.lit(0).cast("float"))
    points = table(spark, sf_dir, "nation").select(
        (k + 1).alias("id"), position.alias("position"), F.lit(1).cast("float").alias("radius"), color, F.col("n_regionkey").cast("int").alias("kind"), F.lit(0).alias("flags"))
    links = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("bigint").alias("id"), F.lit(1).cast("bigint").alias("source"), (F.col("s_nationkey").cast("bigint") + 1).alias("target"), F.lit(1).cast("float").alias("width"), color, F.lit(0).alias("kind"), F.lit(0).alias("flags"))
    path = new_path(spark, "snapshot")
    for name, rows in (("nodes", points), ("edges", links)):
        documents.write_json(rows, name, f"{path}/{name}", revision=3)
    points, links = documents.read_snapshot(spark, f"{path}/*")
    big = lambda c: F.col(c).cast("bigint").alias(c)
    rows = points.select(F.lit("node").alias("what"), "id", F.col("x").cast("double").alias("x"), big("kind"), F.lit(None).cast("bigint").alias("target"))
    return rows.unionByName(links.select(F.lit("edge").alias("what"), "id", F.col("width").cast("double").alias("x"), big("kind"), "target"))


# Masks, order, lookups, views, cameras.


@BOOK.add("""
WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 4294967296 + c_custkey ELSE -c_custkey - 1 END AS id FROM customer)
SELECT id, row_number() OVER (ORDER BY id < 0, id) - 1 AS place, id & 4294967295 AS low, (id >> 32) & 4294967295 AS high, CASE WHEN k % 70 < 63 THEN 1::BIGINT << (k % 70)::INT WHEN k % 70 = 63 THEN -9223372036854775808 END AS bit FROM c""")
def unsigned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("bigint")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), F.when(k % 2 == 0, k * 4294967296 + k).otherwise(-k - 1).alias("id"))
    placed = slots.assign_slots(rows.withColumn("key", unsigned_order(F.col("id"))), "key", "place")
    low, high = split_words(F.col("id"))
    return placed.select("id", F.col("place").cast("bigint").alias("place"), low.alias("low"), high.alias("high"), bit_for(F.col("k") % 70).alias("bit"))


@BOOK.add("SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey * 1000003) - 1 AS slot FROM customer WHERE c_acctbal > 0")
def selection_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey").cast("bigint") * 1000003).alias("key"))
    return slots.assign_slots(rows, "key").select("id", F.col("slot").cast("bigint").alias("slot"))


@BOOK.add("""
WITH e AS (SELECT user_id, event_id, event_id * 37 % 101 AS s FROM events), w AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e)
SELECT user_id AS lane, event_id AS arrival, s AS sequence, before FROM w WHERE s <= before""")
def sequence_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("lane"), F.col("event_id").alias("arrival"), (F.col("event_id") * 37 % 101).alias("sequence"))
    return logs.order_breaks(rows, "lane").select("lane", "arrival", "sequence", "before")


@BOOK.add("""
SELECT p_partkey AS slot, p_partkey % 2 = 0 AS live, CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 20000001 ELSE 0 END AS id, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END::BIGINT AS size FROM part""")
def dirty_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("slot"), (F.col("p_partkey").cast("bigint") + PART_BASE).alias("id"), F.col("p_size").cast("bigint").alias("size"))
    return scene.project_dirty(part.where("slot % 2 = 0"), part.select("slot"))


@BOOK.add("SELECT s_suppkey * 2 AS entity_id, p_partkey + 20000001 AS node_id FROM supplier JOIN part ON p_partkey = s_suppkey * 2")
def entity_node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("entity_id"), (F.col("p_partkey").cast("bigint") + PART_BASE).alias("node_id"))
    return index.entity_nodes(mapped, table(spark, sf_dir, "supplier").select((F.col("s_suppkey").cast("bigint") * 2).alias("entity_id")))


_VIEWS_SQL = """
  s AS (SELECT r_regionkey AS scene_id, r_regionkey % 3 + 1 AS generation, 'c' || (r_regionkey % 3 + 1) AS cohort_hash, CASE WHEN r_regionkey <> 1 THEN 'i' || (r_regionkey % 3 + 1) END AS index_hash FROM region),
  v AS (SELECT event_id AS view_id, user_id AS session, event_id AS sequence, user_id % 6 AS scene_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id % 8 + 1 END AS families,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 4 END AS generation, event_id % 5 AS style_revision, CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE value - 5 END AS node_scale FROM events),
  w AS (SELECT v.*, families = -1 AS unfiltered,
               CASE WHEN s.scene_id IS NULL THEN 'StaleGraphViewAuthority' WHEN families <> -1 AND s.index_hash IS NULL THEN 'ProductIndexRequiredForFilteredView'
                    WHEN v.generation IS DISTINCT FROM s.generation OR 'c' || v.generation IS DISTINCT FROM s.cohort_hash OR CASE WHEN v.scene_id <> 1 THEN 'i' || v.generation END IS DISTINCT FROM s.index_hash THEN 'StaleGraphViewAuthority' END AS error,
               CASE WHEN NOT (style_revision <> 0 AND isfinite(node_scale) AND node_scale > 0) THEN 'InvalidStyle' END AS style_error FROM v LEFT JOIN s USING (scene_id))"""


def _checked_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that users ask for, against scenes of which one has no product index and one is not there."""
    number = (F.col("r_regionkey") % 3 + 1).cast("bigint")
    scenes = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("bigint").alias("scene_id"), number.alias("generation"), F.concat(F.lit("c"), number).alias("cohort_hash"),
        F.when(F.col("r_regionkey") != 1, F.concat(F.lit("i"), number)).alias("index_hash"),
    )
    k, generation = F.col("event_id"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 4)
    full = views.bound_views(scenes).select("scene_id", *views.MASKS[1:], "reviews")
    asked = table(spark, sf_dir, "events").select(
        k.alias("view_id"), F.col("user_id").alias("session"), k.alias("sequence"), (F.col("user_id") % 6).alias("scene_id"), F.when(k % 3 == 0, -1).otherwise(k % 8 + 1).alias("families"), generation.alias("generation"),
        F.concat(F.lit("c"), generation).alias("cohort_hash"), F.when(F.col("user_id") % 6 != 1, F.concat(F.lit("i"), generation)).alias("index_hash"),
        (k % 5).alias("style_revision"), F.when(k % 11 == 0, float("nan")).otherwise(F.col("value") - 5).alias("node_scale"),
    )
    masks = {**{m: F.coalesce(m, F.lit(-1)) for m in views.MASKS[1:]}, "reviews": F.coalesce("reviews", F.lit(7))}
    return views.checked_views(asked.join(full, "scene_id", "left").withColumns(masks), scenes)


@BOOK.add(f"WITH {_VIEWS_SQL} SELECT view_id, unfiltered, error, style_error FROM w")
def view_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked_views(spark, sf_dir).select("view_id", "unfiltered", "error", "style_error")


@BOOK.add(f"WITH {_VIEWS_SQL} SELECT session, arg_max(view_id, sequence) AS view_id FROM w WHERE error IS NULL AND style_error IS NULL GROUP BY session")
def applied_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.applied_views(_checked_views(spark, sf_dir))


@BOOK.add(f"""
WITH c AS (SELECT event_id AS k, user_id * 0.05::DOUBLE AS yaw, greatest(0.2 - event_id % 30 * 0.1::DOUBLE, -({math.pi / 2 - 0.01!r})) AS pitch, greatest(100 * exp(event_id % 40 * -0.12::DOUBLE), 0.05) AS distance, event_id % 90 AS dx FROM events)
SELECT k, round(100 * cos(pitch) * sin(yaw), 6) AS x, round(100 * sin(pitch), 6) AS y, round(100 * cos(pitch) * cos(yaw), 6) AS z, round(distance, 6) AS distance,
  round(-cos(pitch) * sin(yaw), 6) AS ray_x, round(-sin(pitch), 6) AS ray_y, round(-cos(pitch) * cos(yaw), 6) AS ray_z,
  round(-cos(yaw) * dx * 200 * tan({math.pi / 8!r}) / 900, 6) AS pan_x, round(sin(yaw) * dx * 200 * tan({math.pi / 8!r}) / 900, 6) AS pan_z FROM c""")
def camera_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default camera moved by each event: eye, middle ray, zoomed distance and shifted target."""
    k, lens = F.col("event_id"), geometry.Lens()
    pose = geometry.Pose.default().turned(F.col("user_id") * 10.0, k % 30 * 20.0)
    origin, direction = pose.ray(F.lit(lens.width / 2), F.lit(lens.height / 2), lens)
    target = pose.shifted((k % 90).cast("double"), F.lit(0.0), lens).target
    told = {"x": origin[0], "y": origin[1], "z": origin[2], "distance": pose.zoomed((k % 40).cast("double")).distance, "ray_x": direction[0], "ray_y": direction[1], "ray_z": direction[2], "pan_x": target[0], "pan_z": target[2]}
    return table(spark, sf_dir, "events").select(k.alias("k"), *(F.round(c, 6).alias(name) for name, c in told.items()))


# Generators: closed formulas row by row, random ones by what must hold of them.


@BOOK.add("""
WITH n AS (SELECT count(*) AS n FROM customer), i AS (SELECT c_custkey AS i, n FROM customer, n)
SELECT 'node' AS what, i + 1 AS id, round(i * 8.0::DOUBLE - 4.0::DOUBLE * n, 6) AS x, round(sin(i * 0.1::DOUBLE) * 50, 6) AS y, round(cos(i * 0.15::DOUBLE) * 20, 6) AS z FROM i
UNION ALL SELECT 'edge', i + 1, i + 1, i + 2, NULL FROM i WHERE i + 1 < n
UNION ALL SELECT 'spoke', i + 1, (i + 1 + greatest(n // 500, 1) - 1) % greatest(n // 500, 1) + 1, i + 1 + greatest(n // 500, 1), NULL FROM i WHERE i + 1 <= n - greatest(n // 500, 1)""")
def topology_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers laid out as a chain, with the links of a chain and of hubs."""
    ids = table(spark, sf_dir, "customer").select((F.col("c_custkey").cast("bigint") + 1).alias("id"))  # keys count from 0
    count = ids.count()
    points = generators.random_nodes(spark, "chain", count, ids=ids).select(F.lit("node").alias("what"), "id", *(F.round(a, 6).alias(a) for a in "xyz"))
    ends = lambda name, df: df.select(F.lit(name).alias("what"), "id", F.col("source").cast("double").alias("x"), F.col("target").cast("double").alias("y"), F.lit(None).cast("double").alias("z"))
    return validate.union([points, ends("edge", generators.topology_edges(spark, "chain", count, ids)), ends("spoke", generators.topology_edges(spark, "hubs", count, ids))])


@BOOK.add("""
WITH n AS (SELECT count(*) AS n FROM customer)
SELECT t.name, t.rows, true AS holds, t.kinds, t.edges FROM n, LATERAL (VALUES ('uniform', n, 1::BIGINT, 0::BIGINT), ('clustered', n, greatest(n // 250, 3), 0), ('hubs', n, 2, n - greatest(n // 500, 1)), ('chain', n, 1, n - 1),
  ('communities', n, greatest(n // 200, 2), 0), ('edges', 5 * n, 0, 5 * n), ('lane', ceil(n * 0.1004::DOUBLE)::BIGINT, 0, 0)) t(name, rows, kinds, edges)""")
def topology_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every customer in each random topology."""
    ids = table(spark, sf_dir, "customer").select((F.col("c_custkey").cast("bigint") + 1).alias("id"))  # keys count from 0
    count = ids.count()
    side, communities = math.sqrt(count), generators.groups_of("communities", count)
    near = lambda x, y, reach: (F.abs(F.col("x") - x) <= reach) & (F.abs(F.col("y") - y) <= reach)
    turn = F.col("kind") * (2 * math.pi / communities)
    radius = {"uniform": (1.0, 3.5), "clustered": (1.2, 3.0), "hubs": (1.0, 8.0), "chain": (2.0, 2.0), "communities": (1.5, 3.2)}
    holds = {
        "uniform": near(F.lit(0), F.lit(0), 5 * side) & (F.abs("z") <= side), "clustered": near(F.lit(0), F.lit(0), 8 * side + 40),
        "hubs": (F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) <= 271) & (F.abs("z") <= 10), "chain": F.col("x") == (F.col("id") - 1) * 8.0 - 4.0 * count,
        "communities": near(F.cos(turn) * 6 * side, F.sin(turn) * 6 * side, 40.000001) & (F.abs("z") <= 15),
    }
    rows = []
    for name in generators.TOPOLOGIES:
        made = generators.random_nodes(spark, name, count, ids=ids).withColumn("good", holds[name] & F.col("radius").between(*radius[name]))
        found = made.agg(F.count("*").alias("rows"), F.min("good").alias("holds"), F.count_distinct("kind").alias("kinds"))
        edges = generators.topology_edges(spark, name, count, ids).agg(F.count("*").alias("edges"))
        rows.append(found.crossJoin(edges).select(F.lit(name).alias("name"), "*"))  # one row by one row
    drawn = generators.random_edges(spark, count, 5 * count)
    rows.append(drawn.agg(F.count_distinct("source", "target").alias("rows"), F.min(F.col("source") != F.col("target")).alias("holds"), F.lit(0).cast("bigint").alias("kinds"), F.count("*").alias("edges")).select(F.lit("edges").alias("name"), "*"))
    start = generators.random_nodes(spark, "uniform", count, ids=ids)
    moved = generators.jitter(start, 0.1004, 2).select("id", F.col("x").alias("new_x"), F.col("z").alias("new_z")).join(start, "id")
    good = (F.abs(F.col("new_x") - F.col("x")) <= 1.5) & (F.col("new_z") == F.col("z"))
    rows.append(moved.agg(F.count("*").alias("rows"), F.min(good).alias("holds"), F.lit(0).cast("bigint").alias("kinds"), F.lit(0).cast("bigint").alias("edges")).select(F.lit("lane").alias("name"), "*"))
    return validate.union(rows)


# The pointer machine as a stream that is read to its end.


@BOOK.add("""
WITH i AS (SELECT user_id AS session, event_id AS sequence, CASE event_id % 6 WHEN 0 THEN 'press' WHEN 3 THEN 'release' WHEN 5 THEN 'wheel' ELSE 'move' END AS input, (event_id * 3 % 7)::DOUBLE AS x, (event_id * 5 % 11)::DOUBLE AS y FROM events),
  a AS (SELECT *, count(*) FILTER (input = 'press') OVER (PARTITION BY session ORDER BY sequence) AS press FROM i),
  b AS (SELECT *, press > 0 AND count(*) FILTER (input = 'release') OVER (PARTITION BY session, press ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 AS down,
    (x - first_value(x) OVER w) ** 2 + (y - first_value(y) OVER w) ** 2 >= 16 AS away FROM a WINDOW w AS (PARTITION BY session, press ORDER BY sequence)),
  c AS (SELECT *, coalesce(max(down AND away AND input = 'move') OVER (PARTITION BY session, press ORDER BY sequence), false) AS dragging FROM b),
  d AS (SELECT session, sequence, CASE input WHEN 'wheel' THEN 'zoom' WHEN 'release' THEN CASE WHEN down AND dragging THEN 'drag_end' WHEN down THEN 'select' END
    WHEN 'move' THEN CASE WHEN down AND dragging THEN 'drag' WHEN NOT down THEN 'hover' END END AS event, x, y FROM c)
SELECT * FROM d WHERE event IS NOT NULL""")
def pointer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    kind = F.when(k % 6 == 0, "press").when(k % 6 == 3, "release").when(k % 6 == 5, "wheel").otherwise("move")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint").alias("number")
    inputs = table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("session"), number, k.alias("sequence"), kind.alias("input"), (k * 3 % 7).cast("double").alias("x"), (k * 5 % 11).cast("double").alias("y"))
    folder, out = new_path(spark, "pointer"), new_path(spark, "pointer-events")
    inputs.repartition(4, F.xxhash64("sequence")).write.parquet(folder)  # as they may come: out of order
    stream = pointer_events(spark.readStream.schema(inputs.schema).parquet(folder))
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", new_path(spark, "pointer-progress")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(POINTER_OUTPUT).parquet(out)
