"""Registry, anchor, tree and log queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.functions.text import byte_slice, digest, name_error, occurrences, quote_prefix, quote_suffix
from meshwork.operators import anchors as spans
from meshwork.operators import logs, registry, tree
from meshwork.sources.tables import anchors, entities, entries, mentions, ner_batch, table

from .registering import Book

BOOK = Book()
_KIND = "['character','location','npc','faction','event','concept','custom'][(%s %% 7)::INT + 1]"
ENTITIES_SQL = f"""
  SELECT k + base AS id, label, {_KIND % 'k'} AS kind, CASE WHEN k % 7 = 6 THEN 'TRIBE' END AS custom_kind, k % 3 <> 0 AS ner, k % 3 <> 1 AS user_tagged,
         CASE WHEN k % 3 <> 0 THEN k % 9 + 1 ELSE 0 END AS ner_mention_count
  FROM (SELECT n_nationkey::BIGINT AS k, n_name AS label, 1 AS base FROM nation UNION ALL SELECT p_partkey, p_name, 1001 FROM part)"""
BATCH_SQL = f"""
  SELECT k + base AS stable_id, label, {_KIND % 'k'} AS kind, CASE WHEN k % 7 = 6 THEN 'TRIBE' END AS custom_kind, k % 9 + 1 AS mention_count
  FROM (SELECT n_nationkey::BIGINT AS k, n_name AS label, 1 AS base FROM nation UNION ALL SELECT s_suppkey, s_name, 5000001 FROM supplier)"""
MENTIONS_SQL = """
  SELECT user_id % (SELECT count(*) FROM nation) + 1 AS entity_id, user_id % 40 + 1 AS document, event_id * 7 % 1000 AS start, event_id * 7 % 1000 + event_id % 13 + 1 AS "end",
         event_id % 5 <> 0 AS active FROM events"""
_LABELS = "(VALUES ('character','Character',0),('location','Location',1),('npc','NPC',2),('faction','Faction',3),('event','Event',4),('concept','Concept',5),('custom','Custom',6)) k(kind, kind_label, place)"
ANCHORS_SQL = """
  SELECT document, strlen(left(content, cut)) AS start, strlen(left(content, cut)) + strlen(surface) AS "end", node_id, surface, content,
         left(content, cut) AS pre, substr(content, cut + length(surface) + 1) AS post FROM (
    SELECT doc_id + 1 AS document, item_id + 1 AS node_id, surface, content, (list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(surface))::BIGINT AS cut FROM (
      SELECT *, unnest(range(1, len(p))) AS k FROM (
        SELECT doc_id, item_id, b.text AS surface, d.text AS content, string_split(d.text, b.text) AS p FROM documents d JOIN benchmark b ON contains(d.text, b.text))))"""
ENTRIES_SQL = """
  SELECT 1::BIGINT AS id, 0::BIGINT AS parent, 'folder' AS kind, 'World' AS name
  UNION ALL SELECT r_regionkey + 10, 1, 'folder', r_name FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey + 10, 'folder', n_name FROM nation
  UNION ALL SELECT c_custkey + 1000000, c_nationkey + 100, 'folder', c_name FROM customer
  UNION ALL SELECT o_orderkey + 100000000, o_custkey + 1000000, 'note', 'order ' || o_orderkey FROM orders"""


@BOOK.add(f"""
WITH e AS ({ENTITIES_SQL}), m AS (SELECT entity_id, count(*) AS n FROM ({MENTIONS_SQL}) WHERE active GROUP BY entity_id)
SELECT e.id, e.label, k.kind_label, coalesce(m.n, 0) + e.ner_mention_count AS mention_count FROM e JOIN {_LABELS} USING (kind) LEFT JOIN m ON m.entity_id = e.id""")
def atlas_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.atlas(entities(spark, sf_dir), mentions(spark, sf_dir)).select("id", "label", "kind_label", "mention_count")


@BOOK.add(f"WITH e AS ({ENTITIES_SQL}) SELECT place, kind, count(*) AS n FROM e JOIN {_LABELS} USING (kind) GROUP BY ALL")
def kind_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.kind_summary(entities(spark, sf_dir))


@BOOK.add(f"WITH e AS ({ENTITIES_SQL}) SELECT count(*) FILTER (ner) AS ner, count(*) FILTER (user_tagged) AS user_tagged FROM e")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.source_counts(entities(spark, sf_dir))


@BOOK.add(f"""
WITH e AS ({ENTITIES_SQL}), b AS ({BATCH_SQL})
SELECT coalesce(e.id, b.stable_id) AS id, CASE WHEN b.stable_id IS NULL THEN e.label ELSE b.label END AS label, CASE WHEN b.stable_id IS NULL THEN e.kind ELSE b.kind END AS kind,
       b.stable_id IS NOT NULL AS ner, coalesce(e.user_tagged, false) AS user_tagged, coalesce(b.mention_count, 0) AS ner_mention_count
FROM e FULL JOIN b ON e.id = b.stable_id WHERE b.stable_id IS NOT NULL OR e.user_tagged""")
def ner_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = registry.ner_merge(entities(spark, sf_dir), ner_batch(spark, sf_dir))
    return merged.select("id", "label", "kind", "sources.ner", "sources.user_tagged", "ner_mention_count")


@BOOK.add(f"""
WITH e AS ({ENTITIES_SQL}), b AS (SELECT stable_id, CASE WHEN stable_id % 3 = 0 THEN label || '!' ELSE label END AS label, kind, custom_kind FROM ({BATCH_SQL}))
SELECT b.stable_id FROM b JOIN e ON e.id = b.stable_id WHERE e.user_tagged AND (e.label, e.kind, e.custom_kind) IS DISTINCT FROM (b.label, b.kind, b.custom_kind)""")
def ner_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("stable_id") % 3 == 0, F.concat("label", F.lit("!"))).otherwise(F.col("label"))
    return registry.ner_conflicts(entities(spark, sf_dir), ner_batch(spark, sf_dir).withColumn("label", label))


@BOOK.add(f"""
WITH m AS ({MENTIONS_SQL}), t AS (SELECT range + 1 AS document, range * 20 AS tag_start, range * 20 + 15 AS tag_end FROM range(40))
SELECT document, count(*) AS n, sum(start)::BIGINT AS starts FROM m JOIN t USING (document) WHERE active AND tag_start < "end" AND start < tag_end GROUP BY document""")
def tag_overlap_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = spark.range(40).select((F.col("id") + 1).alias("document"), (F.col("id") * 20).alias("tag_start"), (F.col("id") * 20 + 15).alias("tag_end"))
    gone = registry.tag_evictions(mentions(spark, sf_dir), tags)
    return gone.groupBy("document").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


_ORDER_TAGS_SQL = """
  SELECT o_orderkey % 40 + 1 AS document, o_orderkey AS sequence, o_custkey * 3 % 1000 AS tag_start,
         o_custkey * 3 % 1000 + CASE WHEN o_orderkey % 50 = 0 THEN 120 ELSE o_orderkey % 11 + 1 END AS tag_end FROM orders"""


@BOOK.add(f"""
WITH m AS ({MENTIONS_SQL}), t AS ({_ORDER_TAGS_SQL})
SELECT document, start, "end", count(*) AS n_tags, min(sequence) AS first_tag, sum(least("end", tag_end) - greatest(start, tag_start))::BIGINT AS shared
FROM m JOIN t USING (document) WHERE active AND tag_start < "end" AND start < tag_end GROUP BY ALL""")
def tag_evictions_by_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention with what many tags of its document take from it."""
    key, place = F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint") * 3 % 1000
    size = F.when(key % 50 == 0, 120).otherwise(key % 11 + 1)
    tags = table(spark, sf_dir, "orders").select((key % 40 + 1).alias("document"), key.alias("sequence"), place.alias("tag_start"), (place + size).alias("tag_end"))
    return registry.eviction_totals(mentions(spark, sf_dir), tags)


@BOOK.add(f"""
WITH a AS (SELECT DISTINCT document, start, "end", node_id FROM ({ANCHORS_SQL})),
  t AS (SELECT document, (start * 10000 + node_id) * 4 + (copy + node_id) % 4 AS sequence, CASE WHEN copy = 2 THEN start + ("end" - start) // 3 ELSE start END AS start,
               CASE WHEN copy = 1 THEN start + ("end" - start) // 2 ELSE "end" END AS "end" FROM a, range(4) c(copy)),
  o AS (SELECT x.document, x.sequence, max(y.sequence) FILTER (y.sequence < x.sequence) AS previous, min(y.sequence) FILTER (y.sequence > x.sequence) AS next
        FROM t x JOIN t y ON x.document = y.document AND x.start < y."end" AND y.start < x."end" GROUP BY ALL),
  f AS (SELECT t.*, o.next, p.sequence IS NULL AS is_new FROM t JOIN o USING (document, sequence) LEFT JOIN t p ON p.document = t.document AND p.sequence = o.previous AND p.start = t.start AND p."end" = t."end")
SELECT document, sequence, start, "end", is_new, max(sequence) FILTER (is_new) OVER (PARTITION BY document, start, "end" ORDER BY sequence) AS first, next IS NULL AS active, next AS evicted_by FROM f""")
def batch_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All anchors of all documents, and parts of them, tagged one after the other."""
    found = anchors(spark, sf_dir).select("document", "start", "end", "node_id").distinct()
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(3))))
    size = F.col("end") - F.col("start")
    tags = rows.select(
        "document",
        ((F.col("start") * 10_000 + F.col("node_id")) * 4 + (F.col("copy") + F.col("node_id")) % 4).alias("sequence"),
        F.when(F.col("copy") == 2, F.col("start") + F.floor(size / 3)).otherwise(F.col("start")).cast("bigint").alias("start"),
        F.when(F.col("copy") == 1, F.col("start") + F.floor(size / 2)).otherwise(F.col("end")).cast("bigint").alias("end"),
    )
    return registry.fold_tags(tags).drop("entity_id")


@BOOK.add(f"""
WITH a AS (SELECT *, lag("end") OVER (PARTITION BY document ORDER BY start, "end", node_id) AS previous_end FROM (
  SELECT document, start, "end", node_id FROM ({ANCHORS_SQL}) UNION ALL SELECT document, start + 5, "end", node_id + 1000 FROM ({ANCHORS_SQL})))
SELECT document, start, "end", node_id, previous_end FROM a WHERE start < previous_end""")
def anchor_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anchors(spark, sf_dir).select("document", "start", "end", "node_id")
    copies = F.explode(F.array(*(F.struct(F.lit(by).alias("by"), F.lit(number).alias("number")) for by, number in ((0, 0), (5, 1000)))))
    both = found.withColumn("copy", copies)
    return spans.overlapping(both.select("document", (F.col("start") + F.col("copy.by")).alias("start"), "end", (F.col("node_id") + F.col("copy.number")).alias("node_id")))


@BOOK.add(f"SELECT document, node_id, start, \"end\", true AS exact, false AS shifted_exact FROM ({ANCHORS_SQL})")
def anchor_surface_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anchors(spark, sf_dir)
    same = lambda by: F.coalesce(byte_slice(F.col("content"), F.col("start") + by, F.col("end") + by) == F.col("surface"), F.lit(False))
    return rows.select("document", "node_id", "start", "end", same(0).alias("exact"), same(1).alias("shifted_exact"))


@BOOK.add("""
SELECT doc_id, len(string_split(text, 'the')) - 1 AS n_the, len(string_split(text, 'enen')) - 1 AS n_enen FROM documents""")
def occurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", *(occurrences(F.col("text"), F.lit(w)).alias(f"n_{w}") for w in ("the", "enen")))


@BOOK.add(f"""
SELECT document, node_id, start + 11 AS start, "end" + 11 AS "end", true AS active FROM ({ANCHORS_SQL})
WHERE len(string_split(content, surface)) = 2""")
def reanchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anchors(spark, sf_dir).where(occurrences(F.col("content"), F.col("surface")) == 1)
    moved = rows.withColumn("prefix", F.lit("")).withColumn("suffix", F.lit("")).withColumn("content", F.concat(F.lit("A new line\n"), "content"))
    return registry.relocate(moved).select("document", "node_id", "start", "end", "active")


@BOOK.add(f"""
WITH a AS (SELECT document, node_id, start, "end", surface, right(pre, 32) AS prefix, left(post, 32) AS suffix,
             CASE document % 5 WHEN 0 THEN content WHEN 1 THEN 'A new line' || chr(10) || content WHEN 2 THEN 'Copy of: ' || surface || '. ' || content || chr(10) || surface
               WHEN 3 THEN replace(content, surface, upper(surface)) ELSE 'é ' || content || chr(10) || content END AS now FROM ({ANCHORS_SQL})),
  p AS (SELECT *, string_split(now, surface) AS parts FROM a),
  c AS (SELECT *, list_transform(range(1, len(parts)), lambda k: (list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(surface))::BIGINT) AS cuts FROM p),
  o AS (SELECT *, list_transform(cuts, lambda c: strlen(left(now, c))) AS found,
          list_filter(range(1, len(parts)), lambda k: ends_with(left(now, cuts[k]), prefix) AND starts_with(substr(now, cuts[k] + length(surface) + 1), suffix)) AS fits FROM c),
  t AS (SELECT *, CASE WHEN list_contains(found, start) THEN start WHEN len(found) = 1 THEN found[1] WHEN len(fits) = 1 THEN found[fits[1]] END AS place FROM o)
SELECT document, node_id, start AS was, coalesce(place, start)::BIGINT AS start, (CASE WHEN place IS NULL THEN "end" ELSE place + strlen(surface) END)::BIGINT AS "end", place IS NOT NULL AS active, len(found)::BIGINT AS n_found FROM t""")
def reanchor_after_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor of every document after an edit: some stay, some move, some are met again by their context alone, some are lost."""
    rows = anchors(spark, sf_dir)
    kept = rows.withColumn("prefix", quote_prefix(F.col("content"), F.col("start"))).withColumn("suffix", quote_suffix(F.col("content"), F.col("end"))).withColumn("was", F.col("start"))
    content, surface, kind = F.col("content"), F.col("surface"), F.col("document") % 5
    edited = F.when(kind == 0, content).when(kind == 1, F.concat(F.lit("A new line\n"), content)).when(kind == 2, F.concat(F.lit("Copy of: "), surface, F.lit(". "), content, F.lit("\n"), surface))
    edited = edited.when(kind == 3, F.replace(content, surface, F.upper(surface))).otherwise(F.concat(F.lit("é "), content, F.lit("\n"), content))
    moved = registry.relocate(kept.withColumn("content", edited))
    return moved.select("document", "node_id", "was", "start", "end", "active", occurrences(F.col("content"), F.col("surface")).alias("n_found"))


@BOOK.add(f"""
WITH e AS ({ENTITIES_SQL}) SELECT id, label, kind FROM e JOIN {_LABELS} USING (kind)
WHERE contains(lower(label), 'large') OR contains(lower(kind_label), 'large') OR contains(lower(coalesce(custom_kind, '')), 'large')""")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.search(entities(spark, sf_dir), " LARGE ").select("id", "label", "kind")


@BOOK.add(f"""
SELECT document, node_id, start, right(pre, 32) AS prefix, left(post, 32) AS suffix
FROM ({ANCHORS_SQL})""")
def quote_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anchors(spark, sf_dir)
    return rows.select("document", "node_id", "start", quote_prefix(F.col("content"), F.col("start")).alias("prefix"), quote_suffix(F.col("content"), F.col("end")).alias("suffix"))


@BOOK.add(f"""
WITH a AS ({ANCHORS_SQL}), c AS (SELECT *, ['character','location','organization','item','concept','event','structure','other'][(node_id % 8)::INT + 1] AS family FROM a),
 p AS (SELECT * FROM (VALUES ('character',5209343,11820287),('location',2216317,5433528),('organization',5425407,5999871),('item',16760647,16743001),('concept',3594690,6219775),('event',16742981,16764741),('structure',14961807,11104767),('other',11977919,7311751)) t(family, primary_rgb, secondary_rgb))
SELECT document, start, "end", family, primary_rgb::BIGINT AS primary_rgb, secondary_rgb::BIGINT AS secondary_rgb FROM c JOIN p USING (family)""")
def highlight_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = F.array(*(F.lit(f) for f in ("character", "location", "organization", "item", "concept", "event", "structure", "other")))
    rows = anchors(spark, sf_dir).withColumn("family", F.element_at(families, (F.col("node_id") % 8).cast("int") + 1))
    return spans.highlights(rows)


@BOOK.add(f"""
WITH e AS ({ENTITIES_SQL}), f AS (SELECT * FROM (VALUES ('character','character',0,5209343),('npc','character',0,5209343),('location','location',1,2216317),('faction','organization',2,5425407),('event','event',5,16742981),('concept','concept',4,3594690),('custom','other',7,11977919)) t(kind, family, slot, rgb))
SELECT id, label, family, 1::BIGINT << slot AS family_mask, rgb::BIGINT AS rgb, ner::INT + 2 * user_tagged::INT AS flags FROM e JOIN f USING (kind)""")
def registry_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.publication(entities(spark, sf_dir))


@BOOK.add("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", digest(F.col("text")).alias("hash"))


@BOOK.add("""
WITH e AS (SELECT event_id + 2 AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS depth, first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id) + 2 AS first FROM events)
SELECT id, depth, first FROM e""")
def event_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event below the event before it of its user: depth below the root, and the first of the chain."""
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    links = table(spark, sf_dir, "events").select((F.col("event_id") + 2).alias("id"), F.coalesce(before + 2, F.lit(tree.ROOT_ID)).alias("parent"))
    found = tree.climb(links, links.where(F.col("parent") == tree.ROOT_ID))
    return found.select("id", (F.col("steps") + 1).alias("depth"), F.col("top").alias("first"))


@BOOK.add(f"""
WITH RECURSIVE e AS ({ENTRIES_SQL}), w AS (SELECT id, name AS path FROM e WHERE id = 1 UNION ALL SELECT e.id, w.path || ' / ' || e.name FROM e JOIN w ON e.parent = w.id)
SELECT id, path FROM w""")
def workspace_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.paths(entries(spark, sf_dir))


@BOOK.add(f"""
WITH RECURSIVE e AS ({ENTRIES_SQL}), w AS (SELECT id, kind, 0 AS depth, [lower(name)] AS key FROM e WHERE id = 1
  UNION ALL SELECT e.id, e.kind, w.depth + 1, list_append(w.key, CASE e.kind WHEN 'folder' THEN '0' ELSE '1' END || lower(e.name)) FROM e JOIN w ON e.parent = w.id WHERE w.id % 3 <> 2)
SELECT id, depth, row_number() OVER (ORDER BY key) AS place FROM w""")
def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.visible_rows(entries(spark, sf_dir), F.col("id") % 3 != 2).withColumn("place", F.col("place").cast("bigint"))


@BOOK.add(f"""
WITH RECURSIVE e AS ({ENTRIES_SQL}), w AS (SELECT id FROM e WHERE id IN (11, 105) UNION SELECT e.id FROM e JOIN w ON e.parent = w.id) SELECT id FROM w""")
def delete_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    return tree.closure(rows, rows.where("id in (11, 105)").select("id"))


@BOOK.add(f"""
WITH RECURSIVE e AS (SELECT id, CASE WHEN id = 12 THEN 110 WHEN id = 110 THEN 12 WHEN id = 103 THEN 77 ELSE parent END AS parent FROM ({ENTRIES_SQL})),
 w AS (SELECT id FROM e WHERE id = 1 UNION SELECT e.id FROM e JOIN w ON e.parent = w.id) SELECT id FROM e WHERE id NOT IN (SELECT id FROM w)""")
def cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when(F.col("id") == 12, 110).when(F.col("id") == 110, 12).when(F.col("id") == 103, 77).otherwise(F.col("parent"))
    return tree.unrooted(entries(spark, sf_dir).withColumn("parent", parent.cast("bigint")))


@BOOK.add(f"WITH e AS ({ENTRIES_SQL}) SELECT count(*) FILTER (kind = 'folder') AS folders, count(*) FILTER (kind = 'note') AS notes FROM e")
def workspace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.counts(entries(spark, sf_dir))


_NAMES = ("documents", "doc_id", "text"), ("part", "p_partkey", "p_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name")


@BOOK.add(f"""
WITH n AS ({' UNION ALL '.join(f"SELECT '{t}' AS source, {k}::BIGINT AS id, {c} AS name FROM {t}" for t, k, c in _NAMES)}),
  t AS (SELECT source, id, regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS name FROM n)
SELECT source, id, CASE WHEN length(name) = 0 THEN 'EmptyName' WHEN strlen(name) > 96 OR regexp_matches(name, '[[:cntrl:]/\\\\<>:"|?*]') THEN 'InvalidName' ELSE 'ok' END AS error FROM t""")
def name_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether whole texts and names may name an entry."""
    rows = [table(spark, sf_dir, t).select(F.lit(t).alias("source"), F.col(k).cast("bigint").alias("id"), name_error(F.col(c)).alias("error")) for t, k, c in _NAMES]
    return reduce(DataFrame.unionByName, rows).withColumn("error", F.coalesce("error", F.lit("ok")))


@BOOK.add("SELECT quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events")
def p95_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.nearest_rank(table(spark, sf_dir, "events"), "value")


@BOOK.add("""
WITH w AS (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 255 PRECEDING AND CURRENT ROW)) AS ring FROM events)
SELECT event_id, ring[ceil(len(ring) * 0.95)::INT] AS p95 FROM w""")
def ring_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return logs.ring_percentile(rows, "user_id", "event_id", "value").select("event_id", "p95")


@BOOK.add("SELECT user_id, max(event_id) + 1 AS sequence, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id")
def hover_conflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.latest(_event_log(spark, sf_dir), "user_id")


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("sequence"), "user_id", F.col("event_type").alias("kind"))


@BOOK.add("SELECT event_id + 1 AS sequence, user_id, event_type AS kind FROM events WHERE event_id + 1 > 900")
def event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.replay(_event_log(spark, sf_dir), 900)


@BOOK.add("SELECT event_id + 1 AS sequence, user_id, event_type AS kind FROM events ORDER BY event_id DESC LIMIT 32")
def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.tail(_event_log(spark, sf_dir))


@BOOK.add("""
WITH l AS (SELECT event_id + 1 AS sequence, CASE WHEN event_id % 3 <> 2 THEN 'submitted' WHEN event_id % 4 = 0 THEN 'rejected' ELSE 'completed' END AS status FROM events),
     r AS (SELECT *, sum(CASE status WHEN 'submitted' THEN 1 ELSE -1 END) OVER (ORDER BY sequence) AS run FROM l)
SELECT count(*) FILTER (status = 'submitted') AS submitted, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'rejected') AS rejected,
       sum(CASE status WHEN 'submitted' THEN 1 ELSE -1 END)::BIGINT AS pending, greatest(max(run), 0)::BIGINT AS high_water FROM r""")
def command_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    status = F.when(k % 3 != 2, "submitted").when(k % 4 == 0, "rejected").otherwise("completed")
    log = table(spark, sf_dir, "events").select((k + 1).alias("sequence"), status.alias("status"))
    return logs.command_metrics(log, F.when(F.col("status") == "submitted", 1).otherwise(-1))


@BOOK.add("""
WITH w AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT user_id, count(*) AS n FROM w WHERE k = 1 OR event_type IS DISTINCT FROM before GROUP BY user_id""")
def mailbox_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return logs.changed_only(rows, "user_id", "event_type", "event_id").groupBy("user_id").agg(F.count("*").alias("n"))


@BOOK.add("""
WITH e AS (SELECT user_id AS lane, event_id + 1 AS sequence, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM events),
     p AS (SELECT lane, row_number() OVER (PARTITION BY lane, epoch ORDER BY sequence) AS place FROM e)
SELECT lane, count(*) FILTER (place <= 4) AS accepted, count(*) FILTER (place > 4) AS refused FROM p GROUP BY lane""")
def event_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("lane"), (F.col("event_id") + 1).alias("sequence"), "event_type")
    found = logs.admitted(rows, F.col("event_type") == "signup", 4)
    return found.groupBy("lane").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))


@BOOK.add("""
WITH e AS (SELECT user_id, event_id, event_id // 50 AS press, (event_id * 3 % 7)::DOUBLE AS x, (event_id * 5 % 11)::DOUBLE AS y FROM events),
     d AS (SELECT *, (x - first_value(x) OVER w) ** 2 + (y - first_value(y) OVER w) ** 2 >= 16 AS far FROM e WINDOW w AS (PARTITION BY user_id, press ORDER BY event_id)),
     s AS (SELECT user_id, max(far) OVER (PARTITION BY user_id, press ORDER BY event_id) AS dragging FROM d)
SELECT user_id, count(*) FILTER (dragging) AS dragging, count(*) AS n FROM s GROUP BY user_id""")
def drag_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", k.alias("sequence"), F.expr("event_id div 50").alias("press"), (k * 3 % 7).cast("double").alias("x"), (k * 5 % 11).cast("double").alias("y"))
    return logs.dragged(rows, "user_id", "press").groupBy("user_id").agg(F.count_if("dragging").alias("dragging"), F.count("*").alias("n"))


@BOOK.add("""
SELECT event_id // 20 AS frame, arg_max(event_id + 1, (CASE WHEN event_type = 'click' THEN 1000000000 ELSE 0 END) + event_id) AS sequence FROM events GROUP BY ALL""")
def pick_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    intent = F.when(F.col("event_type") == "click", "select").otherwise("hover")
    rows = table(spark, sf_dir, "events").select(F.expr("event_id div 20").alias("frame"), (F.col("event_id") + 1).alias("sequence"), intent.alias("intent"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    return logs.pick_request(rows).select("frame", "sequence")
