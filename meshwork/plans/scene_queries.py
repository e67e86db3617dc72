"""Scene queries: views, assembly, diffs, slots, geometry."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions import geometry, gradient
from meshwork.functions.masks import split_words
from meshwork.functions.text import align_up, generation_stem
from meshwork.operators import diff, index, pages, paths, scene, slots, validate
from meshwork.sources import generators
from meshwork.sources.tables import changes, edge_rows, node_rows, nodes, positions, table
from meshwork.types import LIMITS, MANIFOLDS, View

from .registering import Book

BOOK = Book()
VIEW = View(families=0b1010, scopes=0x0FF0F, relations=0b10110, reviews=0b101)

NODES_SQL = """
  SELECT c_custkey + 1 AS id, abs(c_acctbal) / 1000 + 1 AS radius, 1 AS kind, c_name AS label, 2::BIGINT AS family_mask,
         1::BIGINT << (c_nationkey % 64) AS scope_mask, 1::BIGINT << (c_custkey % 3)::INT AS review_mask FROM customer
  UNION ALL SELECT s_suppkey + 10000001, abs(s_acctbal) / 1000 + 1, 2, s_name, 4::BIGINT, 1::BIGINT << (s_nationkey % 64), 1::BIGINT << (s_suppkey % 3)::INT FROM supplier
  UNION ALL SELECT p_partkey + 20000001, p_size::DOUBLE, 3, p_name, 8::BIGINT, 1::BIGINT << (p_partkey % 25)::INT, 1::BIGINT << (p_partkey % 3)::INT FROM part"""
EDGES_SQL = """
  SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey + 10000001 AS source, l_partkey + 20000001 AS target,
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS kind, l_quantity AS width,
         1::BIGINT << (CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END) AS family_mask,
         1::BIGINT << (l_suppkey % 25)::INT AS scope_mask, 1::BIGINT << (l_linenumber % 64) AS relation_mask,
         1::BIGINT << (l_orderkey % 3)::INT AS review_mask FROM lineitem"""
CHANGES_SQL = """
  SELECT event_id + 1 AS revision, user_id + 1 AS id, value,
         CASE row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 10 WHEN 1 THEN 'add' WHEN 0 THEN 'remove' ELSE 'update' END AS op FROM events"""
POSITIONS_SQL = """
  SELECT m.name AS manifold, vec_id AS slot, vec_id + 1 AS id, label AS kind, embedding[3 * m.k + 1]::DOUBLE AS x, embedding[3 * m.k + 2]::DOUBLE AS y,
         embedding[3 * m.k + 3]::DOUBLE AS z FROM embeddings, (VALUES ('hybrid', 0), ('hopf', 1), ('caps', 2), ('transit', 3), ('siegel', 4)) m(name, k)"""
_VISIBLE = f"(family_mask & {VIEW.families}) <> 0 AND (scope_mask & {VIEW.scopes}) <> 0 AND (review_mask & {VIEW.reviews}) <> 0"


@BOOK.add(f"WITH n AS ({NODES_SQL}) SELECT kind, count(*) AS n FROM n WHERE {_VISIBLE} GROUP BY kind")
def lens_visible_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.visible_nodes(node_rows(spark, sf_dir), VIEW).groupBy("kind").agg(F.count("*").alias("n"))


@BOOK.add(
    f"WITH e AS ({EDGES_SQL}) SELECT kind, count(*) AS n, sum(width) AS width FROM e WHERE {_VISIBLE} AND (relation_mask & {VIEW.relations}) <> 0 GROUP BY kind"
)
def lens_visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = scene.visible_edges(edge_rows(spark, sf_dir), VIEW)
    return shown.groupBy("kind").agg(F.count("*").alias("n"), F.sum("width").alias("width"))


@BOOK.add(f"""
WITH n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS slot FROM ({NODES_SQL})), e AS ({EDGES_SQL})
SELECT e.kind, count(*) AS n, sum(s.slot)::BIGINT AS source_slots, sum(t.slot)::BIGINT AS target_slots, min(t.slot) AS least_target
FROM e JOIN n s ON e.source = s.id JOIN n t ON e.target = t.id GROUP BY e.kind""")
def scene_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = scene.endpoint_slots(edge_rows(spark, sf_dir), nodes(spark, sf_dir).select("id", "slot"))
    return placed.groupBy("kind").agg(
        F.count("*").alias("n"), F.sum("source_slot").alias("source_slots"), F.sum("target_slot").alias("target_slots"), F.min("target_slot").alias("least_target")
    )


@BOOK.add(f"""
WITH n AS (SELECT * FROM ({NODES_SQL}) WHERE {_VISIBLE}), e AS ({EDGES_SQL})
SELECT 'MissingSourceNode' AS rule, e.source AS node, count(*) AS n FROM e ANTI JOIN n ON e.source = n.id GROUP BY e.source
UNION ALL SELECT 'MissingTargetNode', e.target, count(*) FROM e ANTI JOIN n ON e.target = n.id GROUP BY e.target""")
def missing_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown, edges = scene.visible_nodes(node_rows(spark, sf_dir), VIEW), edge_rows(spark, sf_dir)
    found = [
        validate.missing(edges, end, shown, "id").select(F.lit(rule).alias("rule"), F.col(end).alias("node"))
        for end, rule in (("source", "MissingSourceNode"), ("target", "MissingTargetNode"))
    ]
    return validate.union(found).groupBy("rule", "node").agg(F.count("*").alias("n"))


@BOOK.add("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@BOOK.add("""
SELECT 'embedding' AS what, count(*) AS n FROM embeddings WHERE len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) > 0
UNION ALL SELECT 'price', count(*) FROM part WHERE p_retailprice IS NULL OR isnan(p_retailprice) OR isinf(p_retailprice) OR p_retailprice < 950""")
def non_finite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    vectors = table(spark, sf_dir, "embeddings").where(bad).agg(F.lit("embedding").alias("what"), F.count("*").alias("n"))
    price = F.col("p_retailprice")
    parts = table(spark, sf_dir, "part").where(validate.non_finite(price) | (price < 950)).agg(F.lit("price").alias("what"), F.count("*").alias("n"))
    return vectors.unionByName(parts)


@BOOK.add(f"""
WITH c AS ({CHANGES_SQL}), last AS (SELECT id, max(revision) AS revision FROM c GROUP BY id)
SELECT c.id, c.revision, c.value FROM c JOIN last USING (id, revision) WHERE op <> 'remove'""")
def diff_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.last_writer(changes(spark, sf_dir))


@BOOK.add(f"WITH c AS ({CHANGES_SQL}) SELECT (revision - 1) // 100 + 1 AS block, id, count(*) AS n FROM c GROUP BY ALL HAVING count(*) > 1")
def diff_lane_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = changes(spark, sf_dir).withColumn("block", F.expr("(revision - 1) div 100 + 1"))
    return diff.lane_conflicts(blocks, "block")


@BOOK.add(f"WITH c AS ({CHANGES_SQL}) SELECT op, count(*) AS n FROM c GROUP BY op")
def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.lane_counts(changes(spark, sf_dir))


@BOOK.add("""
WITH removed AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS pos, s_suppkey AS slot FROM supplier WHERE s_suppkey % 3 = 0),
     added AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS ord, n_nationkey::BIGINT AS id FROM nation),
     cap AS (SELECT count(*) AS capacity FROM supplier), f AS (SELECT count(*) AS n FROM removed)
SELECT a.ord, a.id, coalesce(r.slot, cap.capacity + a.ord - f.n - 1) AS slot
FROM added a CROSS JOIN cap CROSS JOIN f LEFT JOIN removed r ON r.pos = f.n + 1 - a.ord""")
def slot_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    free = slots.assign_slots(supplier.where("s_suppkey % 3 = 0").select("s_suppkey"), "s_suppkey", "pos")
    free = free.select((F.col("pos") + 1).alias("pos"), F.col("s_suppkey").alias("slot"))
    added = slots.assign_slots(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id")), "id", "ord")
    return slots.allocate_slots(added.select((F.col("ord") + 1).alias("ord"), "id"), free, supplier.count())


@BOOK.add("""
WITH s AS (SELECT DISTINCT l_orderkey AS s FROM lineitem WHERE l_discount > 0.05),
     g AS (SELECT s, s - row_number() OVER (ORDER BY s) AS g FROM s)
SELECT min(s) AS first, count(*) AS count FROM g GROUP BY g""")
def dirty_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = table(spark, sf_dir, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("slot"))
    return slots.coalesced_ranges(touched)


@BOOK.add("""
WITH r AS (SELECT user_id, event_id, event_id * 37 % 101 AS revision FROM events),
     w AS (SELECT *, max(revision) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS current FROM r)
SELECT user_id, count(*) AS n FROM w WHERE revision <= current GROUP BY user_id""")
def stale_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 37 % 101).alias("revision"))
    return diff.stale(rows, "event_id", "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


@BOOK.add(f"""
WITH e AS ({EDGES_SQL}), gone AS (SELECT s_suppkey + 10000001 AS node FROM supplier WHERE s_suppkey % 10 = 0 UNION ALL SELECT p_partkey + 20000001 FROM part WHERE p_partkey % 50 = 0),
     kept AS (SELECT * FROM e WHERE id % 4 <> 0), ends AS (SELECT id, source AS node FROM kept UNION ALL SELECT id, target FROM kept)
SELECT node, count(*) AS n FROM ends SEMI JOIN gone USING (node) GROUP BY node""")
def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = edge_rows(spark, sf_dir).select("id", "source", "target")
    supplier = table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").select((F.col("s_suppkey") + 10_000_001).alias("id"))
    part = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select((F.col("p_partkey") + 20_000_001).alias("id"))
    escaped = edges.where("id % 4 = 0").select("id", F.lit("remove").alias("op")).distinct()
    return diff.incident_edges(edges, supplier.unionByName(part), escaped).groupBy("node").agg(F.count("*").alias("n"))


@BOOK.add(f"WITH p AS ({POSITIONS_SQL}) SELECT manifold, count(*) AS nodes FROM p GROUP BY manifold")
def inventory_per_manifold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene.page_inventory(positions(spark, sf_dir))


@BOOK.add(f"""
WITH p AS ({POSITIONS_SQL}) SELECT kind, count(*) AS n, round(sum(x), 4) AS x, round(sum(y), 4) AS y, round(sum(z), 4) AS z FROM p WHERE manifold = 'caps' GROUP BY kind""")
def layout_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = positions(spark, sf_dir)
    state = every.where("manifold = 'hybrid'").drop("manifold")
    moved = scene.switch_layout(state, every, "caps")
    return moved.groupBy("kind").agg(F.count("*").alias("n"), *(F.round(F.sum(a), 4).alias(a) for a in "xyz"))


@BOOK.add(f"""
WITH p AS ({POSITIONS_SQL}) SELECT manifold, {', '.join(f"round(min({a} - 0.5), 4) AS min_{a}, round(max({a} + 0.5), 4) AS max_{a}" for a in 'xyz')} FROM p GROUP BY manifold""")
def graph_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geometry.bounds(positions(spark, sf_dir).withColumn("radius", F.lit(0.5)), "manifold")
    return rows.select("manifold", *(F.round(f"{end}_{a}", 4).alias(f"{end}_{a}") for end in ("min", "max") for a in "xyz"))


_HALF = min(math.pi / 8, math.atan(math.tan(math.pi / 8) * 3.2))


@BOOK.add(f"""
WITH b AS (SELECT manifold, max(x + 0.5) - min(x - 0.5) AS dx, max(y + 0.5) - min(y - 0.5) AS dy, max(z + 0.5) - min(z - 0.5) AS dz FROM ({POSITIONS_SQL}) GROUP BY manifold)
SELECT manifold, round(least(greatest(greatest(sqrt(dx * dx + dy * dy + dz * dz) / 2, 1.0) / {math.sin(_HALF)!r} * 1.1, 0.05), 100000.0), 3) AS distance FROM b""")
def camera_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = geometry.bounds(positions(spark, sf_dir).withColumn("radius", F.lit(0.5)), "manifold")
    spans = box.select("manifold", *((F.col(f"max_{a}") - F.col(f"min_{a}")).alias(a) for a in "xyz"))
    radius = F.greatest(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) / 2, F.lit(1.0))
    return spans.select("manifold", F.round(geometry.fit_distance(radius, math.pi / 4, 3.2), 3).alias("distance"))


@BOOK.add(f"""
WITH p AS (SELECT id, x + 2.0 AS depth, y * y + z * z AS away FROM ({POSITIONS_SQL}) WHERE manifold = 'hybrid' AND kind % 2 = 0)
SELECT arg_min(id, depth) AS id, round(min(depth), 5) AS depth, count(*) AS hits FROM p WHERE depth > 0 AND away <= 0.04""")
def pick_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions(spark, sf_dir).where("manifold = 'hybrid'").withColumn("radius", F.lit(0.2))
    hit = geometry.pick_nearest(rows, (-2.0, 0.0, 0.0), (1.0, 0.0, 0.0), F.col("kind") % 2 == 0)
    return hit.select("id", F.round("depth", 5).alias("depth"), "hits")


@BOOK.add(f"""
WITH e AS ({EDGES_SQL}) SELECT kind, sum((kind::BIGINT << 16) | ((source % 2) | ((target % 2) << 1)))::BIGINT AS packed,
  sum(id & 4294967295)::BIGINT AS low, sum((id * 4294967296) >> 32)::BIGINT AS high FROM e GROUP BY kind""")
def packed_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = edge_rows(spark, sf_dir)
    flags = scene.packed_flags(F.col("kind"), F.lit(0), F.col("source") % 2, F.col("target") % 2)
    wide = F.col("id") * 4294967296
    return edges.groupBy("kind").agg(F.sum(flags).alias("packed"), F.sum(split_words(F.col("id"))[0]).alias("low"), F.sum(split_words(wide)[1]).alias("high"))


@BOOK.add("""
WITH a AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS slot, p_partkey AS id FROM part),
     i AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS slot, CASE WHEN p_partkey % 97 = 5 THEN -p_partkey ELSE p_partkey END AS id FROM part WHERE p_partkey < (SELECT max(p_partkey) FROM part))
SELECT 'node' AS resource, min(slot) AS slot, count(*) AS n FROM a FULL JOIN i USING (slot) WHERE a.id IS DISTINCT FROM i.id""")
def index_bind_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey")
    last = part.agg(F.max("p_partkey")).first()[0]
    archive = slots.assign_slots(part, "p_partkey").select(F.lit("node").alias("resource"), "slot", F.col("p_partkey").alias("id"))
    wrong = F.when(F.col("p_partkey") % 97 == 5, -F.col("p_partkey")).otherwise(F.col("p_partkey"))
    bound = slots.assign_slots(part.where(F.col("p_partkey") < last), "p_partkey").select(F.lit("node").alias("resource"), "slot", wrong.alias("id"))
    return index.binding_mismatches(bound, archive)


@BOOK.add("""
SELECT p_partkey AS id, coalesce(sum(strlen(p_name)) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset,
       strlen(p_name)::BIGINT AS length FROM part""")
def label_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    placed = index.running_offsets(rows, "id", F.octet_length("p_name"))
    return placed.select("id", "offset", F.octet_length("p_name").cast("bigint").alias("length"))


@BOOK.add("""
WITH m AS (SELECT p_partkey % 40 AS entity_id, p_partkey AS node_id FROM part)
SELECT 'DuplicateEntity' AS rule, entity_id AS id FROM m GROUP BY entity_id HAVING count(*) > 1
UNION ALL SELECT 'ZeroEntity', entity_id FROM m WHERE entity_id = 0
UNION ALL SELECT 'MissingNode', entity_id FROM m WHERE node_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)""")
def mapping_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    mappings = part.select((F.col("p_partkey") % 40).alias("entity_id"), F.col("p_partkey").alias("node_id"))
    found = index.mapping_violations(mappings, part.where("p_size > 3").select(F.col("p_partkey").alias("id")))
    return found.select("rule", F.col("entity_id").alias("id"))


@BOOK.add("""
WITH b AS (SELECT doc_id // 4096 AS block, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS d FROM documents GROUP BY ALL)
SELECT sha256(string_agg(d, ',' ORDER BY block)) AS digest FROM b""")
def cohort_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return index.cohort_digest(docs, "doc_id", F.sha2(F.col("text").cast("binary"), 256))


@BOOK.add(f"""
WITH p AS (SELECT r_regionkey AS r, n_nationkey AS page, (n_nationkey + 1) * 3000000 AS bytes FROM nation JOIN region ON n_regionkey = r_regionkey),
     w AS (SELECT r, page, sum(bytes) OVER (PARTITION BY r ORDER BY page) AS running FROM p)
SELECT r::VARCHAR AS manifold, min(page) AS page, min(running)::BIGINT AS bytes FROM w WHERE running > {LIMITS["hot_bytes"]} GROUP BY r""")
def hot_page_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").cast("string").alias("manifold"), F.col("n_nationkey").alias("page"), ((F.col("n_nationkey") + 1) * 3_000_000).cast("bigint").alias("bytes")
    )
    return scene.over_hot_budget(pages, LIMITS["hot_bytes"])


@BOOK.add("""
WITH w AS (SELECT p_partkey, p_name, length(p_name) AS n, least(length(p_name), 4) AS k FROM part),
     b AS (SELECT p_partkey, p_name, n, k, unnest(range(k)) AS run FROM w),
     c AS (SELECT *, run * n // k AS first, (run + 1) * n // k AS last FROM b),
     d AS (SELECT *, (first + last) * 0.5 / n * 1.5 + 0.25 AS pos FROM c), f AS (SELECT *, (pos - floor(pos)) * 2 AS s FROM d),
     g AS (SELECT *, s - floor(s) AS t, floor(s)::INT % 2 AS lo FROM f)
SELECT p_partkey AS id, run::INT AS run, strlen(substr(p_name, 1, first::INT))::BIGINT AS byte_start, strlen(substr(p_name, first::INT + 1, (last - first)::INT))::BIGINT AS byte_len,
  (round(CASE lo WHEN 0 THEN 79 + (255 - 79) * t ELSE 255 + (79 - 255) * t END)::BIGINT << 16)
  + (round(CASE lo WHEN 0 THEN 124 + (122 - 124) * t ELSE 122 + (124 - 122) * t END)::BIGINT << 8)
  + round(CASE lo WHEN 0 THEN 255 + (69 - 255) * t ELSE 69 + (255 - 69) * t END)::BIGINT AS rgb FROM g""")
def gradient_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    runs = gradient.color_runs(rows, "p_name", [0x4F7CFF, 0xFF7A45], phase=0.25, cycles=1.5, max_runs=4)
    return runs.select("id", "run", "byte_start", "byte_len", "rgb")


@BOOK.add("""
SELECT i % 4 AS lane_kind, count(*) AS n, sum((i % 10000 + (i // 10000 + 1) * 97) % 10000)::BIGINT AS targets FROM (SELECT l_orderkey * 8 + l_linenumber AS i FROM lineitem) GROUP BY ALL""")
def frozen_cohort_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as edges of a cohort."""
    slots = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey").cast("bigint") * 8 + F.col("l_linenumber")).alias("slot"))
    edges = generators.cohort_edges(spark, slots=slots)
    return edges.groupBy((F.col("slot") % 4).alias("lane_kind")).agg(F.count("*").alias("n"), F.sum("target").alias("targets"))


@BOOK.add("""
SELECT r_regionkey AS id, 'generation-' || lpad(lower(to_hex(r_regionkey * 1000003 + 255)), 16, '0') AS stem, ((r_regionkey * 100 + 63) // 64 * 64)::BIGINT AS aligned FROM region""")
def generation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_regionkey").cast("bigint").alias("k"))
    return rows.select(F.col("r_regionkey").alias("id"), generation_stem(F.col("k") * 1000003 + 255).alias("stem"), align_up(F.col("k") * 100).alias("aligned"))


_LAYOUT_SQL = """
WITH i AS (SELECT o_orderkey AS slot, o_orderkey * 0.017453292::DOUBLE AS phase FROM orders)
SELECT 'hybrid' AS manifold, slot, slot % 100 - 49.5::DOUBLE AS x, slot // 100 % 100 - 49.5::DOUBLE AS y, slot * 37 % 211 * 0.025::DOUBLE - 2.625 AS z FROM i
UNION ALL SELECT 'hopf', slot, (slot // 100 % 8 * 1.4::DOUBLE + 34 + (slot % 11 * 0.12::DOUBLE + 4) * cos(phase * 7 + slot % 100 * 0.031::DOUBLE)) * cos(phase),
  (slot // 100 % 8 * 1.4::DOUBLE + 34 + (slot % 11 * 0.12::DOUBLE + 4) * cos(phase * 7 + slot % 100 * 0.031::DOUBLE)) * sin(phase), (slot % 11 * 0.12::DOUBLE + 4) * sin(phase * 7 + slot % 100 * 0.031::DOUBLE) FROM i
UNION ALL SELECT 'caps', slot, cos(slot % 16 * (pi() / 8)) * 32 + cos(phase) * (slot % 97 * 0.08::DOUBLE + 18), sin(slot % 16 * (pi() / 8)) * 32 + sin(phase) * (slot % 97 * 0.08::DOUBLE + 18), slot // 16 % 80 * 0.18::DOUBLE - 7.2 FROM i
UNION ALL SELECT 'transit', slot, (slot % 100 - 49.5::DOUBLE) * 1.35, (slot % 12 - 5.5::DOUBLE) * 5.5 + sin(phase * 3) * 0.8, (slot // 100 % 100 - 49.5::DOUBLE) * 0.22 FROM i
UNION ALL SELECT 'siegel', slot, sqrt(slot) * 0.45 * cos(phase), sqrt(slot) * 0.45 * sin(phase), (slot % 257 - 128::DOUBLE) * 0.035 FROM i"""


@BOOK.add(f"SELECT manifold, slot // 1000 AS block, round(sum(x), 3) AS x, round(sum(y), 3) AS y, round(sum(z), 3) AS z, count(*) AS n FROM ({_LAYOUT_SQL}) GROUP BY ALL")
def cohort_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders laid out in all manifolds."""
    nodes = generators.cohort_nodes(spark, slots=table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("slot")))
    rows = [generators.cohort_layout(nodes, m).withColumn("manifold", F.lit(m)) for m in MANIFOLDS]
    blocks = validate.union(rows).groupBy("manifold", F.expr("slot div 1000").alias("block"))
    return blocks.agg(*(F.round(F.sum(a), 3).alias(a) for a in "xyz"), F.count("*").alias("n"))


@BOOK.add(f"""
WITH l AS (SELECT slot, x FROM ({POSITIONS_SQL}) WHERE manifold = 'hybrid'), n AS (SELECT count(*) AS n FROM embeddings),
e AS (SELECT l_orderkey * 8 + l_linenumber AS slot, l_suppkey % n AS source, l_partkey % n AS target FROM lineitem, n),
p AS (SELECT e.slot, s.x AS sx, t.x AS tx, a.x AS ax, b.x AS bx, (s.x + t.x) * 0.5 - (e.slot % 17 * 0.035::DOUBLE - 0.28) AS mx FROM e JOIN l s ON s.slot = e.source JOIN l t ON t.slot = e.target
  JOIN l a ON a.slot = e.source // 100 * 100 JOIN l b ON b.slot = e.target // 100 * 100)
SELECT 'straight' AS style, 2 AS points, count(*) AS n, round(sum(sx + tx), 4) AS x FROM p UNION ALL SELECT 'curved', 3, count(*), round(sum(sx + mx + tx), 4) FROM p
UNION ALL SELECT 'bundled', 4, count(*), round(sum(sx + ax + bx + tx), 4) FROM p""")
def edge_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as paths between positions."""
    layout = positions(spark, sf_dir).where("manifold = 'hybrid'").select("slot", "x", "y", "z")
    count = table(spark, sf_dir, "embeddings").count()
    edges = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey").cast("bigint") * 8 + F.col("l_linenumber")).alias("slot"), (F.col("l_suppkey").cast("bigint") % count).alias("source"), (F.col("l_partkey").cast("bigint") % count).alias("target")
    )
    found = []
    for style in ("straight", "curved", "bundled"):
        made = paths.edge_paths(edges, layout, style)
        total = F.aggregate("points", F.lit(0.0), lambda acc, p: acc + p["x"])
        found.append(made.groupBy(F.lit(style).alias("style"), F.size("points").alias("points")).agg(F.count("*").alias("n"), F.round(F.sum(total), 4).alias("x")))
    return validate.union(found)


@BOOK.add("""
WITH s AS (SELECT c_custkey AS stroke, c_custkey * 7 AS first_point, c_custkey % 4 + 2 AS point_count FROM customer)
SELECT stroke, count(*) AS n, round(sum(value), 4) AS x FROM s JOIN events ON event_id >= first_point AND event_id < first_point + point_count GROUP BY ALL""")
def guide_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stroke of each customer through the points of events."""
    k = F.col("c_custkey").cast("bigint")
    strokes = table(spark, sf_dir, "customer").select(k.alias("stroke"), (k * 7).alias("first_point"), (k % 4 + 2).alias("point_count"))
    points = table(spark, sf_dir, "events").select(F.col("event_id").alias("point"), F.col("value").alias("x"), *(F.lit(0.0).alias(a) for a in "yz"))
    made = paths.slice_points(strokes, points)
    return made.select("stroke", F.size("points").cast("bigint").alias("n"), F.round(F.aggregate("points", F.lit(0.0), lambda acc, p: acc + p["x"]), 4).alias("x"))


@BOOK.add("""
WITH d AS (SELECT n_nationkey AS id, sha256(n_nationkey::VARCHAR) AS h FROM nation)
SELECT id, round((('0x' || substr(h, 1, 8))::BIGINT / 4294967295.0::DOUBLE * 2 - 1) * 18, 6) AS x, round((('0x' || substr(h, 9, 8))::BIGINT / 4294967295.0::DOUBLE * 2 - 1) * 18, 6) AS y,
  round((('0x' || substr(h, 17, 8))::BIGINT / 4294967295.0::DOUBLE * 2 - 1) * 18, 6) AS z FROM d""")
def stable_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), generators.stable_position(F.col("n_nationkey")).alias("p"))
    return rows.select("id", *(F.round(f"p.{a}", 6).alias(a) for a in "xyz"))


@BOOK.add("SELECT c_custkey AS slot, c_acctbal AS balance FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def label_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty labels to show first: those of the highest balances."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slot"), F.col("c_acctbal").alias("balance")).orderBy(F.desc("balance"), "slot").limit(20)


@BOOK.add("""
WITH p AS (SELECT n_nationkey % 6 + 1 AS kind_number, n_nationkey AS manifold, (n_nationkey * 977 % 3000 + 1)::BIGINT AS length FROM nation)
SELECT kind_number, manifold, length, (4096 + coalesce(sum((length + 63) // 64 * 64) OVER (ORDER BY kind_number, manifold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM p""")
def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select((k % 6 + 1).alias("kind_number"), k.alias("manifold"), (k * 977 % 3000 + 1).cast("bigint").alias("length"))
    return pages.placed(rows, 4096).select("kind_number", "manifold", "length", "offset")


@BOOK.add("""
WITH e AS (SELECT event_id % 5 AS x0, event_id % 7 AS y0, event_id % 11 AS x1, event_id % 7 + event_id % 3 AS y1, value AS width FROM events),
     d AS (SELECT (x1 - x0)::DOUBLE AS dx, (y1 - y0)::DOUBLE AS dy, greatest(width * 0.5, 0.5) AS half FROM e),
     l AS (SELECT *, sqrt(dx * dx + dy * dy) AS n FROM d)
SELECT count(*) AS n, round(sum(CASE WHEN n <= 0.001 THEN 0 ELSE -dy / n * half END), 3) AS x, round(sum(CASE WHEN n <= 0.001 THEN half ELSE dx / n * half END), 3) AS y FROM l""")
def edge_ribbons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    x, y = geometry.ribbon(*(c.cast("double") for c in (k % 5, k % 7, k % 11, k % 7 + k % 3)), F.col("value"))
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.round(F.sum(x), 3).alias("x"), F.round(F.sum(y), 3).alias("y"))
