"""Queries over many rays, many searches, two versions of a scene, page trees and ordered admission."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.functions import geometry
from meshwork.operators import admission, delta, merkle, picking, quantiles, textsearch
from meshwork.operators.dealing import stored
from meshwork.operators.validate import union
from meshwork.sources.tables import positions, table

from .registering import Book
from .scene_queries import POSITIONS_SQL

BOOK = Book()
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPHERES_SQL = f"SELECT id, x, y, z, 0.01 + 0.002 * (kind % 10) AS radius FROM ({POSITIONS_SQL}) WHERE manifold = 'hybrid'"
_RAYS_SQL = """
  SELECT ray_id, ox, oy, oz, dx / size AS dx, dy / size AS dy, dz / size AS dz FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS size FROM (
    SELECT event_id AS ray_id, CASE WHEN event_id % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS ox, (event_id % 41 - 20)::DOUBLE / 50 AS oy, (user_id % 37 - 18)::DOUBLE / 50 AS oz,
           CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS dx, (event_id % 11 - 5)::DOUBLE / 20 AS dy, (user_id % 7 - 3)::DOUBLE / 20 AS dz FROM events))"""


def _spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    radius = 0.01 + 0.002 * (F.col("kind") % 10)
    return positions(spark, sf_dir).where("manifold = 'hybrid'").select("id", "x", "y", "z", radius.alias("radius"))


@BOOK.add(f"""
WITH n AS ({_SPHERES_SQL}), r AS ({_RAYS_SQL}),
  p AS (SELECT ray_id, id, radius, (x - ox) * dx + (y - oy) * dy + (z - oz) * dz AS depth, (x - ox) * (x - ox) + (y - oy) * (y - oy) + (z - oz) * (z - oz) AS square FROM n, r)
SELECT ray_id, arg_min(id, depth) AS id, round(min(depth), 6) AS depth, count(*) AS hits FROM p WHERE depth > 0 AND square - depth * depth <= radius * radius GROUP BY ray_id""")
def rays_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a ray of each event meets first among all positions of a layout."""
    nodes = _spheres(spark, sf_dir)
    even, part = F.col("event_id") % 2 == 0, lambda c, n, d: (F.col(c) % n - n // 2).cast("double") / d
    side = F.when(even, -1.0).otherwise(1.0)
    d = [-side, part("event_id", 11, 20), part("user_id", 7, 20)]
    size = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    rays = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ray_id"), side.alias("ox"), part("event_id", 41, 50).alias("oy"), part("user_id", 37, 50).alias("oz"), *((c / size).alias(f"d{a}") for a, c in zip("xyz", d))
    )
    return picking.pick_along_rays(nodes, rays).select("ray_id", "id", F.round("depth", 6).alias("depth"), "hits")


_TAN = math.tan(math.pi / 8)
_PIXELS_SQL = f"""
  b AS (SELECT min(x - radius) AS lx, max(x + radius) AS hx, min(y - radius) AS ly, max(y + radius) AS hy, min(z - radius) AS lz, max(z + radius) AS hz FROM n),
  c AS (SELECT (lx + hx) / 2 AS tx, (ly + hy) / 2 AS ty, (lz + hz) / 2 AS tz, least(greatest(greatest(sqrt((hx - lx) * (hx - lx) + (hy - ly) * (hy - ly) + (hz - lz) * (hz - lz)) / 2, 1.0) / {math.sin(math.pi / 8)!r} * 1.1, 0.05), 100000.0) AS d FROM b),
  e AS (SELECT event_id AS ray_id, user_id * 0.05::DOUBLE AS yaw, least(greatest(0.2 - (event_id % 60 - 30) * 0.01::DOUBLE, -({math.pi / 2 - 0.01!r})), {math.pi / 2 - 0.01!r}) AS pitch,
               ((500 + event_id * 7 % 600)::DOUBLE * (2.0 / 1600) - 1.0) * ({_TAN!r} * 16 / 9) AS a, ((250 + event_id * 13 % 400)::DOUBLE * (-2.0 / 900) + 1.0) * {_TAN!r} AS u, c.* FROM events, c),
  f AS (SELECT *, -cos(pitch) * sin(yaw) AS fx, -sin(pitch) AS fy, -cos(pitch) * cos(yaw) AS fz, sqrt(a * a + u * u + 1.0) AS size FROM e),
  r AS (SELECT ray_id, tx - fx * d AS ox, ty - fy * d AS oy, tz - fz * d AS oz, (fx + cos(yaw) * a - sin(pitch) * sin(yaw) * u) / size AS dx, (fy + cos(pitch) * u) / size AS dy, (fz - sin(yaw) * a - sin(pitch) * cos(yaw) * u) / size AS dz FROM f)"""


@BOOK.add(f"""
WITH n AS ({_SPHERES_SQL}), {_PIXELS_SQL},
  p AS (SELECT ray_id, id, radius, (x - ox) * dx + (y - oy) * dy + (z - oz) * dz AS depth, (x - ox) * (x - ox) + (y - oy) * (y - oy) + (z - oz) * (z - oz) AS square FROM n, r)
SELECT ray_id, arg_min(id, depth) AS id, count(*) AS hits FROM p WHERE depth > 0 AND square - depth * depth <= radius * radius GROUP BY ray_id""")
def picks_through_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's pixels show: a camera that fits all nodes is turned by user, and each event's pixel sends a ray."""
    nodes = stored(_spheres(spark, sf_dir), "spheres")  # read for the box and for the rays' size as well
    box = F.broadcast(geometry.bounds(nodes).select(F.struct("*").alias("box")))  # one row
    k, lens = F.col("event_id"), geometry.Lens()
    pose = geometry.fitted_pose("box", lens).turned(F.col("user_id") * 10.0, (k % 60 - 30) * 2.0)
    origin, direction = pose.ray((k * 7 % 600 + 500).cast("double"), (k * 13 % 400 + 250).cast("double"), lens)
    rays = table(spark, sf_dir, "events").crossJoin(box).select(k.alias("ray_id"), *(c.alias(f"{kind}{a}") for kind, cs in (("o", origin), ("d", direction)) for a, c in zip("xyz", cs)))
    return picking.pick_along_rays(nodes, rays).select("ray_id", "id", "hits")


@BOOK.add(f"""
WITH n AS ({_SPHERES_SQL}), c AS (SELECT r_regionkey::BIGINT AS region, r_regionkey * 0.7::DOUBLE AS yaw, 0.2 - r_regionkey * 0.1::DOUBLE AS pitch FROM region),
  f AS (SELECT *, -cos(pitch) * sin(yaw) AS fx, -sin(pitch) AS fy, -cos(pitch) * cos(yaw) AS fz FROM c),
  v AS (SELECT region, id, yaw, pitch, x + fx * 100 AS x, y + fy * 100 AS y, z + fz * 100 AS z, fx, fy, fz FROM n, f),
  w AS (SELECT region, id, cos(yaw) * x - sin(yaw) * z AS a, -sin(pitch) * sin(yaw) * x + cos(pitch) * y - sin(pitch) * cos(yaw) * z AS u, fx * x + fy * y + fz * z AS t FROM v)
SELECT region, id, round(a / (t * {_TAN!r} * 16 / 9), 6) AS across, round(u / (t * {_TAN!r}), 6) AS up, round((1 - 0.1::DOUBLE / t) * (100000.0::DOUBLE / 99999.9::DOUBLE), 6) AS depth FROM w""")
def nodes_on_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every node shows in each region's camera."""
    k = F.col("r_regionkey")
    pose = geometry.Pose.default().turned(k * 140.0, k * 20.0)
    regions = F.broadcast(table(spark, sf_dir, "region").select("r_regionkey"))  # five rows
    rows = _spheres(spark, sf_dir).crossJoin(regions)
    shown = pose.seen([F.col(a) for a in "xyz"], geometry.Lens())
    return rows.select(k.cast("bigint").alias("region"), "id", *(F.round(c, 6).alias(name) for name, c in zip(("across", "up", "depth"), shown)))


@BOOK.add(f"""
WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM benchmark),
  t AS (SELECT 'document' AS source, doc_id AS id, translate(text, '{_UPPER}', '{_LOWER}') AS text FROM documents UNION ALL SELECT 'part', p_partkey, translate(p_name, '{_UPPER}', '{_LOWER}') FROM part)
SELECT word, count(*) FILTER (source = 'document') AS n_documents, count(*) FILTER (source = 'part') AS n_parts, min(id) FILTER (source = 'document') AS first_document
FROM w JOIN t ON contains(t.text, translate(word, '{_UPPER}', '{_LOWER}')) WHERE length(word) > 0 GROUP BY word""")
def words_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every benchmark text searched in all documents and part names."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("query_id")).distinct()
    # both sources share one index: parts take odd ids
    texts = union(
        [
            table(spark, sf_dir, "documents").select((F.col("doc_id") * 2).alias("id"), "text"),
            table(spark, sf_dir, "part").select((F.col("p_partkey").cast("bigint") * 2 + 1).alias("id"), F.col("p_name").alias("text")),
        ]
    )
    found = textsearch.find_texts(texts, words.withColumn("query", F.col("query_id")))
    document = F.col("id") % 2 == 0
    return found.groupBy(F.col("query_id").alias("word")).agg(
        F.count_if(document).alias("n_documents"), F.count_if(~document).alias("n_parts"), F.min(F.when(document, (F.col("id") / 2).cast("bigint"))).alias("first_document")
    )


_VERSIONS_SQL = """
  a AS (SELECT p_partkey::BIGINT AS id, p_name AS label, p_size::BIGINT AS size, p_retailprice AS price FROM part),
  e AS (SELECT user_id AS id, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS value FROM events GROUP BY user_id),
  b AS (SELECT a.id, CASE WHEN e.kind = 'view' THEN a.label || '!' ELSE a.label END AS label, CASE WHEN e.kind = 'click' THEN NULL ELSE a.size END AS size,
               CASE WHEN e.kind IN ('view', 'purchase') THEN e.value ELSE a.price END AS price FROM a LEFT JOIN e USING (id) WHERE e.kind IS DISTINCT FROM 'error'
        UNION ALL SELECT id + 1000000000, kind, id % 50, value FROM e WHERE kind <> 'view')"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as a scene, and the scene after the last event of each user: some parts go, change or come."""
    part = table(spark, sf_dir, "part")
    before = part.select(F.col("p_partkey").cast("bigint").alias("id"), F.col("p_name").alias("label"), F.col("p_size").cast("bigint").alias("size"), F.col("p_retailprice").alias("price"))
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", "event_id").alias("kind"), F.max_by("value", "event_id").alias("value"))
    kind, pick = F.col("kind"), lambda when, new, old: F.when(when, new).otherwise(F.col(old)).alias(old)
    kept = before.join(last, "id", "left").where(~kind.eqNullSafe("error")).select(
        "id", pick(kind == "view", F.concat("label", F.lit("!")), "label"), pick(kind == "click", F.lit(None), "size"), pick(kind.isin("view", "purchase"), F.col("value"), "price")
    )
    added = last.where(kind != "view").select((F.col("id") + 1_000_000_000).alias("id"), kind.alias("label"), (F.col("id") % 50).alias("size"), F.col("value").alias("price"))
    return before, kept.unionByName(added)


@BOOK.add(f"""
WITH {_VERSIONS_SQL}
SELECT CASE WHEN a.id IS NULL THEN 'add' WHEN b.id IS NULL THEN 'remove' ELSE 'update' END AS op, coalesce(a.id, b.id) AS id,
       CASE WHEN a.id IS NULL OR b.id IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN a.label IS DISTINCT FROM b.label THEN 'label' END, CASE WHEN a.size IS DISTINCT FROM b.size THEN 'size' END,
         CASE WHEN a.price IS DISTINCT FROM b.price THEN 'price' END], lambda x: x IS NOT NULL), ',') END AS changed, b.label, b.size, b.price
FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR (a.label, a.size, a.price) IS DISTINCT FROM (b.label, b.size, b.price)""")
def scene_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = delta.scene_delta(*_versions(spark, sf_dir))
    return found.withColumn("changed", F.array_join("changed", ","))


@BOOK.add(f"WITH {_VERSIONS_SQL} SELECT id, label, size, price FROM b")
def scene_after_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second version, from the first one and what changed."""
    before, after = _versions(spark, sf_dir)
    return delta.apply_delta(before, delta.sync_scene(before, 1, after, 1))


def _page_levels(spark: SparkSession, sf_dir: str, content: Column) -> list[DataFrame]:
    return merkle.levels(merkle.page_digests(table(spark, sf_dir, "documents"), "doc_id", content))


_LEVEL_SQL = "l{n} AS (SELECT place // 64 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM l{k} GROUP BY 1)"
_ROOTS = " UNION ALL ".join(f"SELECT digest, {k + 1} AS levels, (SELECT count(*) FROM l{k}) AS n FROM l{k}" for k in range(6))


@BOOK.add(f"""
WITH l0 AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, sha256(text) AS digest FROM documents), {', '.join(_LEVEL_SQL.format(k=k, n=k + 1) for k in range(5))}
SELECT digest, levels FROM ({_ROOTS}) WHERE n = 1 ORDER BY levels LIMIT 1""")
def document_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest for all documents, by levels of 64."""
    return merkle.root(_page_levels(spark, sf_dir, F.col("text")))


@BOOK.add("SELECT place FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents) WHERE doc_id % 97 = 5")
def corrupt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of all documents no longer have their digest."""
    now = F.when(F.col("doc_id") % 97 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return merkle.changed_pages(_page_levels(spark, sf_dir, F.col("text")), _page_levels(spark, sf_dir, now))


@BOOK.add("SELECT event_type, quantile_disc(value, 0.95) AS value, count(*) AS n FROM events GROUP BY event_type")
def p95_by_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.nearest_ranks(table(spark, sf_dir, "events"), "value", 0.95, "event_type")


@BOOK.add("""
WITH RECURSIVE b AS (SELECT user_id % 10 AS lane, event_id, event_id * 37 % 101 + 1 AS size, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS k FROM events),
  t AS (SELECT lane, 0::BIGINT AS k, NULL::BIGINT AS event_id, 0::BIGINT AS total, false AS accepted FROM (SELECT DISTINCT lane FROM b)
    UNION ALL SELECT b.lane, b.k, b.event_id, total + CASE WHEN total + size <= 3000 THEN size ELSE 0 END, total + size <= 3000 FROM t JOIN b ON b.lane = t.lane AND b.k = t.k + 1)
SELECT lane, event_id, accepted FROM t WHERE k > 0""")
def admitted_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs of ten lanes in order, each applied if its lane's capacity still holds it."""
    k = F.col("event_id")
    batches = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("lane"), k.alias("order"), (k * 37 % 101 + 1).alias("size"))
    return admission.admitted_batches(batches, 3_000).select("lane", F.col("order").alias("event_id"), "accepted")
