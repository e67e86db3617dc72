"""Operators that cut their work by cells, grams, levels or rounds, against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.operators import admission, balltree, delta, logs, merkle, picking, quantiles, textsearch


def some_nodes(rng, n):
    crowd = [[rng.gauss(0, 0.02) for _ in range(3)] for _ in range(n // 3)]
    spread = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(n - len(crowd))]
    return [(k, *p, rng.choice([0.0, 0.01, 0.05])) for k, p in enumerate(crowd + spread)]


def some_rays(rng, n):
    out = []
    for k in range(n):
        d = [rng.gauss(0, 1) for _ in range(3)] if k % 5 else [float(a == k // 5 % 3) * (-1) ** k for a in range(3)]
        size = math.sqrt(sum(x * x for x in d))
        out.append((k, *(rng.choice([rng.uniform(-2, 2), 0.0]) for _ in range(3)), *(x / size for x in d)))
    return out + [(n, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (n + 1, 5.0, 5.0, 5.0, 0.0, 0.0, 1.0)]


NODES, RAYS = "id long, x double, y double, z double, radius double", "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double"


@pytest.mark.parametrize("bound", [7, 20_000])
def test_rays_pick_as_all_with_all(spark, bound):
    rng = random.Random(bound)
    nodes, rays = some_nodes(rng, 300), some_rays(rng, 80)
    wanted = {}
    for k, *r in rays:
        for i, x, y, z, radius in nodes:
            offset = [x - r[0], y - r[1], z - r[2]]
            depth = sum(a * b for a, b in zip(offset, r[3:]))
            away = sum(a * a for a in offset) - depth * depth
            if depth > 0 and away <= radius * radius:
                least, hits = wanted.get(k, ((math.inf, 0), 0))
                wanted[k] = min(least, (depth, i)), hits + 1
    nodes_df, rays_df = spark.createDataFrame(nodes, NODES), spark.createDataFrame(rays, RAYS)
    got = {r.ray_id: (r.id, r.hits) for r in picking.pick_along_rays(nodes_df, rays_df, bound).collect()}
    assert got == {k: (least[1], hits) for k, (least, hits) in wanted.items()} and len(got) > 8
    assert picking.pick_along_rays(nodes_df.where("false"), rays_df).count() == 0


def test_rays_test_few_of_all_pairs(spark):
    rng = random.Random(8)
    nodes = spark.createDataFrame([(k, *(rng.uniform(-1, 1) for _ in range(3)), 0.01) for k in range(3000)], NODES)
    rays = spark.createDataFrame(some_rays(rng, 60), RAYS)
    tested = picking.tested_pairs(nodes, rays, picking.Grid.over(nodes)).count()
    assert 0 < tested < 0.03 * 3000 * 60


def test_search_equals_scanning(spark):
    rng = random.Random(9)
    words = ["the", "The", "é", "an", "n", "anan", "新羅", "😀a", "a😀", "x y", "İ"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for k in range(150)] + [(900, None), (901, ""), (902, "T" * 5000)]
    queries = [(f"q{k}", q) for k, q in enumerate(["THE", " an ", "ANAN", "É", "é", "新", "😀", "a 😀a", "nosuch", "", "  ", None, "x", "tt", "İ", "(?=", "羅 x y", "a a"])]
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    wanted = sorted((q, k) for q, s in queries if s and s.strip() for k, t in texts if t is not None and lower(s.strip()) in lower(t))
    for bound in (10, 20_000):
        found = textsearch.find_texts(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(queries, "query_id string, query string"), bound)
        assert sorted(map(tuple, found.collect())) == wanted
    assert textsearch.find_texts(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "query_id string, query string")).count() == 0


def test_search_of_few_queries_keeps_no_grams_of_texts(spark, monkeypatch):
    rng = random.Random(10)
    some = ["".join(rng.choice("abÉé新.") for _ in range(rng.choice([1, 2, 4, 6, 9]))) for _ in range(60)]
    texts = [(k, " ".join(rng.choice(some) + rng.choice(["", "X", "\u00a0", "\x1c", "\n"]) for _ in range(30))) for k in range(200)] + [(900, "ab" * 400), (901, " \t"), (902, None)]
    queries = [(k, q) for k, q in enumerate(some[:40] + [f"{a} {b}" for a, b in zip(some, some[1:])] + ["ab" * 200, "\x1c", "\u00a0 ", "é\u00a0", "zz"])]
    kept, white = {}, "\t\n\x0b\x0c\r \x85\u00a0"
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    wanted = sorted((q, k) for q, s in queries if s.strip(white) for k, t in texts if t is not None and lower(s.strip(white)) in lower(t))
    stored = textsearch.stored
    monkeypatch.setattr(textsearch, "stored", lambda df, label: kept.setdefault(label, stored(df, label)))
    frames = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(queries, "query_id long, query string")
    assert sorted(map(tuple, textsearch.find_texts(*frames).collect())) == wanted
    assert sum(df.count() for df in kept.values()) <= len(queries)
    kept.clear()
    # queries too many to broadcast go through the index, with the same pairs
    assert sorted(map(tuple, textsearch.find_texts(*frames, broadcast_rows=0).collect())) == wanted and "postings" in kept


def test_words_are_looked_up_alike_when_memory_is_full(monkeypatch):
    rng = random.Random(11)
    some = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    queries = some[:50] + [b"a  bc", b"abcabc" * 20]
    full, least = textsearch._Held(queries), textsearch._Held(queries)
    plain = lambda w: {k for k, q in enumerate(queries) if max(q.split(), key=len) in w}
    words = some + [b"abc" * 60, b"c" + b"abcabc" * 20]
    assert [set(full[w]) for w in words] == [plain(w) for w in words]
    monkeypatch.setattr(textsearch, "WORDS", 3)
    assert [set(least[w]) for w in words * 2] == [plain(w) for w in words * 2] and len(least) <= 3 and len(least.heads) <= 3


def test_delta_of_versions(spark):
    schema = "id long, label string, x double"
    before = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, None, 3.0), (4, "n", 4.0)], schema)
    after = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (4, None, 5.0), (5, "e", 5.0)], schema)
    found = delta.scene_delta(before, after)
    assert sorted((r.op, r.id, r.changed) for r in found.collect()) == [("add", 5, []), ("remove", 3, []), ("update", 2, ["x"]), ("update", 4, ["label", "x"])]
    key = lambda r: r[0]
    assert sorted(map(tuple, delta.apply_delta(before, found).collect()), key=key) == sorted(map(tuple, after.collect()), key=key)
    assert delta.sync_scene(after, 7, after, 7).count() == 0
    assert {r.op for r in delta.sync_scene(before, 6, after, 7).collect()} == {"load"} and delta.sync_scene(None, None, after, 7).count() == 4
    assert {(r.op, r.lane, r.n) for r in delta.changes_by_lane(found, ["label", "x"]).collect()} == {("add", "", 1), ("remove", "", 1), ("update", "", 2), ("update", "label", 1), ("update", "x", 2)}


def plain_root(digests, fanout):
    depth = 1
    while len(digests) > 1:
        digests = [hashlib.sha256("".join(digests[k : k + fanout]).encode()).hexdigest() for k in range(0, len(digests), fanout)]
        depth += 1
    return digests[0], depth


@pytest.mark.parametrize("n", [1, 5, 125, 126])
def test_merkle_root_and_changed_pages(spark, n):
    pages = [(k * 3, f"page {k}") for k in range(n)]
    changed = [(k, text + "!" if k % 60 == 3 else text) for k, text in pages]
    df = [spark.createDataFrame(p, "page long, text string") for p in (pages, changed)]
    trees = [merkle.levels(merkle.page_digests(p, "page", F.col("text")), 5) for p in df]
    assert tuple(merkle.root(trees[0]).first()) == plain_root([hashlib.sha256(t.encode()).hexdigest() for _, t in pages], 5)
    assert sorted(r.place for r in merkle.changed_pages(*trees, 5).collect()) == [k for k, (a, b) in enumerate(zip(pages, changed)) if a != b]
    longer = merkle.levels(merkle.page_digests(spark.createDataFrame(pages + [(10**6, "last")], "page long, text string"), "page", F.col("text")), 5)
    assert [r.place for r in merkle.changed_pages(trees[0], longer, 5).collect()] == [n]
    assert merkle.all_levels(trees[0]).count() == sum(t.count() for t in trees[0])


def test_quantiles_of_keys_are_exact(spark):
    rng = random.Random(5)
    rows = [(k % 4, rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) * 1e300, 5.0, 5e-324, 0.0, None, float("nan")])) for k in range(800)] + [(9, 1.5), (10, None)]
    rows += [(11, x) for x in (-1.7976931348623157e308, 1.7976931348623157e308, 1.0)]
    df = spark.createDataFrame(rows, "key long, v double").repartition(4)
    for share in (0.0, 0.5, 0.95, 1.0):
        wanted = {}
        for key in {k for k, _ in rows}:
            held = sorted(v for k, v in rows if k == key and v is not None and v == v)
            if held:
                wanted[key] = held[max(1, math.ceil(len(held) * share)) - 1], len(held)
        assert {r.key: (r.v, r.n) for r in quantiles.nearest_ranks(df, "v", share, "key").collect()} == wanted
    assert quantiles.nearest_ranks(df.where("false"), "v", 0.5).count() == 0


def test_sliding_ranks_over_pieces(spark):
    rng = random.Random(6)
    rows = [(0 if k % 3 else k % 5, k, rng.choice([None, float(rng.randrange(9)), rng.random()])) for k in range(500)]
    df = spark.createDataFrame(rows, "key long, at long, v double").repartition(3)
    rings, wanted = {}, {}
    for key, at, v in rows:
        ring = rings.setdefault(key, [])
        ring.append(v)
        held = sorted(x for x in ring[-20:] if x is not None)
        wanted[at] = held[math.ceil(len(held) * 0.9) - 1] if held else None
    got = quantiles.sliding_ranks(df, "key", "at", "v", 20, 0.9, "rank", piece_rows=30)
    assert got.columns == ["key", "at", "v", "rank"]
    found = {r.at: r["rank"] for r in got.collect()}
    assert {k: None if v is None or v != v else v for k, v in found.items()} == wanted
    assert logs.ring_percentile(df, "key", "at", "v").count() == 500


@pytest.mark.parametrize("capacity", [0, 1, 100, 5000])
def test_admission_equals_a_loop(spark, capacity):
    rng = random.Random(capacity)
    rows = [(k % 3 if k % 2 else 0, k, rng.choice([0, 1, 2, rng.randrange(60), rng.randrange(200)])) for k in range(400)]
    total, wanted = {}, {}
    for lane, k, size in rows:
        wanted[k] = total.get(lane, 0) + size <= capacity
        total[lane] = total.get(lane, 0) + size * wanted[k]
    df = spark.createDataFrame(rows, "lane long, order long, size long").repartition(5)
    assert {r.order: r.accepted for r in admission.admitted_batches(df, capacity).collect()} == wanted
    assert admission.admitted_batches(df.where("false"), capacity).count() == 0


@pytest.mark.parametrize("cells,most", [(500_000, 64), (40, 64), (40, 1)])
def test_rays_of_one_line_are_walked_once_and_not_shuffled(spark, monkeypatch, cells, most):
    monkeypatch.setattr(picking, "BLOCK_CELLS", cells)
    monkeypatch.setattr(picking, "MOST_BLOCKS", most)
    rng = random.Random(5)
    nodes = [(i, *(rng.uniform(-1, 1) for _ in "xyz"), 0.2) for i in range(60)]
    nodes += [(100 + i, *n[1:]) for i, n in enumerate(nodes[:20])]
    rays = [(k, -2.0, 0.1 * (k % 7 - 3), 0.1 * (k % 5 - 2), 1.0, 0.0, 0.0) for k in range(350)]
    expected = {}
    for k, ox, oy, oz, *_ in rays:
        hits = sorted((x - ox, i) for i, x, y, z, r in nodes if (y - oy) ** 2 + (z - oz) ** 2 <= r * r)
        if hits:
            expected[k] = hits[0][1], len(hits)
    walked, plain = [], picking.tested_pairs
    monkeypatch.setattr(picking, "tested_pairs", lambda n, r, *a: walked.append((n.count(), r.count())) or plain(n, r, *a))
    nodes_df = spark.createDataFrame(nodes, "id long, x double, y double, z double, radius double")
    rays_df = spark.createDataFrame(rays, "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    assert {r.ray_id: (r.id, r.hits) for r in picking.pick_along_rays(nodes_df, rays_df).collect()} == expected
    assert walked == [(60, 35)]


def plain_picks(nodes, rays):
    """(nearest id, depth, hits) of each ray that meets a node, with the formula of the queries."""
    found = {}
    for k, *r in rays:
        for i, x, y, z, radius, copies in nodes:
            offset = x - r[0], y - r[1], z - r[2]
            depth = offset[0] * r[3] + offset[1] * r[4] + offset[2] * r[5]
            away = offset[0] * offset[0] + offset[1] * offset[1] + offset[2] * offset[2] - depth * depth
            if depth > 0 and away <= radius * radius:
                least, hits = found.get(k, ((math.inf, 0), 0))
                found[k] = min(least, (depth, i)), hits + copies
    return {k: (i, depth, hits) for k, ((depth, i), hits) in found.items()}


@pytest.mark.parametrize("leaf,at_once", [(2, 3), (128, 2_048)])
def test_trees_pick_as_the_plain_formula(monkeypatch, leaf, at_once):
    monkeypatch.setattr(balltree, "LEAF", leaf)
    monkeypatch.setattr(balltree, "AT_ONCE", at_once)
    rng = random.Random(leaf)
    nodes = [(*n, rng.choice([1, 1, 3])) for n in some_nodes(rng, 260)]
    # equal places and depths, a tube of radius 0 that is met exactly, far and very far nodes
    nodes += [(500, 0.5, 0.0, 0.0, 0.1, 1), (400, 0.5, 0.0, 0.0, 0.2, 2), (600, 0.25, 0.0, 0.0, 0.0, 1), (700, 0.0, 3e8, 0.0, 0.5, 1), (800, 1e200, 0.0, 0.0, 1.0, 1)]
    rays = some_rays(rng, 150) + [(900, -1.0, 0.0, 0.0, 1.0, 0.0, 0.0), (901, -1e9, 0.0, 0.0, 1.0, 0.0, 0.0), (902, 0.5, 0.0, 0.0, 1.0, 0.0, 0.0), (903, 1e200, 0.0, 0.0, -1.0, 0.0, 0.0)]
    for some in (nodes, nodes[:-1], nodes[:-2]):
        ids, copies = (np.array([n[k] for n in some]) for k in (0, 5))
        at, lines = np.array([n[1:4] for n in some]), np.array([r[1:] for r in rays])
        with np.errstate(all="ignore"):
            nearest, depth, hits = balltree.BallTree(ids, at, np.array([n[4] for n in some]), copies).pick(lines[:, :3], lines[:, 3:])
        assert {r[0]: got for r, got in zip(rays, zip(nearest.tolist(), depth.tolist(), hits.tolist())) if got[2]} == plain_picks(some, rays)


@pytest.mark.parametrize("nodes_at_once,rays_at_once", [(500_000, 300_000), (50, 40)])
def test_a_ray_gives_a_row_for_a_block_of_nodes(spark, monkeypatch, nodes_at_once, rays_at_once):
    monkeypatch.setattr(picking, "BLOCK_CELLS", nodes_at_once)
    monkeypatch.setattr(picking, "WALK_RAYS", rays_at_once)
    rng = random.Random(12)
    nodes = [(k, *(rng.gauss(0, 0.1) for _ in "xyz"), 0.05) for k in range(400)]
    rays = [(k, -1.0, rng.gauss(0, 0.1), rng.gauss(0, 0.1), 1.0, 0.0, 0.0) for k in range(300)]
    wanted = plain_picks([(*n, 1) for n in nodes], rays)
    odd = [(990, math.nan, 0.0, 0.0, 1.0), (991, None, 0.0, 0.0, 1.0), (992, math.inf, 0.0, 0.0, 1.0), (993, 0.0, 0.0, 0.0, None)]
    nodes_df = spark.createDataFrame(nodes + odd, NODES)
    rays_df = spark.createDataFrame(rays + [(990, None, 0.0, 0.0, 1.0, 0.0, 0.0), (991, math.nan, 0.0, 0.0, 1.0, 0.0, 0.0), (992, 0.0, 0.0, 0.0, None, None, None)], RAYS)
    fine = nodes_df.where("id < 990")
    blocks = -(-len(nodes) // nodes_at_once)
    rows = picking.tested_pairs(fine, rays_df, picking.Grid.over(fine)).count()
    assert len(wanted) <= rows <= blocks * len(wanted) and sum(hits for *_, hits in wanted.values()) > 10 * len(rays)
    assert {r.ray_id: (r.id, r.depth, r.hits) for r in picking.pick_along_rays(nodes_df, rays_df).collect()} == wanted
