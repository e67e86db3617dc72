import math

import pytest
from pyspark.sql import functions as F

from meshwork.functions import geometry, gradient, masks
from meshwork.operators import diff, scene, slots, validate, views
from meshwork.sources import generators
from meshwork.types import View

COLOR = [0.2, 0.4, 0.8, 1.0]


def snapshot(spark, ids, edges, x=None):
    nodes = spark.createDataFrame([(k, i, float(i) if x is None else x, 0.0, 0.0, 1.0, COLOR) for k, i in enumerate(ids)], "ord int, id long, x double, y double, z double, radius double, color array<double>")
    rows = spark.createDataFrame([(k, *e, 1.0, COLOR) for k, e in enumerate(edges)], "ord int, id long, source long, target long, width double, color array<double>")
    return nodes, rows


@pytest.mark.parametrize(
    "ids,edges,x,first",
    [
        ([1, 2], [(10, 1, 2)], None, None),
        ([1, 1], [], None, ("DuplicateNode", 1, None)),
        ([1], [(10, 1, 9)], None, ("MissingTargetNode", 10, "9")),
        ([1], [], math.nan, ("InvalidNodeVisual", 1, None)),
        ([], [], None, None),
        ([-5, 2], [(10, 2, -5)], None, None),
    ],
)
def test_snapshot_rules(spark, ids, edges, x, first):
    found = validate.first_violation(validate.snapshot_violations(*snapshot(spark, ids, edges, x))).first()
    assert (tuple(found) if found else None) == first


def lanes(spark, nodes=(), edges=(), revision=2):
    n = spark.createDataFrame([(revision, op, k, i) for k, (op, i) in enumerate(nodes)], "revision long, op string, ord int, id long")
    e = spark.createDataFrame([(revision, op, k, i, s, t) for k, (op, i, s, t) in enumerate(edges)], "revision long, op string, ord int, id long, source long, target long")
    return n, e


@pytest.mark.parametrize(
    "nodes,edges,revision,rule",
    [
        ([("remove", 3), ("add", 4)], [("remove", 11, None, None), ("add", 12, 2, 4)], 2, None),
        ([("remove", 2)], [], 2, ("IncidentEdgeNotRemoved", 2, "10")),
        ([("remove", 3)], [("update", 11, 2, 1)], 2, None),
        ([("update", 1), ("remove", 1)], [], 2, ("ConflictingNodeMutation", 1, None)),
        ([("update", 1), ("update", 1)], [], 2, ("ConflictingNodeMutation", 1, None)),
        ([("update", 1)], [], 1, ("StaleRevision", 1, "1")),
        ([], [("update", 99, 1, 2)], 2, ("EdgeNotFound", 99, None)),
        ([("add", 1)], [], 2, ("NodeAlreadyExists", 1, None)),
        ([("remove", 3)], [("remove", 11, None, None), ("add", 13, 1, 3)], 2, ("MissingTargetNode", 13, "3")),
    ],
)
def test_diff_rules(spark, nodes, edges, revision, rule):
    resident, links = snapshot(spark, [1, 2, 3], [(10, 1, 2), (11, 2, 3)])
    found = validate.first_violation(diff.diff_violations(resident, links, *lanes(spark, nodes, edges, revision), current=1)).first()
    assert (tuple(found) if found else None) == rule


def test_merge_and_last_writer(spark):
    state = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, value double")
    changes = spark.createDataFrame([(2, "update", 2, 9.0), (2, "add", 3, 3.0), (2, "remove", 1, None)], "revision long, op string, id long, value double")
    assert sorted(map(tuple, diff.merge(state, changes).collect())) == [(2, 9.0), (3, 3.0)]
    assert sorted(r.id for r in diff.last_writer(changes).collect()) == [2, 3]


def test_slots_are_reused_last_in_first_out(spark):
    free = spark.createDataFrame([(1, 7), (2, 4)], "pos long, slot long")
    added = spark.createDataFrame([(1, 100), (2, 101), (3, 102)], "ord long, id long")
    assert [r.slot for r in slots.allocate_slots(added, free, 10).orderBy("ord").collect()] == [4, 7, 10]
    ids = spark.createDataFrame([(i,) for i in (5, 1 << 20, 70_000, 3, -9)], "id long")
    assert [(r.id, r.slot) for r in slots.assign_slots(ids, "id").orderBy("id").collect()] == [(-9, 0), (3, 1), (5, 2), (70_000, 3), (1 << 20, 4)]


def test_ranges_join_across_blocks(spark):
    touched = spark.createDataFrame([(s,) for s in (0, 1, 2, 3, 4, 5, 9, 9, 12, 13)], "slot long")
    assert sorted(map(tuple, slots.coalesced_ranges(touched).collect())) == [(0, 6), (9, 1), (12, 2)]


def test_masks(spark):
    rows = spark.createDataFrame([(-(1 << 63), 1, 1), (1, 0, 1), (3, 1, 4)], "family_mask long, scope_mask long, review_mask long")
    assert rows.where(masks.node_visible(View(families=-(1 << 63)))).count() == 1
    assert rows.where(masks.node_visible(View())).count() == 2  # a zero mask hides even from an unfiltered view
    assert rows.where(masks.node_visible(View(), indexed=False)).count() == 3
    low, high = spark.range(1).select(*masks.split_words(F.lit(0xFEDCBA9876543210 - (1 << 64)))).first()
    assert (low, high) == (0x76543210, 0xFEDCBA98)
    assert spark.range(1).select(masks.bit_for(F.lit(64)), masks.bit_for(F.lit(63))).first()[:] == (None, -(1 << 63))
    ordered = spark.createDataFrame([(-1,), (1,), (5,)], "id long").orderBy(masks.unsigned_order(F.col("id"))).collect()
    assert [r.id for r in ordered] == [1, 5, -1]


def test_view_authority():
    assert View().is_unfiltered and not View(families=1).is_unfiltered
    assert View(families=1).authority_error(None, None, None) == "ProductIndexRequiredForFilteredView"
    assert View(families=1, generation=1).authority_error(2, None, "h") == "StaleGraphViewAuthority"
    assert View(generation=2, index_hash="h").authority_error(2, None, "h") is None


def test_camera_and_picking(spark):
    nodes = spark.createDataFrame([(1, -50.0, -10.0, 0.0, 2.0), (2, 50.0, 10.0, 0.0, 2.0)], "id long, x double, y double, z double, radius double")
    lens = geometry.Lens(width=1600, height=500)
    pose = geometry.fitted_pose("box", lens)
    origin, direction = pose.ray(F.lit(300.0), F.lit(120.0), lens)
    told = [pose.distance, *pose.target, *origin, *direction, *pose.seen([o + d * 40.0 for o, d in zip(origin, direction)], lens), *pose.seen(list(pose.target), lens)]
    for rows, distance in ((nodes, None), (nodes.where("false"), 100.0)):
        box = geometry.bounds(rows).select(F.struct("*").alias("box"))
        got = list(box.select(*(c.cast("double").alias(f"c{k}") for k, c in enumerate(told))).first())
        assert got[1:4] == [0, 0, 0] and (got[0] > 50 if distance is None else got[0] == distance)
        assert math.dist(got[4:7], got[1:4]) == pytest.approx(got[0]) and sum(d * d for d in got[7:10]) == pytest.approx(1)
        # a point on a pixel's ray shows at that pixel, the target in the middle
        assert got[10:12] == pytest.approx([300 / 800 - 1, 1 - 120 / 250]) and 0 < got[12] < 1 and got[13:15] == pytest.approx([0, 0])
    line = spark.createDataFrame([(7, 0.0, 0.0, 5.0, 1.0), (8, 0.0, 0.5, 3.0, 1.0), (9, 4.0, 0.0, 1.0, 1.0)], "id long, x double, y double, z double, radius double")
    assert geometry.pick_nearest(line, (0, 0, 0), (0, 0, 1)).first().id == 8
    assert geometry.pick_nearest(line, (0, 0, 0), (0, 0, 1), F.col("id") != 8).first().id == 7
    pose = geometry.Pose.default()
    moved = [pose.turned(F.lit(0.0), F.lit(1e9)).pitch, pose.zoomed(F.lit(1e9)).distance, pose.zoomed(F.lit(-1e3)).distance, *pose.shifted(F.lit(3.0), F.lit(4.0), geometry.Lens()).target]
    got = list(spark.range(1).select(*(c.cast("double").alias(f"c{k}") for k, c in enumerate(moved))).first())
    assert got[:3] == pytest.approx([-(math.pi / 2 - 0.01), 0.05, 100_000]) and math.hypot(*got[3:]) == pytest.approx(5 * 200 * math.tan(math.pi / 8) / 900)


def test_gradient_bands(spark):
    text = "Á \U0001f469‍\U0001f680 Z"
    rows = spark.createDataFrame([(1, text), (2, ""), (3, "gradient " * 2000)], "id long, t string")
    runs = gradient.color_runs(rows, "t", [0xFF0000, 0x0000FF], max_runs=24).collect()
    assert [r.byte_len for r in runs if r.id == 1] == [3, 1, 11, 1, 1] and not [r for r in runs if r.id == 2]
    long = [r for r in runs if r.id == 3]
    assert len(long) == 24 and sum(r.byte_len for r in long) == 18000
    with pytest.raises(ValueError):
        gradient.sample(F.lit(0.0), [1])
    assert gradient.clean_phase(math.nan) == 0 and gradient.clean_cycles(1e9) == 64


def test_tombstones_and_layouts(spark):
    state = spark.createDataFrame([(0, 5, 1.0)], "slot long, id long, x double")
    assert sorted((r.slot, r.live, r.id) for r in scene.project_dirty(state, spark.range(2).select(F.col("id").alias("slot"))).collect()) == [(0, True, 5), (1, False, 0)]


def test_generators(spark):
    radii = {"uniform": (1, 3.5), "clustered": (1.2, 3), "hubs": (1, 8), "chain": (2, 2), "communities": (1.5, 3.2)}
    for topology in generators.TOPOLOGIES:
        rows = generators.random_nodes(spark, topology, 600).collect()
        low, high = radii[topology]
        assert len(rows) == 600 and all(math.isfinite(r.x) and low <= r.radius <= high and len(r.color) == 4 for r in rows)
        assert generators.random_nodes(spark, topology, 0).count() == 0 and generators.topology_edges(spark, topology, 0).count() == 0
    side = math.sqrt(600)
    box = generators.random_nodes(spark, "uniform", 600).agg(*(F.max(F.abs(a)) for a in "xyz")).first()
    assert 4 * side < box[0] <= 5 * side and 4 * side < box[1] <= 5 * side and 0.8 * side < box[2] <= side
    chain = {r.id: r for r in generators.random_nodes(spark, "chain", 10).collect()}
    assert [chain[4].x, chain[4].y, chain[4].z] == pytest.approx([24 - 40, math.sin(0.3) * 50, math.cos(0.45) * 20])
    assert [tuple(r)[1:] for r in generators.topology_edges(spark, "chain", 4).orderBy("id").collect()] == [(1, 2), (2, 3), (3, 4)]
    nodes = {r.id: r for r in generators.random_nodes(spark, "hubs", 1200).collect()}
    assert [(nodes[k].radius, nodes[k].kind) for k in (1, 2)] == [(8.0, 1)] * 2 and nodes[1].x == pytest.approx(150) and nodes[2].x == pytest.approx(-150)
    spokes = generators.topology_edges(spark, "hubs", 1200).collect()
    assert len(spokes) == 1198
    for e in spokes:
        hub, spoke = nodes[e.source], nodes[e.target]
        assert hub.kind == 1 and spoke.kind == 0 and e.source == (e.target - 1) % 2 + 1 and 10 <= math.hypot(spoke.x - hub.x, spoke.y - hub.y) <= 120.001
    groups = generators.random_nodes(spark, "communities", 800).collect()
    assert {r.kind for r in groups} == {0, 1, 2, 3}
    assert all(abs(r.x - math.cos(r.kind * math.pi / 2) * 6 * math.sqrt(800)) <= 40 and abs(r.z) <= 15 for r in groups)
    edges = generators.random_edges(spark, 12, 500).collect()
    assert len({(e.source, e.target) for e in edges}) == len(edges) == 132 and all(e.source != e.target and 1 <= e.source <= 12 and 1 <= e.target <= 12 for e in edges)
    assert len(generators.random_edges(spark, 1000, 50).collect()) == 50 and not generators.random_edges(spark, 1, 5).collect()
    start = generators.random_nodes(spark, "uniform", 1000)
    old = {r.id: r for r in start.collect()}
    moved = generators.jitter(start, 0.1004, 2).collect()
    assert len({r.id for r in moved}) == 101 and all(abs(r.x - old[r.id].x) <= 1.5 and r.z == old[r.id].z and abs(r.color[0] - old[r.id].color[0]) <= 0.04 for r in moved)
    assert generators.jitter(start, 0.0, 2).count() == 1 and generators.jitter(start.where("false"), 0.5, 2).count() == 0
    nodes = generators.cohort_nodes(spark)
    assert nodes.select("rank").distinct().count() == 10_000


def test_checked_arithmetic(spark):
    last = (1 << 63) - 1
    rows = spark.createDataFrame([(10, 48, 1000), (10, 48, 100), (last, 2, last)], "capacity long, element long, most long")
    assert [r[0] for r in rows.select(slots.buffer_error(F.col("capacity"), F.col("element"), F.col("most"))).collect()] == [None, "DeviceBufferLimit", "BufferSizeOverflow"]
    revisions = spark.createDataFrame([(1,), (last,)], "revision long")
    assert [r[0] for r in revisions.select(slots.next_revision(F.col("revision"))).collect()] == [2, None]
    assert View().style_error(1, 1.5) is None
    assert [View().style_error(*s) for s in ((0, 1.0), (1, 0.0), (1, math.inf), (1, math.nan))] == ["InvalidStyle"] * 4


def test_page_catalogue(spark):
    from meshwork.operators import pages

    rows = spark.createDataFrame(
        [("positions", "hopf", 128, 64), ("edge", None, 192, 100), ("edge", "hopf", 256, 10), ("topology", None, 330, 10), ("positions", None, 384, 1 << 30)],
        "kind string, manifold string, offset long, length long",
    )
    found = {(r.rule, r.entity_id) for r in pages.page_violations(rows, 128, 1024).collect()}
    assert found == {("InvalidPageScope", 256), ("InvalidPageScope", 384), ("MisalignedPage", 330), ("OversizedPage", 384), ("PageOutOfBounds", 384), ("OverlappingPages", 256)}
    made = spark.createDataFrame([("nodes", 25_000), ("edges", 0)], "name string, slots long")
    assert {r.name: (r.capacity, r.bytes) for r in pages.allocation(made, {"nodes": 48, "edges": 32}).collect()} == {"nodes": (32_768, 32_768 * 48), "edges": (1, 32)}
    codes = spark.createDataFrame([("MissingPage",), ("OversizedPage",), ("UnsupportedPageKind",), ("CorruptPage",)], "rule string")
    assert [r[0] for r in codes.select(pages.error_class(F.col("rule"))).collect()] == ["MISSING", "OVERSIZED", "UNSUPPORTED", "CORRUPT"]
    states = spark.createDataFrame([("SAVE BLOCKED: x",), ("Saved",), ("CONFIRM delete",)], "s string")
    assert [r[0] for r in states.select(pages.actionable(F.col("s"))).collect()] == [True, False, True]
    palette = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.5, 1.5]), (2, [math.nan])], "family_slot int, channels array<double>")
    assert sorted(r.entity_id for r in pages.palette_violations(palette).collect()) == [1, 2]


def test_views_as_rows(spark):
    scenes = spark.createDataFrame([(1, 2, "c", "i"), (2, 2, "c", None)], "scene_id long, generation long, cohort_hash string, index_hash string")
    full = (-1, -1, -1, 7)
    rows = [
        (1, 5, 1, *full, 2, "c", "i", 1, 1.0), (2, 5, 1, 4, -1, -1, 7, 2, "c", "i", 1, 1.0), (3, 5, 1, *full, 1, "c", "i", 1, 1.0), (4, 5, 2, *full, 2, "c", None, 1, 1.0),
        (5, 6, 2, 4, -1, -1, 7, 2, "c", None, 1, 1.0), (6, 6, 9, *full, 2, "c", "i", 1, 1.0), (7, 5, 1, *full, 2, "c", "i", 0, 1.0), (8, 5, 1, *full, 2, "c", "i", 1, math.nan),
        (9, 5, 1, *full, 2, "c", "i", 1, math.inf), (10, 5, 1, *full, 2, "c", "i", None, 1.0),
    ]
    names = "view_id long, session long, scene_id long, families long, scopes long, relations long, reviews int, generation long, cohort_hash string, index_hash string, style_revision long, node_scale double"
    checked = views.checked_views(spark.createDataFrame(rows, names).withColumn("sequence", F.col("view_id")), scenes)
    got = {r.view_id: (r.unfiltered, r.error, r.style_error) for r in checked.collect()}
    stale, bad = "StaleGraphViewAuthority", "InvalidStyle"
    assert got == {1: (True, None, None), 2: (False, None, None), 3: (True, stale, None), 4: (True, None, None), 5: (False, "ProductIndexRequiredForFilteredView", None), 6: (True, stale, None),
                   7: (True, None, bad), 8: (True, None, bad), 9: (True, None, bad), 10: (True, None, bad)}
    assert {r.session: r.view_id for r in views.applied_views(checked).collect()} == {5: 4}
    assert [r.families for r in views.bound_views(scenes).collect()] == [-1, -1]


def test_random_edges_are_drawn_without_a_sort_of_all(spark):
    nodes, seed = 12, 42
    pairs, prime = 132, 137  # the least prime from 132 on
    factor, shift = seed * 2_654_435_761 % (prime - 1) + 1, seed * 40_503 % prime
    draws = [(i, (i * factor + shift) % prime) for i in range(prime)]
    for wanted in (1, 50, 131, 132):
        found = generators.random_edges(spark, nodes, wanted)
        expected = [i for i, draw in draws if draw < pairs][:wanted]
        assert sorted(r.id for r in found.collect()) == expected
        assert "Sort" not in (plan := found._jdf.queryExecution().toString()) and "Limit" not in plan and "TakeOrdered" not in plan


def test_jitter_sorts_only_the_range_of_its_last_row(spark):
    nodes = generators.random_nodes(spark, "uniform", 5_000).persist()
    pick = nodes.select("id", F.xxhash64("id", F.lit(44), F.lit("pick")).alias("pick"))
    expected = {r.id for r in pick.orderBy("pick", "id").limit(700).collect()}
    moved = generators.jitter(nodes, 0.13995, 2)
    assert {r.id for r in moved.collect()} == expected
    assert "Union" in moved._jdf.queryExecution().toString()  # all rows of lower ranges, and the last one's
    nodes.unpersist()


def test_diff_rules_deal_ids_by_their_number(spark, monkeypatch):
    from meshwork.operators import dealing

    nodes = spark.range(1, 1_001)
    edges = spark.range(1, 2_001).selectExpr("id", "1 + id % 1000 as source", "1 + id * 7 % 1000 as target")
    lane = lambda df, op: df.selectExpr("*", "id as ord", f"'{op}' as op", "2L as revision")
    changes = lane(nodes.where("id % 10 = 1"), "remove"), lane(edges.where("id % 4 = 0"), "update")
    found = lambda: sorted(map(tuple, diff.diff_violations(nodes, edges, *changes, current=1).select("rule", "entity_id", "detail").collect()), key=repr)
    whole = found()
    monkeypatch.setattr(dealing, "TASK_ROWS", 100)
    assert found() == whole and len(whole) > 100
    plan = diff.diff_violations(nodes, edges, *changes, current=1)._jdf.queryExecution().executedPlan().toString()
    assert "id#" in plan and "REPARTITION_BY_NUM" in plan
