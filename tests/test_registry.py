import random

import pytest
from pyspark.sql import functions as F

from meshwork.functions import text
from meshwork.operators import anchors, logs, registry, tree, validate
from meshwork.sources import documents
from meshwork.types import ENTITY_SCHEMA, NODE_SCHEMA

CONTENT = "Ryan met 新羅 in New Rome."


def first(frame):
    row = validate.first_violation(frame).first()
    return row.rule if row else None


def spans(spark, rows, content=CONTENT):
    return spark.createDataFrame([(1, s, e, n, t, content) for s, e, n, t in rows], "document long, start long, end long, node_id long, surface string, content string")


def test_anchors(spark):
    assert first(anchors.anchor_violations(spans(spark, [(19, 27, 2, "New Rome"), (9, 15, 1, "新羅")]))) is None
    assert first(anchors.anchor_violations(spans(spark, [(0, 8, 1, "New Rome"), (4, 8, 2, "Rome")], "New Rome"))) == "OverlappingAnchors"
    assert first(anchors.anchor_violations(spans(spark, [(0, 8, 1, "Old Rome")], "New Rome"))) == "SurfaceMismatch"
    assert first(anchors.anchor_violations(spans(spark, [(10, 15, 1, "x")]))) == "InvalidAnchorRange"


def entity(i, label, kind="character", ner=False, user=True, n=0):
    return (i, label, kind, None, None, (ner, user), n)


def batch(spark, rows):
    return spark.createDataFrame([(i, label, kind, None, n) for i, label, kind, n in rows], "stable_id long, label string, kind string, custom_kind string, mention_count long")


def test_named_entity_batches(spark):
    entities = spark.createDataFrame([entity(11, "Ryan"), entity(5, "Gone", ner=True, user=False, n=3)], ENTITY_SCHEMA)
    good = batch(spark, [(22, "New Rome", "location", 4), (11, "Ryan", "character", 7)])
    assert first(registry.ner_violations(entities, good)) is None
    merged = {r.id: r for r in registry.ner_merge(entities, good).collect()}
    assert sorted(merged) == [11, 22] and merged[11].sources.ner and merged[11].sources.user_tagged and merged[11].ner_mention_count == 7
    assert first(registry.ner_violations(entities, batch(spark, [(1, "a", "npc", 1), (1, "a", "npc", 1)]))) == "DuplicateNerIdentity"
    assert first(registry.ner_violations(entities, batch(spark, [(11, "Bryan", "character", 1)]))) == "EntityIdentityConflict"
    assert first(registry.ner_violations(entities, batch(spark, [(7, " pad", "npc", 1)]))) == "InvalidNerEntity"
    assert first(registry.ner_violations(entities, batch(spark, [(7, "x", "custom", 1)]))) == "InvalidEntityKind"
    cleared = {r.id: r for r in registry.ner_merge(registry.ner_merge(entities, good), batch(spark, [])).collect()}
    assert sorted(cleared) == [11] and not cleared[11].sources.ner


def test_equal_labels_stay_apart_and_atlas_counts(spark):
    entities = spark.createDataFrame([entity(1, "Ryan", n=5), entity(2, "Ryan")], ENTITY_SCHEMA)
    mentions = spark.createDataFrame([(1, True), (1, False), (2, True)], "entity_id long, active boolean")
    assert {r.id: r.mention_count for r in registry.atlas(entities, mentions).collect()} == {1: 6, 2: 1}


def test_search(spark):
    entities = spark.createDataFrame([entity(1, "New Rome", "location")], ENTITY_SCHEMA)
    assert [registry.search(entities, q).count() for q in ("rome", "LOCATION", "Ryan", "  ")] == [1, 1, 0, 1]


def relocated(spark, content, start=13, end=21, surface="New Rome", prefix="", suffix=""):
    row = spark.createDataFrame([(start, end, surface, prefix, suffix, content, True)], "start long, end long, surface string, prefix string, suffix string, content string, active boolean")
    found = registry.relocate(row).first()
    return (found.start, found.end) if found.active else None


def test_relocation(spark):
    assert relocated(spark, "Ryan entered New Rome.") == (13, 21)
    assert relocated(spark, "Yesterday, Ryan entered New Rome.") == (24, 32)
    assert relocated(spark, "New Rome and New Rome") == (13, 21)  # the exact place wins
    assert relocated(spark, "New Rome, and New Rome") is None
    assert relocated(spark, "é New Rome, and New Rome", prefix="and ") == (17, 25)
    assert relocated(spark, "nothing") is None
    assert relocated(spark, r"a\E.b", 50, 53, r"\E.") == (1, 4)


def test_byte_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.byte_slice(F.lit(CONTENT), F.lit(9), F.lit(15))) == "新羅"
    assert [one(text.is_boundary(F.lit("aé"), F.lit(k))) for k in range(5)] == [True, True, False, True, False]
    assert one(text.trim_white(F.lit(" \tx 　"))) == "x"
    assert one(text.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2
    assert one(text.contains_ascii_ci(F.lit("ÉCOLE"), F.lit("école"))) is False
    assert [one(text.name_error(F.lit(n))) for n in ("ok", " ", "a/b", "é" * 49)] == [None, "EmptyName", "InvalidName", "InvalidName"]
    assert one(text.quote_prefix(F.lit("é" * 40 + "x"), F.lit(80))) == "é" * 32


def test_trees(spark):
    seed = documents.seed_entries(spark)
    assert [r.id for r in tree.visible_rows(seed, F.col("id").isin(1, 2)).orderBy("place").collect()] == [1, 2, 3, 4]
    rows = tree.create(seed, 1, "folder", " Drafts ", 6)
    rows = tree.rename(tree.create(rows, 6, "note", "Chapter 01", 7), 7, "Chapter 1")
    assert {r.id: r.path for r in tree.paths(rows).collect()}[7] == "Workspace / Drafts / Chapter 1"
    kept = tree.delete(rows, rows.where("id = 6").select("id"))
    assert kept.count() == 5 and first(tree.tree_violations(kept)) is None
    for bad, error in ((lambda: tree.create(seed, 1, "folder", "notes", 6), "DuplicateName"), (lambda: tree.create(seed, 3, "note", "x", 6), "ParentIsNotAFolder"),
                       (lambda: tree.rename(seed, 1, "x"), "RootIsImmutable"), (lambda: tree.delete(seed, seed.where("id = 1").select("id")), "RootIsImmutable")):
        with pytest.raises(ValueError, match=error):
            bad()
    loop = seed.withColumn("parent", F.when(F.col("id") == 4, 4).otherwise(F.col("parent")))
    assert sorted(r.id for r in tree.unrooted(loop).collect()) == [4, 5] and first(tree.tree_violations(loop)) == "InvalidManifest"
    assert tree.name_taken(seed, 1, "NOTES") and not tree.name_taken(seed, 1, "Notes", besides=2)
    accents = spark.createDataFrame([(1, 0, "folder", "r"), (2, 1, "note", "É"), (3, 1, "note", "é")], seed.schema)
    assert not tree.name_taken(accents.where("id < 3"), 1, "é") and first(tree.tree_violations(accents)) == "DuplicateName"


def test_trees_deeper_than_any_limit(spark):
    n = 150
    chain = spark.createDataFrame([(k, k - 1, "folder" if k < n else "note", f"n{k}") for k in range(1, n + 1)], "id long, parent long, kind string, name string").repartition(1)
    walked = {r.id: (r.depth, r.path) for r in tree.walk(chain, tree.root(chain)).collect()}
    assert walked == {k: (k - 1, [f"n{j}" for j in range(1, k + 1)]) for k in range(1, n + 1)}


def test_rounds_grow_with_the_logarithm_of_depth(spark, monkeypatch):
    rounds = []
    new_path = tree.new_path
    monkeypatch.setattr(tree, "new_path", lambda *a: rounds.append(a) or new_path(*a))
    rng = random.Random(4)
    names = rng.sample(range(10**9), 5000)
    up = {a: b for a, b in zip(names[1:], names)} | {names[0]: 1, 1: 0}
    # a branch that leads nowhere, a cycle with a tail, and a long cycle
    up |= {-k: -k - 1 for k in range(1, 300)} | {-1000: -1001, -1001: -1000, -1002: -1000} | {-2000 - k: -2000 - (k + 1) % 777 for k in range(777)}
    chain = spark.createDataFrame(list(up.items()), "id long, parent long")
    found = {r.id: (r.top, r.steps) for r in tree.climb(chain, chain.where("id = 1")).collect()}
    assert found == {1: (1, 0)} | {name: (1, k + 1) for k, name in enumerate(names)}
    assert len(rounds) <= 15
    assert {r.id for r in tree.unrooted(chain).collect()} == {k for k in up if k < 0}
    rounds.clear()
    tops = chain.where(F.col("id").isin(names[10], names[2000], -2005))
    assert {r.id: r.top for r in tree.climb(chain, tops).collect() if r.id > 0} == {name: names[10] if k < 2000 else names[2000] for k, name in enumerate(names) if k >= 10}
    assert tree.closure(chain, chain.where("id = -2005")).count() == 777 and tree.closure(chain.where("false"), chain).count() == 0


def test_stored_documents_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "DOCUMENT_ROWS", 2)
    path = str(tmp_path / "tree")
    documents.write_json(documents.seed_entries(spark), "entries", path, revision=1)
    assert len(list((tmp_path / "tree").glob("part-*.json"))) == 3
    assert sorted(map(tuple, documents.read_entries(spark, path).collect())) == sorted(map(tuple, documents.seed_entries(spark).collect()))
    nodes = spark.createDataFrame([(9 - k, [float(k)] * 3, 1.0, [0.0] * 4, 1, 0) for k in range(5)], NODE_SCHEMA)
    documents.write_json(nodes, "nodes", f"{tmp_path}/snapshot/nodes", revision=3)
    documents.write_json(nodes.where("false"), "edges", f"{tmp_path}/snapshot/edges", revision=3)
    points, links = documents.read_snapshot(spark, f"{tmp_path}/snapshot/*")
    assert sorted((r.ord, r.id, r.x, r.revision) for r in points.collect()) == [(k, k + 5, 4.0 - k, 3) for k in range(5)] and links.count() == 0


def test_lookups_of_many_requests(spark):
    seed = documents.seed_entries(spark)
    requests = spark.createDataFrame([(1, 1), (2, 3), (3, 99), (4, 2)], "request long, id long")
    got = {r.request: (r.error, r.note_error, r.home) for r in tree.find_entries(seed, requests).collect()}
    assert got == {1: (None, "NotNote", 1), 2: (None, None, 2), 3: ("MissingEntry", "MissingEntry", None), 4: (None, "NotNote", 2)}
    wanted = spark.createDataFrame([(1, 1, "NOTES", 0), (2, 1, "Notes", 2), (3, 2, "Notes", None), (4, 1, "research", None)], "request long, parent long, name string, besides long")
    assert sorted(r.request for r in tree.names_taken(seed, wanted).collect()) == [1, 4]
    assert {r.parent: r.id for r in tree.first_notes(seed).collect()} == {2: 3, 4: 5}


def test_tags_fold_as_one_after_the_other(spark):
    rng = random.Random(7)
    tags = [(rng.randrange(3), k, *sorted(rng.sample(range(25), 2)), f"s{k}", rng.choice(["npc", "event"])) for k in range(120)]
    tags += [(0, 200 + k, 3, 9, f"t{k}", "npc") for k in range(5)]
    mentions, made, entities = {}, {}, {}
    for document, k, start, end, surface, kind in tags:
        same = [e for (d, _), (s, e_, e, on) in mentions.items() if on is None and (d, s, e_) == (document, start, end)]
        entity = same[0] if same else (document, k)
        made[document, k] = not same
        for key, (s, e_, e, on) in mentions.items():
            if key[0] == document and on is None and start < e_ and s < end:
                mentions[key] = (s, e_, e, k)
        mentions[document, k] = (start, end, entity, None)
        entities[entity] = (surface, kind)
    df = spark.createDataFrame(tags, "document long, sequence long, start long, end long, surface string, kind string")
    folded = registry.fold_tags(df.repartition(3))
    got = {(r.document, r.sequence): r for r in folded.collect()}
    assert {k: ((r.document, r.first), r.evicted_by, r.is_new) for k, r in got.items()} == {k: (e, on, made[k]) for k, (_, _, e, on) in mentions.items()}
    assert all(r.active == (r.evicted_by is None) for r in got.values())
    named = {r.entity_id: (r.surface, r.kind) for r in registry.tagged_entities(folded).collect()}
    assert named == {got[e].entity_id: v for e, v in entities.items()}


def counted(df):
    """``df``, and how many of its rows were made so far."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), made


def test_tags_and_texts_are_read_a_few_times(spark, monkeypatch):
    from meshwork.sources import tables

    rows = [(k % 3, k, k % 17, k % 17 + k % 5 + 1) for k in range(90)]
    tags, made = counted(spark.createDataFrame(rows, "document long, sequence long, start long, end long"))
    assert registry.fold_tags(tags).count() == 90 and made.value == 90
    rng = random.Random(12)
    words = ["a", "b", "ab", "新", "é", "c."]
    texts = [(k, rng.choice(["", "x"]) + rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randrange(30)))) for k in range(200)] + [(900, None), (901, "")]
    surfaces = [(k, " ".join(rng.choice(words) for _ in range(1 + k % 7))) for k in range(40)]
    wanted = sorted((d, s) for d, text in texts if text for s, surface in surfaces if surface in text)
    # texts that no surface may meet are not shuffled unless candidates are very many; the spans are the same
    for most in (tables.BROADCAST_PAIRS, 3):
        monkeypatch.setattr(tables, "BROADCAST_PAIRS", most)
        docs, made = counted(spark.createDataFrame(texts, "doc_id long, content string"))
        kinds = 6  # one reading for each kind of key, one to place the surfaces
        found = tables.spans_of(docs, spark.createDataFrame(surfaces, "item_id long, surface string"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("LeftSemi" in plan) == (most > 3)
        got = sorted({(r.document - 1, r.node_id - 1) for r in found.collect()})
        assert got == wanted and len(wanted) > 100 and made.value <= len(texts) * (kinds + 1)


def test_leases(spark):
    docs = spark.createDataFrame([], "entry_id long, revision long, content_hash string, content string")
    token = documents.lease(docs, 3).first()
    assert token.revision == 0 and token.content == ""
    saved = documents.commit(docs, 3, 0, token.content_hash, "first")
    assert documents.lease(saved, 3).first().revision == 1
    with pytest.raises(ValueError, match="StaleDocumentLease"):
        documents.commit(saved, 3, 0, token.content_hash, "second")
    held = documents.lease(saved, 3).first()
    assert documents.commit(saved, 3, 1, held.content_hash, "first") is saved
    assert documents.commit(docs, 3, 0, token.content_hash, "") is docs  # an empty first save is no revision


def test_selecting_entries(spark):
    seed = documents.seed_entries(spark)
    assert tree.entry(seed, 4).name == "Research" and tree.require_note(seed, 3).name == "Welcome"
    for bad, error in ((lambda: tree.entry(seed, 9), "MissingEntry"), (lambda: tree.require_note(seed, 4), "NotNote"), (lambda: tree.parent_for_create(seed, 9), "MissingEntry"),
                       (lambda: tree.rename(seed, 9, "x"), "MissingEntry"), (lambda: tree.delete(seed, spark.createDataFrame([(3,), (77,)], "id long")), "MissingEntry")):
        with pytest.raises(ValueError, match=error):
            bad()
    assert {r.id: r.document for r in tree.active_document(seed).collect()} == {1: None, 2: None, 3: 3, 4: None, 5: 5}


def test_spans_are_found_wherever_they_stand(spark):
    from meshwork.sources.tables import spans_of

    docs = {1: 'He said "New Rome, old Rome and new streets of Rome" twice: New Rome, old Rome and new streets of Romeo.', 2: "aa aaa é", 3: "", 4: None, 5: "x New Rome\n"}
    surfaces = {1: "New Rome, old Rome and new streets of Rome", 2: "aa", 3: "New Rome", 4: "e", 5: " New Rome", 6: "é", 7: "not there at all in any", 8: ""}
    found = spans_of(spark.createDataFrame(list(docs.items()), "doc_id long, content string"), spark.createDataFrame(list(surfaces.items()), "item_id long, surface string"))
    expected = set()
    for d, text in docs.items():
        for i, surface in surfaces.items():
            parts = text.split(surface) if text and surface else [""]
            at = 0
            for part in parts[:-1]:
                at += len(part.encode())
                expected.add((d + 1, i + 1, at, at + len(surface.encode())))
                at += len(surface.encode())
    assert {(r.document, r.node_id, r.start, r.end) for r in found.collect()} == expected and len(expected) > 10


def test_json_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"revision": 9, "entities": [{"id": 42, "label": "Old", "kind": "npc"}], "mentions": []}')
    old, none = documents.read_registry(spark, str(tmp_path / "r.json"))
    assert old.first().sources.user_tagged and not old.first().sources.ner and old.first().ner_mention_count == 0 and none.count() == 0
    (tmp_path / "s.json").write_text('{"revision": 1, "nodes": [{"id": 1, "position": [1, 0, 0], "radius": 1, "color": [0, 0, 0, 1], "kind": 0, "flags": 0}], "edges": [{"id": 10, "source": 1, "target": 9, "width": 1, "color": [0, 0, 0, 1], "kind": 0, "flags": 0}]}')
    assert first(validate.snapshot_violations(*documents.read_snapshot(spark, str(tmp_path / "s.json")))) == "MissingTargetNode"


def test_logs(spark):
    log = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "a", 2)], "sequence long, kind string, user long")
    assert {r.user: r.sequence for r in logs.latest(log, "user").collect()} == {1: 2, 2: 3}
    drag = spark.createDataFrame([(1, 1, 1, 10.0, 10.0), (1, 1, 2, 13.0, 10.0), (1, 1, 3, 14.0, 10.0), (1, 1, 4, 10.0, 10.0)], "user long, press long, sequence long, x double, y double")
    assert [r.dragging for r in logs.dragged(drag, "user", "press").orderBy("sequence").collect()] == [False, False, True, True]
    breaks = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 2)], "lane long, arrival long, sequence long")
    assert logs.order_breaks(breaks, "lane").count() == 1


def test_commands(spark):
    from meshwork.operators import workflow
    from meshwork.types import MENTION_SCHEMA

    docs = spark.createDataFrame([], "entry_id long, revision long, content_hash string, content string")
    w = workflow.Workspace(docs, spark.createDataFrame([], ENTITY_SCHEMA), spark.createDataFrame([], MENTION_SCHEMA))
    token = documents.lease(docs, 3).first()
    w = workflow.save_document(w, 3, 0, token.content_hash, "Ryan entered New Rome.")
    w, ryan = workflow.tag(w, 3, 0, 4, "character")
    w, again = workflow.tag(w, 3, 0, 4, "npc")
    assert again == ryan and w.entities.first().kind == "npc" and w.mentions.count() == 1
    w, wide = workflow.tag(w, 3, 0, 12, "concept")  # overlaps and evicts the first mention
    assert wide != ryan and [r.entity_id for r in w.mentions.collect()] == [wide]
    w, rome = workflow.tag(w, 3, 13, 21, "location")
    held = documents.lease(w.documents, 3).first()
    w = workflow.save_document(w, 3, held.revision, held.content_hash, "Yesterday, Ryan entered New Rome.")
    assert {(r.entity_id, r.start, r.active, r.document_revision) for r in w.mentions.collect()} == {(wide, 11, True, 2), (rome, 24, True, 2)}
    w = workflow.publish_entities(w, 3, batch(spark, [(9001, "New Rome", "location", 3)]))
    assert w.entities.count() == 4 and w.ner_revision == 3
    with pytest.raises(ValueError, match="StaleNerRevision"):
        workflow.publish_entities(w, 3, batch(spark, []))
    with pytest.raises(ValueError, match="InvalidEntityTag"):
        workflow.tag(w, 3, 10, 15, "npc")


def test_small_lookups(spark):
    from meshwork.operators import index, paths

    mentions = spark.createDataFrame([(1, 7, 2, "h", True), (2, 7, 1, "h", True), (3, 7, 2, "h", False)], "entity_id long, document long, document_revision long, content_hash string, active boolean")
    lease = spark.createDataFrame([(7, 2, "h", "text")], "document long, document_revision long, content_hash string, content string")
    assert [r.entity_id for r in anchors.for_lease(mentions, lease).collect()] == [1]
    seed = documents.seed_entries(spark)
    assert tree.first_note(seed).first().id == 3
    assert [tree.parent_for_create(seed, k).first().id for k in (2, 3)] == [2, 2]
    mapped = spark.createDataFrame([(9001, 11), (9002, 22)], "entity_id long, node_id long")
    wanted = spark.createDataFrame([(9002,)], "entity_id long")
    assert [tuple(r) for r in index.entity_nodes(mapped, wanted).collect()] == [(9002, 22)]
    products = spark.createDataFrame([(1, 0), (2, 5), (3, None), (4, -1)], "id long, ref long")
    assert sorted(r.id for r in index.bad_references(products, "ref", 5).collect()) == [2, 4]
    ranges = spark.createDataFrame([(0, 0, 5), (1, 8, 5)], "stroke long, first_point long, point_count long")
    assert [r.stroke for r in paths.range_violations(ranges, 10).collect()] == [1]


def test_trees_without_a_limit_grow_beyond_that_of_a_workspace(spark):
    rows = spark.range(1, 20_001).selectExpr("id", "case when id = 1 then 0 else 1 end as parent", "if(id = 1, 'folder', 'note') as kind", "concat('n', id) as name")
    with pytest.raises(ValueError, match="EntryLimit"):
        tree.create(rows, 1, "folder", "Drafts", 30_000)
    assert tree.create(rows, 1, "folder", "Drafts", 30_000, limit=None).count() == 20_001


def test_climbing_deals_rows_by_their_number(spark, monkeypatch):
    from meshwork.operators import dealing

    monkeypatch.setattr(dealing, "TASK_ROWS", 100)
    monkeypatch.setattr(dealing, "HOT_ROWS", 50)
    # 3,000 entries below four folders of one root, chains of three
    links = spark.range(1, 3_001).selectExpr("id", "case when id = 1 then 0 when id < 6 then 1 when id < 1000 then 2 + id % 4 when id < 2000 then id - 900 else id - 1000 end as parent")
    found = tree.closure(links, spark.range(2, 4))
    parent = {r.id: r.parent for r in links.collect()}

    def below(i):
        while i not in (2, 3, 0):
            i = parent[i]
        return i > 0

    assert sorted(r.id for r in found.collect()) == sorted(i for i in parent if below(i))
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_sized_joins_equal_plain_ones(spark, monkeypatch):
    from meshwork.operators import dealing

    monkeypatch.setattr(dealing, "HOT_ROWS", 50)
    many = spark.range(400).selectExpr("id", "case when id % 2 = 0 then 7 when id % 5 = 0 then null else id end as k")
    one = spark.range(0, 300, 7).selectExpr("id as other", "id * 2 as value")
    for how in ("inner", "left"):
        plain = sorted(map(tuple, many.join(one, F.col("k") == F.col("other"), how).collect()), key=repr)
        assert sorted(map(tuple, dealing.sized_join(many, one, "k", "other", 4, how).collect()), key=repr) == plain


def test_eviction_totals_meet_equal_spans_once(spark, monkeypatch):
    rng = random.Random(4)
    held = [(rng.randrange(2), a := rng.randrange(20), a + rng.randrange(6), rng.random() < 0.8) for _ in range(300)]
    tags = [(rng.randrange(2), k, a := rng.randrange(20), a + rng.randrange(6)) for k in range(300)]
    expected = {}
    for document, a, b, active in held:
        for other, k, c, d in tags:
            if active and document == other and a < d and c < b and a < b and c < d:
                n, first_tag, shared = expected.get((document, a, b), (0, k, 0))
                expected[document, a, b] = n + 1, min(first_tag, k), shared + min(b, d) - max(a, c)
    met = []
    plain = registry.tag_evictions
    monkeypatch.setattr(registry, "tag_evictions", lambda m, t: met.append((m.count(), t.count())) or plain(m, t))
    found = registry.eviction_totals(
        spark.createDataFrame(held, "document long, start long, end long, active boolean"), spark.createDataFrame(tags, "document long, sequence long, tag_start long, tag_end long")
    )
    assert {tuple(r[:3]): tuple(r[3:]) for r in found.collect()} == expected
    assert met == [(len({h[:3] for h in held if h[3]}), len({(t[0], *t[2:]) for t in tags}))]
