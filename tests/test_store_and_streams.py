import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from meshwork.sources import store
from meshwork.streaming.appliers import StateApplier, pointer_events, pointer_steps, run_log


def tables(spark, ids, edges=(), swap=False):
    identity = spark.createDataFrame(list(enumerate(ids)), "slot long, id long")
    product = spark.createDataFrame(list(enumerate(reversed(ids) if swap else ids)), "slot long, node_id long")
    found = {"node_identity": identity, "node_product": product, "positions": identity.select("slot", F.lit("hybrid").alias("manifold"), F.lit(0.0).alias("x"))}
    if edges:
        found["edge"] = spark.createDataFrame(list(enumerate(edges)), "slot long, id long")
    return found


def test_publication_order(spark, tmp_path):
    s = store.GenerationStore(spark, f"file://{tmp_path}/scenes")
    assert s.current_receipt() is None and s.open_current() is None and s.next_generation() == 1
    s.publish(1, store.REGISTRY_ONLY, 1, tables(spark, [41]))
    s.publish(2, store.FULL, 1, tables(spark, [41, 82], [99]))
    assert s.next_generation() == 3 and s.open_current()["node_identity"].count() == 2
    with pytest.raises(store.PublicationError, match="FullGenerationProtected"):
        s.publish(1, store.REGISTRY_ONLY, 2, tables(spark, [41]))  # protection comes before staleness
    with pytest.raises(store.PublicationError, match="StaleGeneration"):
        s.publish(2, store.FULL, 2, tables(spark, [41], [99]))
    with pytest.raises(ValueError, match="IdentityMismatch"):
        s.publish(3, store.FULL, 2, tables(spark, [11, 22], [99], swap=True))
    with pytest.raises(ValueError, match="RegistryWithEdges"):
        s.publish(3, store.REGISTRY_ONLY, 2, tables(spark, [11], [99]))
    with pytest.raises(ValueError, match="ZeroIdentity"):
        s.publish(3, store.FULL, 2, tables(spark, [0], [99]))
    manifest = tmp_path / "scenes" / "manifest.json"
    manifest.write_text(manifest.read_text().replace("registry_revision", "registry_revisiom"))
    for crc in manifest.parent.glob(".manifest*.crc"):
        crc.unlink()
    with pytest.raises(store.PublicationError, match="Corrupt"):
        s.open_current()


def test_stream_equals_batch_and_replays_are_exact(spark, tmp_path):
    schema = "id long, revision long, op string, value double"
    rows = [(1, 1, "add", 1.0), (2, 2, "add", 2.0), (1, 3, "update", 9.0), (2, 4, "remove", None), (2, 3, "update", 5.0)]
    log = str(tmp_path / "log")
    for k in range(0, len(rows), 2):
        spark.createDataFrame(rows[k : k + 2], schema).coalesce(1).write.mode("append").parquet(log)
    applier = StateApplier(spark, str(tmp_path / "state"), schema)
    run_log(spark, log, schema, applier, str(tmp_path / "progress"))
    assert [tuple(r) for r in applier.live().collect()] == [(1, 3, 9.0)]
    applier.apply(spark.createDataFrame([(1, 2, "remove", None)], schema), 100)  # late: rejected
    assert [tuple(r) for r in applier.live().collect()] == [(1, 3, 9.0)]


def test_a_new_applier_goes_on_where_the_last_one_ended(spark, tmp_path):
    schema = "id long, revision long, op string, value double"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    new = lambda: StateApplier(spark, str(tmp_path / "state"), schema, buckets=4)
    new().apply(rows(*((i, 1, "add", float(i)) for i in range(20))), 0)
    new().apply(rows((3, 2, "update", 33.0), (4, 2, "remove", None)), 1)
    new().apply(rows((3, 3, "update", 333.0)), 2)
    expected = {i: float(i) for i in range(20) if i != 4} | {3: 333.0}
    assert {r.id: r.value for r in new().live().collect()} == expected
    new().apply(rows((3, 3, "update", 333.0)), 2)  # replayed
    new().apply(rows(), 3)
    assert {r.id: r.value for r in new().live().collect()} == expected and new().state().count() == 20


def test_a_stream_split_over_two_appliers(spark, tmp_path):
    schema = "id long, revision long, op string, value double"
    log = str(tmp_path / "log")
    for part in range(2):
        spark.createDataFrame([(i, 1 + part, "add" if not part else "update", float(i + part)) for i in range(part * 5, 10)], schema).coalesce(1).write.mode("append").parquet(log)
        run_log(spark, log, schema, StateApplier(spark, str(tmp_path / "state"), schema), str(tmp_path / "progress"))
    live = StateApplier(spark, str(tmp_path / "state"), schema).live().collect()
    assert {r.id: (r.revision, r.value) for r in live} == {i: (1, float(i)) if i < 5 else (2, i + 1.0) for i in range(10)}


def test_pointer_machine(spark, tmp_path):
    inputs = pd.DataFrame(
        [(1, 1, "move", 0.0, 0.0), (1, 2, "press", 10.0, 10.0), (1, 3, "move", 13.0, 10.0), (1, 4, "release", 13.0, 10.0),
         (1, 5, "press", 10.0, 10.0), (1, 6, "move", 14.0, 10.0), (1, 7, "release", 14.0, 10.0), (1, 8, "wheel", 0.0, 1.0)],
        columns=["session", "sequence", "input", "x", "y"],
    )
    schema = "session long, sequence long, input string, x double, y double"
    spark.createDataFrame(inputs, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = pointer_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("pointer").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.sequence, r.event) for r in spark.table("pointer").orderBy("sequence").collect()] == [(1, "hover"), (4, "select"), (6, "drag"), (7, "drag_end"), (8, "zoom")]


def plain_pointer(rows):
    down = dragging = False
    px = py = 0.0
    out = []
    for sequence, kind, x, y in sorted(rows):
        event = None
        if kind == "press":
            down, dragging, px, py = True, False, x, y
        elif kind == "release":
            event = "select" if down and not dragging else "drag_end" if down else None
            down = dragging = False
        elif kind == "move":
            dragging = dragging or down and (x - px) ** 2 + (y - py) ** 2 >= 16
            event = "drag" if dragging else None if down else "hover"
        elif kind == "wheel":
            event = "zoom"
        if event:
            out.append((sequence, event))
    return out


def test_pointer_steps_continue_across_batches():
    rng = random.Random(2)
    rows = [(k, rng.choice(["press", "release", "move", "move", "move", "wheel", "other"]), float(rng.randrange(6)), float(rng.randrange(6))) for k in range(2000)]
    pointer, got, at = (False, False, 0.0, 0.0), [], 0
    while at < len(rows):
        part = rows[at : at + rng.randrange(30)]
        event, pointer = pointer_steps(pointer, *(np.array([r[c] for r in part], dtype=kind) for c, kind in ((1, object), (2, float), (3, float))))
        got += [(r[0], e) for r, e in zip(part, event) if e]
        at += len(part)
    assert got == plain_pointer(rows)


@pytest.mark.parametrize("order", ["sorted", "reversed", "shuffled"])
def test_pointer_restores_the_order_of_long_sessions(spark, tmp_path, order):
    rng = random.Random(3)
    rows = [(k + 1, rng.choice(["press", "release", "move", "move", "wheel"]), float(rng.randrange(9)), float(rng.randrange(9))) for k in range(30_000)]
    given = sorted(rows, reverse=order == "reversed")
    if order == "shuffled":
        rng.shuffle(given)
    schema = "session long, sequence long, input string, x double, y double"
    folder = tmp_path / "in"
    folder.mkdir()
    for part in range(3):  # several micro-batches, with some inputs delivered twice
        some = given[part * 10_000 : part * 10_000 + 10_050]
        table = pa.table({"session": [7] * len(some), **{n: [r[c] for r in some] for c, n in enumerate(("sequence", "input", "x", "y"))}})
        pq.write_table(table, folder / f"part-{part}.parquet")
    stream = pointer_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)))
    query = stream.writeStream.format("memory").queryName(f"pointer_{order}").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = [(r.sequence, r.event) for r in spark.table(f"pointer_{order}").collect()]
    assert got == plain_pointer(rows)
