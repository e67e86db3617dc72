"""Streaming appliers: progress is ordered by revision, not by event time.

Each micro-batch folds the batch's changes per id and merges them into the
state, whose touched buckets are written as a new version; what is not newer than the state's
revision of its id is late and is rejected, never merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class StateApplier:
    """Keeps rows (id, revision, op, ...) under a folder, dealt into buckets by id.

    A micro-batch rewrites only the buckets that its ids fall into, as a new
    version, and then notes those in the folder's table of commits. A batch reads
    what was committed before it, so one that is replayed after a failure, also
    by a new applier on the same folder, writes the same version again: the
    result is exactly once. Older versions stay until they are cleaned up.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, buckets: int = 32):
        self.spark, self.folder, self.schema, self.buckets = spark, folder.rstrip("/"), schema, buckets

    def _versions(self, below: int | None = None) -> dict[int, int]:
        """The newest committed version of each bucket; at most as many rows as there are buckets."""
        try:
            commits = self.spark.read.schema("version bigint, bucket int").parquet(f"{self.folder}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        if below is not None:
            commits = commits.where(F.col("version") < below)
        return {r.bucket: r.version for r in commits.groupBy("bucket").agg(F.max("version").alias("version")).collect()}

    def _path(self, version: int) -> str:
        return f"{self.folder}/version-{version:012d}"

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self._path(v)}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def state(self) -> DataFrame:
        """All rows with the newest change of each id, removals kept as tombstones."""
        return self._rows(self._versions())

    def live(self) -> DataFrame:
        return self.state().where("op <> 'remove'").drop("op")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        columns = [c for c in self._rows({}).columns if c != "id"]
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        batch = batch.select("id", *columns)
        touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]
        if not touched:
            return
        before = self._versions(below=batch_id)
        both = self._rows({b: before[b] for b in touched if b in before}).unionByName(batch)
        newest = both.groupBy("id").agg(F.max_by(F.struct(*columns), "revision").alias("c")).select("id", "c.*")
        newest.withColumn("bucket", bucket).write.partitionBy("bucket").mode("overwrite").parquet(self._path(batch_id))
        commits = self.spark.createDataFrame([(batch_id, b) for b in touched], "version bigint, bucket int").coalesce(1)
        commits.write.mode("append").parquet(f"{self.folder}/commits")


def run_log(spark: SparkSession, log: str, schema: str, applier: StateApplier, checkpoint: str, files: int = 1) -> None:
    """Feeds the change files under ``log`` to the applier, a few files a batch, until all are read."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(log)
    query = stream.writeStream.foreachBatch(applier.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


POINTER_OUTPUT = "session bigint, sequence bigint, event string, x double, y double"
_PENDING = {"number": "bigint", "sequence": "bigint", "input": "string", "x": "double", "y": "double"}
POINTER_STATE = "down boolean, dragging boolean, px double, py double, next bigint, " + ", ".join(f"{c} array<{kind}>" for c, kind in _PENDING.items())
DRAG_SQUARED = 16.0
Pointer = tuple[bool, bool, float, float]


def pointer_steps(pointer: Pointer, inputs: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, Pointer]:
    """The event of each input in order (None where there is none), and the pointer after them: down, dragging and the place of its press."""
    down, dragging, px, py = pointer
    at = np.arange(len(inputs))
    edge = (inputs == "press") | (inputs == "release")
    # the last press or release before each input, -1 for what the pointer brought along
    since = np.concatenate(([-1], np.maximum.accumulate(np.where(edge, at, -1))))
    last, brought = since[:-1], since[:-1] < 0
    held = np.where(brought, down, inputs[last] == "press")
    ox, oy = np.where(brought, px, x[last]), np.where(brought, py, y[last])
    far = (inputs == "move") & held & ((x - ox) ** 2 + (y - oy) ** 2 >= DRAG_SQUARED)
    moved = np.concatenate(([0], np.cumsum(far)))
    drags = held & ((moved[1:] > moved[last + 1]) | (brought & dragging))
    event = np.full(len(inputs), None, dtype=object)
    event[(inputs == "release") & held] = "select"
    event[(inputs == "release") & drags] = "drag_end"
    event[(inputs == "move") & ~held] = "hover"
    event[(inputs == "move") & drags] = "drag"
    event[inputs == "wheel"] = "zoom"
    end = since[-1]
    if end < 0:
        return event, (down, bool(dragging or down and moved[-1] > 0), px, py)
    pressed = inputs[end] == "press"
    return event, (bool(pressed), bool(pressed and moved[-1] > moved[end + 1]), float(x[end]), float(y[end]))


def pointer_events(inputs: DataFrame) -> DataFrame:
    """Graph events from pointer inputs (session, number, sequence, input, x, y): a state machine per session.

    A press and a release without a drag select; moving 4 pixels or more from
    the press begins a drag that lasts to the release; moving without a press hovers.

    ``number`` counts a session's inputs from 1 without a gap. Inputs may come in any order: what comes
    early waits in the state until all before it are there, and a number that was
    there already is a repeated delivery and is dropped. What waits is as much as the
    inputs are out of order. Without that column ``sequence`` is the number.
    """
    if "number" not in inputs.columns:
        inputs = inputs.withColumn("number", F.col("sequence"))
    names = list(_PENDING)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (False, False, 0.0, 0.0, 1, *([] for _ in names))
        pointer, due = tuple(held[:4]), held[4]
        waiting = pd.DataFrame(dict(zip(names, map(list, held[5:]))))
        for pdf in batches:
            rows = pdf[names] if waiting.empty else pd.concat([waiting, pdf[names]])
            rows = rows[rows["number"] >= due].drop_duplicates("number").sort_values("number", ignore_index=True)
            ready = int((rows["number"].to_numpy() == due + np.arange(len(rows))).sum())
            now, waiting = rows.iloc[:ready], rows.iloc[ready:]
            due += ready
            event, pointer = pointer_steps(pointer, *(now[c].to_numpy() for c in ("input", "x", "y")))
            told = now.assign(session=key[0], event=event)
            yield told.loc[told["event"].notna(), ["session", "sequence", "event", "x", "y"]]
        state.update((*pointer, due, *(waiting[c].tolist() for c in names)))

    columns = inputs.select("session", *names)
    return columns.groupBy("session").applyInPandasWithState(step, POINTER_OUTPUT, POINTER_STATE, "append", GroupStateTimeout.NoTimeout)
