"""Folders that driver and executors share, and batches that bound what executors hold."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SLICE_ROWS = 1_000
SLICE_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder only in local mode without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _LOCAL.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` over batches of bounded bytes, so that executor and worker hold few whole texts at once.

    The session's own bound on batches is kept where it is lower.
    """
    conf = df.sparkSession.conf
    number, unit = re.fullmatch(r"(-?\d+)([bkmgt]?)b?", conf.get(BATCH_CONF).strip().lower()).groups()
    if not 0 < int(number) << 10 * "bkmgt".index(unit or "b") <= SLICE_BYTES:
        conf.set(BATCH_CONF, SLICE_BYTES)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    return df.mapInArrow(lambda batches: function(sliced(batches)), schema)
