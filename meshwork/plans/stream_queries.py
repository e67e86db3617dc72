"""Streaming queries run to the end of their input, so their result is the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.sources.shared import new_path
from meshwork.sources.tables import changes
from meshwork.streaming.appliers import StateApplier, run_log

from .registering import Book
from .scene_queries import BOOK as SCENE

BOOK = Book()


@BOOK.add(SCENE.sql["diff_apply"])
def streaming_diff_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log as a stream of files in order of revision."""
    log = changes(spark, sf_dir)
    folder = new_path(spark, "change-log")
    log.repartitionByRange(4, "revision").write.parquet(folder)
    schema = "id bigint, revision bigint, op string, value double"
    applier = StateApplier(spark, new_path(spark, "state"), schema)
    run_log(spark, folder, schema, applier, new_path(spark, "progress"), files=2)
    return applier.live().select("id", "revision", F.col("value"))
