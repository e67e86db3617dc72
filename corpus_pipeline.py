"""A corpus pipeline of five stages over documents, from raw texts to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return
exactly the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm import mixing, near_duplicates, packing, pii, toxicity
from meshwork.llm.common import new_path, read_table, unused, written

#: No stage but the first could be given in SQL: learned scores, flows and packings are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from training labels only."""
    names = unused(docs, "score"), unused(docs, "predicted")
    scored = toxicity.score_rows(docs, toxicity.training_labels(read_table(spark, sf_dir, "labels")), names=names)
    return scored.where(F.col(names[1]) == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share 80 % of their five-word shingles, the one with the smallest doc_id stays."""
    found = near_duplicates.near_duplicates(docs).where(F.col("doc_id") == F.col("component_id"))
    kept = written(found.groupBy("doc_id").agg(F.count("*").alias("n_rows")), "kept")
    small = kept.count() <= near_duplicates.BROADCAST_ROWS

    def only(ids: DataFrame) -> DataFrame:
        return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")

    out = only(kept.where("n_rows = 1").select("doc_id"))
    several = kept.where("n_rows > 1").select("doc_id")
    if several.limit(1).count():  # rows that share a doc_id: one of each text stays
        out = out.unionByName(only(several).dropDuplicates(["doc_id", "text"]))
    return out.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated until sources meet their target weights."""
    whole = docs.select(F.struct("*").alias("document"), "doc_id", "text", "source")
    mixed = mixing.mix_sources(whole).where("mix_repeats > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("mix_repeats").cast("int")))
    return mixed.select("document", copies.alias("mix_copy")).select("document.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    # workers that earlier stages used keep part of their memory, so the word tables are smaller than by default
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=100_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
