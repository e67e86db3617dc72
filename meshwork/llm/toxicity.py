"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts without any label are the
unlabelled set. One numpy logistic classifier is trained, in one task on a
bounded sample, by full-batch descent on

    prior * risk_P(+1) + max(0, risk_U(-1) - prior * risk_P(-1))

with the same steps whatever the table's size. Features are the distinct words of a text and
their beginnings of four and six characters, scaled by the log ratio of their
frequencies among positives and unlabelled texts.

Parameters that bound the fit (scoring covers every whole text):
``MAX_POSITIVE`` labelled rows and ``MAX_UNLABELLED`` unlabelled ones, drawn by
a hash of doc_id and text. What is broadcast are the
features of those texts whose frequencies differ by more than chance, so it
never grows with the data.

Defined results: null and empty texts are scored as texts without features;
repeated rows get equal scores; an empty table gives no rows; without positive
training labels every score is the class prior. Texts of any length are scored whole. Other
columns come through, but for ones that are named as the two added ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import crc_mod, map_batches, read_table, written

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 8_000
#: Standard errors by which a feature's log ratio is shrunk towards none.
NOISE = 2.5
REJECT_AT = 0.7
DEFAULT_PRIOR = 0.1
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """Distinct lower-case words, and their beginnings marked by a hyphen."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:4] + "-" for w in words if len(w) > 4} | {w[:6] + "-" for w in words if len(w) > 6}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class FeatureIndex:
    """Numbers for features, so that a text's set is an array of four bytes a feature."""

    def __init__(self):
        self.ids: dict[str, int] = {}

    def add(self, text: str) -> np.ndarray:
        ids = self.ids
        return np.fromiter((ids.setdefault(f, len(ids)) for f in sorted(features(text))), dtype=np.int32)


def fit_nnpu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], index: FeatureIndex, prior: float, rounds: int = 200, rate: float = 0.1, decay: float = 2e-4
) -> tuple[dict[str, float], float]:
    """Weights by feature and the bias of one classifier."""
    n_p, n_u, n_all = len(positive), len(unlabelled), len(index.ids)
    in_p = np.bincount(np.concatenate(positive), minlength=n_all)
    in_u = np.bincount(np.concatenate(unlabelled), minlength=n_all)
    chosen = np.flatnonzero(in_p + in_u >= 2)
    place = np.full(n_all, -1, dtype=np.int64)
    place[chosen] = np.arange(len(chosen))
    p, u = in_p[chosen].astype(float), in_u[chosen].astype(float)
    ratio = np.log((p + 0.5) / (n_p + 1.0)) - np.log((u + 0.5) / (n_u + 1.0))
    # a ratio that chance explains says nothing: shrink by its standard error
    ratio *= np.maximum(0.0, 1.0 - NOISE / np.maximum(np.abs(ratio) / np.sqrt(1 / (p + 1.0) + 1 / (u + 1.0)), 1e-9))

    def matrix(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows, columns = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), place[np.concatenate(sets)]
        keep = columns >= 0
        keep[keep] = ratio[columns[keep]] != 0
        return rows[keep], columns[keep]

    rows_p, cols_p = matrix(positive)
    rows_u, cols_u = matrix(unlabelled)
    v_p, v_u = ratio[cols_p], ratio[cols_u]
    w, bias = np.full(len(chosen), 0.1), np.log(prior / (1 - prior))
    m, s, t = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), 0
    for _ in range(rounds):
        g_p = np.bincount(rows_p, w[cols_p] * v_p, n_p) + bias
        g_u = np.bincount(rows_u, w[cols_u] * v_u, n_u) + bias
        risk_u, risk_p = np.logaddexp(0, g_u).mean(), np.logaddexp(0, g_p).mean()
        if risk_u - prior * risk_p >= 0:
            d_p = prior / n_p * (-_sigmoid(-g_p) - _sigmoid(g_p))
            d_u = _sigmoid(g_u) / n_u
        else:  # the corrected negative risk went below zero: step back out of it
            d_p = prior / n_p * _sigmoid(g_p)
            d_u = -_sigmoid(g_u) / n_u
        slope = np.bincount(cols_p, d_p[rows_p] * v_p, len(chosen)) + np.bincount(cols_u, d_u[rows_u] * v_u, len(chosen))
        slope = np.append(slope + decay * w, d_p.sum() + d_u.sum())
        t += 1
        m, s = 0.9 * m + 0.1 * slope, 0.999 * s + 0.001 * slope**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, bias = np.maximum(w - step[:-1], 0.0), bias - step[-1]
    weights = np.zeros(n_all)
    weights[chosen] = w * ratio
    return {f: float(weights[i]) for f, i in index.ids.items() if abs(weights[i]) > 1e-3}, float(bias)


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The training texts with part 1 (toxic) or 0 (no label): at most as many rows as the two bounds.

    A hash of doc_id first thins the rows to about twice what is wanted, then
    the bounded numbers with the least hashes are taken.
    """
    share = lambda salt: (F.xxhash64(F.col("doc_id"), F.lit(salt)).cast("double") / 2.0**64 + 0.5)
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    n_toxic, n_docs = toxic.count(), docs.count()
    toxic = toxic.where(share("p") < 2 * MAX_POSITIVE / max(n_toxic, 1))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    free = texts.where(crc_mod(F.col("doc_id"), 3) != 1).where(share("u") < 3 * MAX_UNLABELLED / max(n_docs, 1))
    free = free.join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
    found = []
    # the labelled ids that are left are bounded by the thinning, so they can be broadcast
    for part, rows, most in ((1, texts.join(F.broadcast(toxic), "doc_id", "left_semi"), MAX_POSITIVE), (0, free, MAX_UNLABELLED)):
        placed = rows.select(F.lit(part).alias("part"), F.xxhash64("doc_id", "text", F.lit(part)).alias("place"), "text")
        found.append(placed.orderBy("place").limit(most))
    return found[0].unionByName(found[1])


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """Weights by feature and the bias. ``labels`` holds training labels only."""
    share = labels.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    prior = DEFAULT_PRIOR if share is None else min(max(share, 0.001), 0.6)
    texts = written(_sample(docs, labels.where("doc_id is not null and toxic is not null")), "training")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "place"])
        index = FeatureIndex()
        positive = [index.add(t) for t in pdf.text[pdf.part == 1]]
        unlabelled = [index.add(t) for t in pdf.text[pdf.part == 0]]
        if not positive or not unlabelled:
            return pd.DataFrame({"feature": [""], "weight": [float(np.log(prior / (1 - prior)))]})
        weights, bias = fit_nnpu(positive, unlabelled, index, prior)
        return pd.DataFrame({"feature": [*weights, ""], "weight": [*weights.values(), bias]})

    # the sample is bounded by two parameters, so it may meet in one task, and its features on the driver
    rows = texts.groupBy().applyInPandas(fit, "feature string, weight double").collect()
    found = {r.feature: r.weight for r in rows}
    bias = found.pop("", float(np.log(prior / (1 - prior))))
    return found, bias


def score_rows(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Every row of ``docs`` with score and predicted added under these names, trained on ``labels``; columns so named give way."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    others = [c for c in docs.columns if c not in names]
    place = others.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, start = model.value
        get = weights.get
        for batch in batches:
            logits = []
            for text in batch.column(place).to_pylist():
                words = set(_WORD.findall((text or "").lower()))
                parts = {w[:4] + "-" for w in words if len(w) > 4} | {w[:6] + "-" for w in words if len(w) > 6}
                # a fixed order of summing keeps equal texts at equal scores
                logits.append(start + sum(sorted(filter(None, map(get, words | parts)))))
            scores = _sigmoid(np.array(logits, dtype=float))
            columns = [*batch.columns, pa.array(scores), pa.array((scores >= reject_at).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, *names])

    selected = docs.select(*others)
    schema = StructType([*selected.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], IntegerType())])
    return map_batches(selected, run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT) -> DataFrame:
    """doc_id, score and predicted of every row of ``docs``, trained on ``labels``."""
    return score_rows(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels, reject_at)


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows whose labels may be learned from."""
    return labels.select("doc_id", "toxic").where(crc_mod(F.col("doc_id"), 3) != 1)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score_documents(docs, training_labels(read_table(spark, sf_dir, "labels")))
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
