import math
import random
import zlib
from collections import Counter

import pytest

from meshwork.llm import toxicity


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in toxicity.op1_toxicity(spark, d).collect()}
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    labels = [r for r in spark.read.parquet(f"{d}/labels.parquet").collect() if rows[r.doc_id].held_out]
    toxic = [rows[r.doc_id].score for r in labels if r.toxic]
    clean = [rows[r.doc_id].score for r in labels if not r.toxic]
    assert sum(s >= 0.7 for s in toxic) / len(toxic) > 0.8
    assert sum(s >= 0.7 for s in clean) / len(clean) < 0.03


def test_edges(spark):
    docs = spark.createDataFrame(
        [(i, t, "s", 0.5) for i, t in enumerate(["you idiot"] * 8 + ["fine day"] * 20 + [None, "", "x " * 100_000])], "doc_id long, text string, source string, score double"
    )
    labels = spark.createDataFrame([(i, 1 if i < 8 else 0) for i in range(12)], "doc_id long, toxic int")
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == 31 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[0] == by[1] and by[0] > by[20] and by[28] == by[29]
    assert toxicity.score_documents(docs.where("false"), labels).count() == 0
    none = toxicity.score_documents(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {toxicity._sigmoid(toxicity.np.log(0.1 / 0.9))} or len({round(r.score, 6) for r in none}) == 1


def plain_fit(positive, unlabelled, prior, rounds, rate, decay):
    """The same descent, one text and one feature at a time."""
    sets = [toxicity.features(t) for t in positive], [toxicity.features(t) for t in unlabelled]
    counts = [Counter(f for s in group for f in s) for group in sets]
    n_p, n_u = len(positive), len(unlabelled)
    ratio = {}
    for f in counts[0].keys() | counts[1].keys():
        p, u = counts[0][f], counts[1][f]
        if p + u >= 2:
            r = math.log((p + 0.5) / (n_p + 1)) - math.log((u + 0.5) / (n_u + 1))
            error = math.sqrt(1 / (p + 1) + 1 / (u + 1))
            ratio[f] = r * max(0.0, 1 - toxicity.NOISE / max(abs(r) / error, 1e-9))
    w, bias = dict.fromkeys(ratio, 0.1), math.log(prior / (1 - prior))
    m, v = Counter(), Counter()
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    corrected = 0
    for t in range(1, rounds + 1):
        logits = [[bias + sum(w[f] * ratio[f] for f in s if f in ratio) for s in group] for group in sets]
        negative = sum(math.log(1 + math.exp(z)) for z in logits[1]) / n_u - prior * sum(math.log(1 + math.exp(z)) for z in logits[0]) / n_p
        if negative >= 0:
            slopes = [[prior / n_p * (-sigmoid(-z) - sigmoid(z)) for z in logits[0]], [sigmoid(z) / n_u for z in logits[1]]]
        else:
            corrected += 1
            slopes = [[prior / n_p * sigmoid(z) for z in logits[0]], [-sigmoid(z) / n_u for z in logits[1]]]
        gradient = {f: decay * w[f] for f in w} | {"": sum(map(sum, slopes))}
        for group, slope in zip(sets, slopes):
            for s, d in zip(group, slope):
                for f in s:
                    if f in ratio:
                        gradient[f] += d * ratio[f]
        for f, g in gradient.items():
            m[f] = 0.9 * m[f] + 0.1 * g
            v[f] = 0.999 * v[f] + 0.001 * g * g
            step = rate * (m[f] / (1 - 0.9**t)) / (math.sqrt(v[f] / (1 - 0.999**t)) + 1e-8)
            if f:
                w[f] = max(w[f] - step, 0.0)
            else:
                bias -= step
    return {f: w[f] * r for f, r in ratio.items()}, bias, corrected


def test_fit_against_plain_descent():
    rng = random.Random(6)
    words = [f"{a}word" for a in "abcdefghijklm"]
    positive = [" ".join(rng.choices(words[:6] + ["slur"] * 4, k=8)) for _ in range(20)]
    unlabelled = [" ".join(rng.choices(words + ["slur"], k=8)) for _ in range(40)]
    for prior in (0.1, 0.45):
        index = toxicity.FeatureIndex()
        weights, bias = toxicity.fit_nnpu([index.add(t) for t in positive], [index.add(t) for t in unlabelled], index, prior, rounds=60)
        plain, plain_bias, corrected = plain_fit(positive, unlabelled, prior, 60, 0.1, 2e-4)
        assert bias == pytest.approx(plain_bias, abs=1e-9) and weights == pytest.approx({f: x for f, x in plain.items() if abs(x) > 1e-3}, abs=1e-9)
        assert weights and corrected


def test_scores_against_a_plain_sum(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = toxicity.training_labels(spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    weights, bias = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score_documents(docs, labels).collect():
        logit = bias + sum(weights.get(f, 0.0) for f in toxicity.features(texts[r.doc_id] or ""))
        assert r.score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9)


def test_repeated_ids_are_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 30)
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 40)
    rows = [(1, f"bad text {i}") for i in range(300)] + [(2 + i % 3, f"fine text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    parts = toxicity._sample(docs, labels).groupBy("part").count().collect()
    assert all(r["count"] <= (30 if r.part else 40) for r in parts)
    assert len({r.score for r in toxicity.score_documents(docs, labels).collect()}) >= 1
