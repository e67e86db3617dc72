import random

import numpy as np
import pytest

from meshwork.llm import near_duplicates as nd


def brute(rows, size, numerator, denominator):
    """component by row, comparing all pairs of whole texts."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < size else set(zip(*[w[i:] for i in range(size)])) if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and denominator * len(sets[i] & sets[j]) >= numerator * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(s), least[root(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def copies(seed, n=60, words=40):
    rng = random.Random(seed)
    rows = []
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 8, words, words * 4]))] for _ in range(n // 6)]
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    return rows


EDGES = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one Two"), (1004, "ONE two"), (1005, "one two three"), (1006, "A b c d"), (1007, "a B c d"), (1007, "a b c d")]


@pytest.mark.parametrize("threshold", [nd.CONTRACT, nd.Threshold()])
def test_components_against_all_pairs(spark, threshold):
    rows = copies(1) + copies(2, 90, 25)[:0] + EDGES
    df = spark.createDataFrame([(d, t, 7, 8) for d, t in rows], "doc_id long, text string, component_id int, block int").repartition(3)
    found = sorted(map(tuple, nd.near_duplicates(df, threshold).collect()))
    assert found == brute(rows, threshold.size, threshold.numerator, threshold.denominator)


def test_blocks_of_several_leaves(spark, monkeypatch):
    monkeypatch.setattr(nd, "LEAF_CLASSES", 6)
    rows = copies(3, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nd.near_duplicates(df, nd.CONTRACT).collect())) == brute(rows, 3, 90, 100)


def test_keys_meet_for_every_linked_pair():
    rng = np.random.default_rng(5)
    t = nd.Threshold(3, 80, 100)
    for n in (1, 4, 7, 30, 63, 64, 200):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = rng.integers(0, max(1, n // 8) + 1)
            b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, rng.integers(0, max(1, n // 8) + 1)).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if len(b) and t.linked(both, len(a), len(b)):
                (x, least), (y, _) = t.keys(a), t.keys(b)
                shared = np.isin(x, y)
                assert shared.any()
                # all keys of one band carry the same number
                assert any(np.count_nonzero(shared[least == k]) >= k for k in np.unique(least))


def test_unrelated_long_texts_meet_nowhere(spark):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 50_000, int(rng.integers(4_500, 5_500))))) for i in range(400)]
    rows.append((400, rows[0][1] + " and a few words more"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sized = nd.written(nd._sized(df, nd.Threshold()), "sized")
    met = nd._met(sized)
    assert met.select("class").distinct().count() == 2 and met.agg({"m": "max"}).first()[0] == 2
    found = nd.near_duplicates(df).collect()
    assert {r.doc_id for r in found if r.component_id != r.doc_id} == {400}


def test_bounds_fold_and_stay_above_overlaps():
    rng = np.random.default_rng(3)
    for n in (40, 600, 3_000, 9_000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 2**63, n).astype(np.uint64))))
        x, y = (nd.count_vector(s, nd.coordinates(len(s)), np.uint8) for s in (a, b))
        assert nd._pair_bounds([x, y], [y, x]).tolist() == [nd._pair_bounds([x], [y])[0]] * 2
        assert nd._pair_bounds([x], [y])[0] >= len(np.intersect1d(a, b))
    full = np.full(64, 255, dtype=np.uint8)
    assert nd._pair_bounds([full], [full])[0] > 1 << 20


def test_passage_in_very_many_texts(spark, monkeypatch):
    """A passage that all texts share makes crowded and hot keys; only real copies are linked."""
    monkeypatch.setattr(nd, "LEAF_CLASSES", 8)
    monkeypatch.setattr(nd, "HOT_SAMPLED", 10)
    rng = random.Random(7)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, passage + " " + " ".join(f"w{rng.randrange(9999)}" for _ in range(rng.choice([2, 30, 60])))) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " more") for i in range(10)]
    rows += [(None, rows[0][1]), (None, rows[0][1]), (None, "only without a number"), (300, rows[3][1]), (300, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: tuple((v is None, v) for v in r)
    for t in (nd.CONTRACT, nd.Threshold()):
        numbered = [(d if d is not None else 10_000 + i, text) for i, (d, text) in enumerate(rows)]
        expected = [(None if d >= 10_000 else d, n, None if c >= 10_000 else c) for d, n, c in brute(numbered, t.size, t.numerator, t.denominator)]
        assert sorted(map(tuple, nd.near_duplicates(df, t).collect()), key=key) == sorted(expected, key=key)


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    found = sorted(map(tuple, nd.op6_ngram_jaccard(spark, "/root/testdata/sf0.001").collect()))
    assert found == brute([(d.doc_id, d.text) for d in docs], 3, 90, 100)
