import random

import pytest
from pyspark.sql import functions as F

from meshwork.operators import intervals
from meshwork.operators.dealing import dealt_join

SPANS = "document long, order long, start long, end long"


def some_spans(seed, n, documents=3):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        start, size = rng.randrange(400), rng.choice([0, 1, 2, 3, 7, 8, 9, 64, 300])
        out.append((0 if k % 3 else rng.randrange(documents), k, start, start + size))
    rng.shuffle(out)
    return out


def meet(a, b):
    return a[0] == b[0] and max(a[2], b[2]) < min(a[3], b[3])


@pytest.mark.parametrize("bound", [5, 20_000])
def test_pairs_equal_all_with_all(spark, bound):
    left, right = some_spans(1, 250), some_spans(2, 200)
    a = spark.createDataFrame(left, SPANS)
    b = spark.createDataFrame(right, SPANS).select("document", F.col("order").alias("other"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    found = intervals.overlap_pairs(a, b, "document", bound).select("order", "other").collect()
    wanted = sorted((x[1], y[1]) for x in left for y in right if meet(x, y))
    assert sorted(map(tuple, found)) == wanted
    assert intervals.overlap_pairs(a, b.where("false"), "document").count() == 0


def test_pieces_make_up_the_interval(spark):
    rows = [(0, 1), (0, 16), (3, 17), (5, 6), (1, 1023), (2**40, 2**40 + 77)]
    df = spark.createDataFrame(rows, "start long, end long").withColumn("p", intervals.dyadic_pieces(F.col("start"), F.col("end")))
    for r in df.collect():
        held = sorted((p.block << p.level, (p.block + 1) << p.level) for p in r.p)
        assert held[0][0] == r.start and held[-1][1] == r.end and all(a[1] == b[0] for a, b in zip(held, held[1:]))
        assert len(r.p) <= 2 * (r.end - r.start).bit_length()


def test_neighbours_equal_all_with_all(spark):
    rows = some_spans(3, 300) + [(9, 1, 5, 5), (8, 4, 0, 10)]
    found = {(r.document, r.order): (r.previous, r.next) for r in intervals.overlap_neighbours(spark.createDataFrame(rows, SPANS), "document", "order").collect()}
    assert len(found) == len(rows)
    for a in rows:
        others = [b[1] for b in rows if b[1] != a[1] and meet(a, b)]
        assert found[a[0], a[1]] == (max((k for k in others if k < a[1]), default=None), min((k for k in others if k > a[1]), default=None))
    assert intervals.overlap_neighbours(spark.createDataFrame([], SPANS), "document", "order").count() == 0


def test_crowded_keys_are_dealt(spark):
    left = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(300)] + [(None, 1)], "key long, a long")
    right = spark.createDataFrame([(1 if k % 2 else k, k) for k in range(100)] + [(None, 1)], "key long, b long")
    pairs = sorted(map(tuple, dealt_join(left, right, ["key"], 7).select("key", "a", "b").collect()))
    assert pairs == sorted(map(tuple, left.join(right, "key").select("key", "a", "b").collect()))
