import hashlib

import duckdb
import numpy as np
import pytest

from meshwork.llm import codes, oracles

SF = "/root/testdata/sf0.01"


def brute(points, entries):
    away = ((points[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(2)
    return np.array([min(range(len(entries)), key=lambda k: (row[k], k)) for row in away]), [min(row) for row in away]


@pytest.mark.parametrize("most,width", [(2, 3), (3, 1), (500, 16), (10**6, 16), (codes.bound(64), 16), (5, 0)])
def test_nearest_entry_is_exact(most, width):
    rng = np.random.default_rng(most)
    entries, points = rng.integers(-most, most + 1, (200, width)), rng.integers(-most, most + 1, (60, width))
    entries[50:90] = entries[:40]  # equal entries tie
    index, away = codes.EntryTree(entries).nearest(points)
    wanted, least = brute(points, entries)
    assert (index == wanted).all() and away.tolist() == [int(x) for x in least]


def test_far_balls_are_not_visited():
    rng = np.random.default_rng(5)
    centres = rng.integers(-20_000, 20_000, (16, 8))
    entries = np.repeat(centres, 16, axis=0) + rng.integers(-50, 50, (256, 8))
    points = np.repeat(centres, 100, axis=0) + rng.integers(-60, 60, (1600, 8))
    tree = codes.EntryTree(entries)
    search = codes._Search(tree, points)
    search.visit(0, np.arange(len(points)))
    assert search.tested < 0.2 * len(points) * len(entries)
    assert (search.best == ((points - entries[search.index]) ** 2).sum(1)).all()


def plain(rows):
    """The contract in plain Python integers over (vec_id, vector, label)."""
    ints = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v], label) for i, v, label in rows]
    ints.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], dtype="<i4").tobytes()))
    ends = codes.cuts(len(ints[0][1]))
    books = [[v[a:b] for _, v, _ in ints[:256]] for a, b in zip(ends, ends[1:])]

    def nearest(p, book):
        return min((sum((x - y) ** 2 for x, y in zip(p, e)), k) for k, e in enumerate(book))

    for _ in range(4):
        for part, (a, b) in enumerate(zip(ends, ends[1:])):
            groups = {}
            for _, v, _ in ints:
                groups.setdefault(nearest(v[a:b], books[part])[1], []).append(v[a:b])
            for k, members in groups.items():
                books[part][k] = [sum(c) // len(members) for c in zip(*members)]
    out, totals = [], {}
    for i, v, label in ints:
        found = [nearest(v[a:b], books[p]) for p, (a, b) in enumerate(zip(ends, ends[1:]))]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        totals[label] = totals.get(label, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, totals[label], sha) for i, c, e, label in out), key=repr)


def check(spark, rows, usable, schema="vec_id long, embedding array<double>, label int"):
    got = codes.compress_vectors(spark.createDataFrame(rows, schema).repartition(4))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(usable)


def test_odd_vectors(spark):
    rng = np.random.default_rng(11)
    nan, inf = float("nan"), float("inf")
    usable = [(int(i), [float(x) for x in rng.normal(0, 0.3, 8)], None if i % 3 == 0 else int(i) % 2) for i in rng.permutation(330)]
    usable += [(None, [0.5] * 8, 1), (7, [0.25] * 8, None), (7, [0.25] * 8, None), (8, [-1.0] * 8, 1)]
    out = [(900, None, 1), (901, [None] + [0.0] * 7, 1), (-5, [nan] * 8, 0), (-6, [inf] + [0.0] * 7, 0), (-7, [-inf] * 8, None)]
    check(spark, usable + out, usable)


def test_few_rows_widths_and_extremes(spark):
    check(spark, [(3, [1.0] * 6, 1), (4, [2.0, 1.0, 0.5, 0.1, 0.0, -0.1], 1)], [(3, [1.0] * 6, 1), (4, [2.0, 1.0, 0.5, 0.1, 0.0, -0.1], 1)])
    df = spark.createDataFrame([(1, [0.0] * 4, 1), (2, [1.0] * 5, 1), (3, [], 2), (4, [1e300, -1e300, 3e38, 0.0], 2)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in codes.compress_vectors(df).collect()}
    assert got.keys() == {1, 2, 3, 4} and got[2].code is None and got[3].error is None and got[1].code == "00000000" and got[4].code == "01010100"
    assert codes.compress_vectors(df.where("false")).count() == 0
    assert codes.compress_vectors(df.where("vec_id = 3")).first().code == "00000000"
    empty = spark.createDataFrame([(1, None, "x")], "vec_id long, embedding array<float>, label string")
    assert codes.compress_vectors(empty).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    theirs = sorted(con.execute(f"select {', '.join(names)} from ({oracles.CODES})").fetchall())
    assert sorted(tuple(r[n] for n in names) for r in codes.op11_codes(spark, SF).collect()) == theirs
