import itertools
import random
from collections import defaultdict

import pytest

from meshwork.llm import mixing


def test_targets_share_and_cap():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 300) == pytest.approx([187.5, 75, 37.5])
    found = mixing.targets([10, 1000, 1000], [5, 2, 1], 2010)
    assert found[0] == 30 and found[1] == pytest.approx(2 * found[2]) and sum(found) == pytest.approx(2010)


def test_flow_prefers_first_use_and_meets_quotas():
    # the shared pattern serves whichever source lacks tokens of its own
    assert mixing.min_cost_flow([100, 100, 100], [[0], [1], [0, 1]], [150, 100]) in ([100, 100, 50], [100, 50, 100])
    assert sum(mixing.min_cost_flow([10], [[0]], [100])) == 30


def test_overlapping_sources(spark):
    rows = [(i, 10, "ab" if i % 3 == 0 else "a" if i % 3 == 1 else "b", ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b"]) for i in range(300)]
    slim = spark.createDataFrame(rows, "doc_id long, size long, pattern string, members array<string>")
    out = mixing.mix(slim, slim, {"a": 1500.0, "b": 1000.0}).collect()
    assert sum(r.size * r.repeats for r in out) == 2500 and max(r.repeats for r in out) <= 3


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query_comes_near_targets_and_reruns_agree(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = mixing.op3_mixing(spark, d).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source").collect()}
    assert len(rows) == len(source)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert 0 <= r.taken <= 3 * r.size
    names = sorted(sizes)
    assert [target[n] for n in names] == pytest.approx(mixing.targets([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], sum(sizes.values())))
    assert all(abs(taken[n] - target[n]) < 0.02 * target[n] for n in names)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op3_mixing(spark, d).collect()))


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, None, 1), (2, "", "b", 1), (3, "a b c", "b", 1), (3, "a b c", "b", 1), (4, "d e", None, 1), (5, "x", "", 1)], "doc_id long, text string, source string, size int"
    )
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == 6 and all(r.mix_repeats == 0 for r in rows if r.mix_size == 0)
    assert mixing.mix_sources(docs.where("false")).count() == 0


def best_flow(sizes, members, quotas, repeats=3):
    """The most that can be routed and its least cost, by trying every way."""
    best = {}
    options = [[(given, per) for given in range(repeats * size + 1) for per in itertools.product(range(given + 1), repeat=len(m)) if sum(per) == given] for size, m in zip(sizes, members)]
    for chosen in itertools.product(*options):
        used = [0] * len(quotas)
        for (_, per), m in zip(chosen, members):
            for s, x in zip(m, per):
                used[s] += x
        if all(u <= q for u, q in zip(used, quotas)):
            cost = sum(min(max(given - r * size, 0), size) * r * r for (given, _), size in zip(chosen, sizes) for r in range(repeats))
            total = sum(used)
            best[total] = min(best.get(total, cost), cost)
    return max(best), best[max(best)]


def test_flow_against_every_way():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 3)
        sources = rng.randint(1, 3)
        sizes = [rng.randint(0, 2) for _ in range(n)]
        members = [sorted(rng.sample(range(sources), rng.randint(1, sources))) for _ in range(n)]
        quotas = [rng.randint(0, 5) for _ in range(sources)]
        given = mixing.min_cost_flow(sizes, members, quotas)
        cost = sum(min(max(g - r * s, 0), s) * r * r for g, s in zip(given, sizes) for r in range(3))
        assert (sum(given), cost) == best_flow(sizes, members, quotas)


def test_targets_of_a_table_equal_the_plain_ones(spark):
    rng = random.Random(5)
    sizes = {f"s{k:04d}é" if k % 3 else f"sÄ{k}": int(10 ** rng.uniform(0, 6)) for k in range(500)} | {"\U0010ffff": 40, "s": 0}
    table = spark.createDataFrame(list(sizes.items()), "pattern string, source_size long")
    found = {r.pattern: r.target for r in mixing.target_table(table).collect()}
    assert found == pytest.approx(mixing.source_targets(sizes))
    assert mixing.target_table(table.where("false")).count() == 0


def test_many_sources_alone_and_some_overlapping(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 3)
    rows = [(i, 5, f"p{i % 30}", [f"p{i % 30}"]) for i in range(900)] + [(1000 + i, 10, "ab", ["a", "b"]) for i in range(20)] + [(2000 + i, 10, "a", ["a"]) for i in range(20)]
    slim = spark.createDataFrame(rows, "doc_id long, size long, pattern string, members array<string>")
    out = mixing.mix(slim, slim, {f"p{k}": 150.0 * (k % 3) for k in range(30)} | {"a": 150.0, "b": 120.0}).collect()
    taken = defaultdict(int)
    for r in out:
        taken[r.pattern] += r.size * r.repeats
    assert len(out) == len(rows) and all(taken[f"p{k}"] == 150 * (k % 3) for k in range(30)) and taken["a"] + taken["ab"] == 270
    many = spark.createDataFrame([(i, 1, f"x{i}", ["a", f"x{i}"]) for i in range(9)], "doc_id long, size long, pattern string, members array<string>")
    assert sum(r.repeats for r in mixing.mix(many, many, {"a": 3.0}).collect()) == 3


def test_sources_tied_over_others_share_a_network(spark):
    rows = [("ab", ["a", "b"]), ("bc", ["b", "c"]), ("d", ["d"]), ("ef", ["f", "e"]), ("e", ["e"]), ("none", [])]
    sums = spark.createDataFrame([(p, m, 10, 1) for p, m in rows], "pattern string, members array<string>, total long, n long")
    quotas = spark.createDataFrame([(s, 12.0) for s in "abcdefg"], "source string, quota double")
    patterns, sources = mixing._networks(sums, quotas)
    network = {r.pattern: r.network for r in patterns.collect()}
    assert network["ab"] == network["bc"] and network["e"] == network["ef"] and len({network[p] for p in ("ab", "d", "e")}) == 3
    at = {r.source: r.of_network for r in sources.collect()}
    assert at["a"] == at["c"] == network["ab"] and len(set(at.values())) == 4
    flows = {r.pattern: r.flow for r in mixing._flows(sums, quotas).collect()}
    # three quotas of 12 meet 60 words at most; the cheapest way repeats both patterns alike
    assert flows == {"ab": 18, "bc": 18, "d": 12, "ef": 14, "e": 10, "none": 0} or (flows["ab"] + flows["bc"], flows["ef"] + flows["e"], flows["d"], flows["none"]) == (36, 24, 12, 0)


def test_nothing_is_taken_without_the_flow(spark, monkeypatch):
    monkeypatch.setattr(mixing, "min_cost_flow", lambda sizes, members, quotas: [0] * len(sizes))
    assert sum(r.taken for r in mixing.op3_mixing(spark, "/root/testdata/sf0.001").collect()) == 0


def plain_choice(rows, flow, place):
    """How often each document (doc_id, size) of one pattern is taken: whole rounds, whole buckets, then what fits."""
    total = sum(size for _, size in rows)
    full, rest = divmod(flow, total)
    buckets = max(1, min(len(rows) // mixing.BUCKET_ROWS, mixing.MAX_BUCKETS))
    order = sorted(rows, key=lambda r: (place[r[0]], r))
    of = {d: min(int(place[d] * buckets), buckets - 1) for d, _ in rows}
    times, before = {d: full * (size > 0) for d, size in rows}, 0
    for b in range(buckets):
        mine = [(d, size) for d, size in order if of[d] == b]
        words = sum(size for _, size in mine)
        if before + words <= rest:
            for d, size in mine:
                times[d] += size > 0
            before += words
            continue
        left, missed = rest - before, []
        for d, size in mine:
            if 0 < size <= left:
                times[d] += 1
                left -= size
            elif size:
                missed.append((size, place[d], d))
        if left and missed and min(missed)[0] < 2 * left:
            times[min(missed)[2]] += 1
        break
    return times


def test_query_takes_the_documents_that_a_plain_version_takes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 40)
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    place = {r.doc_id: r.u for r in docs.select("doc_id", mixing._seeded(mixing.SEED).alias("u")).collect()}
    rows, by, target = mixing.op3_mixing(spark, d).collect(), defaultdict(list), {}
    for r in rows:
        by[source[r.doc_id]].append((r.doc_id, r.size))
        target[source[r.doc_id]] = r.target
    wanted = {}
    for name, members in by.items():
        total = sum(size for _, size in members)
        flow = mixing.min_cost_flow([total], [[0]], [round(target[name])])[0]
        wanted |= plain_choice(members, flow, place)
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.size * wanted[r.doc_id] for r in rows}
