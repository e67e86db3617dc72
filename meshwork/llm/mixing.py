"""Mixing sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources they belong to).
A flow network routes each pattern's tokens to the quotas of its sources:
the first use of a pattern's tokens is free and each further repetition costs
more (convex costs), up to ``MAX_REPEATS``. What a pattern must give becomes a
number of full repetitions for all its documents and a remainder, taken from
documents in a seeded order: whole buckets of that order first, and in the
bucket where the remainder ends each next document that still fits.

Targets are found by aggregates over a table of sources, however many there
are. Sources that documents tie together, directly or over others, form one flow network, which
one task solves; a source that shares no document with another one is a
network of its own. Networks hold a row a pattern, never documents, and none is solved
on the driver.

Documents are never ranked in one task: buckets of the seeded order hold about
``BUCKET_ROWS`` rows and one bucket a pattern is ranked.

Defined results: null and empty texts have size 0 and are never taken; a null
source is a source of its own, last in order; repeated rows are separate rows
that the same seeded number puts next to each other, in order of doc_id and size; an empty table gives no
rows. Words of texts of any length are counted whole. All columns come through, and those that are added
begin with mix_.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.operators.slots import assign_slots

from .common import components, read_table, skewed_join, written

MAX_REPEATS = 3
#: Patterns (rows of some 60 bytes) that are broadcast; beyond, documents are joined by a shuffle.
BROADCAST_ROWS = 100_000
BUCKET_ROWS = 256
MAX_BUCKETS = 65_536
WEIGHTS = (5, 2, 1)
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"), F.lit(0).cast("bigint"))


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float = MAX_REPEATS) -> list[float]:
    """Shares of ``total`` by weight; none above ``cap`` times its size, the excess reshared by weight."""
    found = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes)]
    left = float(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in free:
                found[i] = unit * weights[i]
            break
        for i in over:
            found[i] = float(cap * sizes[i])
            left -= found[i]
        above = set(over)
        free = [i for i in free if i not in above]
    return found


def min_cost_flow(sizes: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], repeats: int = MAX_REPEATS) -> list[int]:
    """Tokens that each pattern gives so that quotas are met as far as they can be.

    Successive shortest paths with potentials. Arcs: source of the network to
    a pattern, one for each repetition r at cost r * r; pattern to its sources
    at no cost; source to the sink up to its quota.
    """
    n_p, n_s = len(sizes), len(quotas)
    start, end = n_p + n_s, n_p + n_s + 1
    graph: list[list[int]] = [[] for _ in range(n_p + n_s + 2)]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def arc(a: int, b: int, capacity: int, price: int) -> None:
        for x, y, c, w in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(w)

    for p, size in enumerate(sizes):
        for r in range(repeats):
            arc(start, p, size, r * r)
        for s in members[p]:
            arc(p, n_p + s, repeats * size, 0)
    for s, quota in enumerate(quotas):
        arc(n_p + s, end, quota, 0)
    height = [0] * len(graph)
    while True:
        away = [float("inf")] * len(graph)
        by = [-1] * len(graph)
        away[start] = 0
        queue = [(0, start)]
        while queue:
            d, node = heapq.heappop(queue)
            if d > away[node]:
                continue
            for e in graph[node]:
                if room[e] and (new := d + cost[e] + height[node] - height[to[e]]) < away[to[e]]:
                    away[to[e]], by[to[e]] = new, e
                    heapq.heappush(queue, (new, to[e]))
        if away[end] == float("inf"):
            break
        height = [h + (a if a < float("inf") else 0) for h, a in zip(height, away)]
        path, node = [], end
        while node != start:
            path.append(by[node])
            node = to[by[node] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    given = [0] * n_p
    for e in graph[start]:
        given[to[e]] += room[e ^ 1]
    return given


def _seeded(seed: int) -> Column:
    return F.xxhash64(F.col("doc_id"), F.lit(seed)).cast("double") / 2.0**64 + 0.5


def _border(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The bucket of a pattern's seeded order in which its remainder ends, and what is left for it."""
    pdf = pdf.sort_values("bucket").reset_index(drop=True)
    before = pdf["words"].cumsum() - pdf["words"]
    rest = int(pdf["rest"].iloc[0])
    hit = pdf.index[(before <= rest) & (before + pdf["words"] > rest)]
    if len(hit):
        bucket, room = int(pdf["bucket"][hit[0]]), rest - int(before[hit[0]])
    else:
        bucket, room = int(pdf["bucket"].max()) + 1, 0
    first = pdf.iloc[0]
    return pd.DataFrame(
        {"pattern": [key[0]], "full": [int(first["full"])], "buckets": [int(first["buckets"])], "border": [bucket], "room": [room]}
    )


def _choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """In that bucket, each next document that still fits, then one more if that comes nearer."""
    pdf = pdf.sort_values(["u", "doc_id", "size"]).reset_index(drop=True)
    left, chosen = int(pdf["room"].iloc[0]), []
    for words in pdf["words"]:
        fits = 0 < words <= left
        chosen.append(fits)
        left -= int(words) if fits else 0
    missed = pdf["words"][[not c and w > 0 for c, w in zip(chosen, pdf["words"])]]
    if left and len(missed) and missed.min() < 2 * left:
        chosen[missed.idxmin()] = True
    return pdf.loc[chosen, ["pattern", "doc_id", "size"]]


def _joined(rows: DataFrame, by: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``by``, one row a pattern; a written table."""
    return rows.join(F.broadcast(by), "pattern") if by.count() <= BROADCAST_ROWS else skewed_join(rows, by, "pattern")


def _networks(sums: DataFrame, quotas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns and sources with the number of the network they belong to: sources that documents tie together, directly or not, share one."""
    member = sums.select("pattern", F.explode("members").alias("source"))
    sources = written(assign_slots(quotas.select("source").unionByName(member.select("source")).distinct(), "source", "node"), "sources")
    # consecutive members of a pattern tie all of them together
    pairs = F.filter(F.transform("members", lambda m, i: F.struct(m.alias("a"), F.element_at("members", F.least(i + 2, F.size("members"))).alias("b"))), lambda p: p["a"] != p["b"])
    ties = sums.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()
    named = sources.select("source", "node", F.col("node").alias("network"))
    if ties.limit(1).count():
        end = lambda name: sources.select(F.col("source").alias(name), F.col("node").alias(f"{name}_node"))
        found = components(ties.join(end("a"), "a").join(end("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "networks")
        named = sources.join(found, "node", "left").select("source", "node", F.coalesce("component", "node").alias("network"))
    named = written(named, "networks")
    patterns = member.groupBy("pattern").agg(F.min("source").alias("source")).join(named.select("source", "network"), "source")
    told = patterns.select("pattern", "network").join(sums, "pattern")
    return told, named.select("source", F.col("network").alias("of")).join(quotas, "source").select(F.col("of").alias("of_network"), "source", "quota")


def _flows(sums: DataFrame, quotas: DataFrame) -> DataFrame:
    """(pattern, total, n, flow): words that each pattern gives, by one flow network for each set of sources that overlap."""

    def flow(key: tuple, patterns: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        patterns, wanted = patterns.sort_values("pattern").reset_index(drop=True), wanted.sort_values("source")
        at = {source: i for i, source in enumerate(wanted["source"])}
        members = [[at[m] for m in ms if m in at] for ms in patterns["members"]]
        given = min_cost_flow(patterns["total"].tolist(), members, [round(q) for q in wanted["quota"]])
        return patterns.assign(flow=pd.Series(given, dtype="int64"))[["pattern", "total", "n", "flow"]]

    patterns, wanted = _networks(sums, quotas)
    found = patterns.groupBy("network").cogroup(wanted.groupBy("of_network")).applyInPandas(flow, "pattern string, total bigint, n bigint, flow bigint")
    alone = sums.where(F.size("members") == 0).select("pattern", "total", "n", F.lit(0).cast("bigint").alias("flow"))
    return found.unionByName(alone)


def mix(docs: DataFrame, slim: DataFrame, quotas: DataFrame | dict[str, float], seed: int = SEED) -> DataFrame:
    """``docs`` with the column repeats: how often the mix takes a row, 0 to ``MAX_REPEATS``.

    ``docs`` and ``slim`` have doc_id, size and pattern; ``slim`` also has
    members, the array of sources that the pattern stands for, and is read
    several times. ``quotas`` has a source's target in words, as (source, quota).
    Rows that share pattern, doc_id and size are taken together or not at all.
    """
    if isinstance(quotas, dict):
        quotas = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in quotas.items()], "source string, quota double")
    sums = slim.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("total"), F.count("*").alias("n"))
    flows = _flows(written(sums, "sums"), quotas)
    some = F.col("total") > 0
    plan_df = flows.select(
        "pattern",
        F.when(some, F.expr("flow div total")).otherwise(0).cast("bigint").alias("full"),
        F.when(some, F.col("flow") % F.col("total")).otherwise(0).cast("bigint").alias("rest"),
        F.greatest(F.least(F.expr(f"n div {BUCKET_ROWS}"), F.lit(MAX_BUCKETS)), F.lit(1)).cast("bigint").alias("buckets"),
    )
    plan_df = written(plan_df, "plan")

    def placed(df: DataFrame, by: DataFrame) -> DataFrame:
        bucket = F.least(F.floor(_seeded(seed) * F.col("buckets")), F.col("buckets") - 1)
        return _joined(df, by).withColumn("bucket", F.coalesce(bucket, F.lit(0).cast("bigint")))

    words = placed(slim.select("doc_id", "size", "pattern"), plan_df)
    words = words.groupBy("pattern", "full", "rest", "buckets", "bucket").agg(F.sum("size").alias("words"))
    shape = "pattern string, full bigint, buckets bigint, border bigint, room bigint"
    borders = written(words.groupBy("pattern").applyInPandas(_border, shape), "borders")

    bordering = placed(slim.select("doc_id", "size", "pattern"), borders).where(F.col("bucket") == F.col("border"))
    bordering = bordering.groupBy("pattern", "doc_id", "size", "room").agg(F.sum("size").alias("words"))
    bordering = bordering.withColumn("u", _seeded(seed))
    chosen = bordering.groupBy("pattern").applyInPandas(_choose, "pattern string, doc_id bigint, size bigint")
    chosen = written(chosen.select(*(F.col(c).alias(f"chosen_{c}") for c in ("pattern", "doc_id", "size"))), "chosen")

    same = (
        (F.col("pattern") == F.col("chosen_pattern"))
        & F.col("doc_id").eqNullSafe(F.col("chosen_doc_id"))
        & (F.col("size") == F.col("chosen_size"))
    )
    extra = ((F.col("bucket") < F.col("border")) | F.col("chosen_pattern").isNotNull()).cast("bigint")
    joined = placed(docs, borders).join(chosen, same, "left")
    return joined.withColumn("repeats", F.when(F.col("size") > 0, F.col("full") + extra).otherwise(F.lit(0))).drop(
        "full", "buckets", "border", "room", "bucket", "chosen_pattern", "chosen_doc_id", "chosen_size"
    )


def _source_key(column: Column) -> Column:
    """Source names with a place for null after all of them."""
    return F.coalesce(F.concat(F.lit("s"), column), F.lit("\U0010ffff"))


def source_targets(sizes: dict[str, int], weights: Sequence[float] = WEIGHTS) -> dict[str, float]:
    """Targets by source key, sources in order of code points: the plain version of ``target_table``."""
    names = sorted(sizes)
    return dict(zip(names, targets([sizes[n] for n in names], [weights[i % len(weights)] for i in range(len(names))], sum(sizes.values()))))


def target_table(sizes: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """(pattern, source_size, target) of sources (pattern, source_size), one row each.

    What each free source gets for a unit of weight rises until no source is
    above its cap; a round is one aggregate over the sources.
    """
    placed = assign_slots(sizes, "pattern", "place")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = written(placed.select("pattern", "source_size", weight.alias("weight"), (F.col("source_size") * MAX_REPEATS).cast("double").alias("cap")), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    unit, capped = 0.0, -1
    while True:
        over = F.lit(unit) * F.col("weight") > F.col("cap")
        found = table.agg(
            F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("free")
        ).first()
        if found.n == capped or not found.free:
            break
        capped, unit = found.n, (total - found.full) / found.free
    return table.select("pattern", "source_size", F.least(F.lit(unit) * F.col("weight"), F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """All rows and columns of ``docs`` with mix_size, mix_source_size, mix_target and mix_repeats."""
    size, key = word_count(F.col("text").cast("string")), _source_key(F.col("source").cast("string"))
    slim = written(docs.select("doc_id", size.alias("size"), key.alias("pattern")), "mix")
    info = written(target_table(slim.groupBy("pattern").agg(F.sum("size").alias("source_size")), weights), "targets")
    quotas = info.select(F.col("pattern").alias("source"), F.col("target").alias("quota"))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id"), size.alias("size"), key.alias("pattern"))
    taken = _joined(mix(packed, slim.withColumn("members", F.array("pattern")), quotas, seed), info)
    return taken.select(
        "row.*",
        F.col("size").alias("mix_size"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        F.col("repeats").alias("mix_repeats"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_repeats")).alias("taken"),
    )
