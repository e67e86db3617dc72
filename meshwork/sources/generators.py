"""Deterministic data sources from closed formulas and seeded numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COHORT_NODES, COHORT_EDGES = 10_000, 50_000
#: Rows that one task makes at most.
TASK_ROWS = 500_000
#: Bits of a picking number by which rows are counted.
KEY_BITS = 16


def cohort_nodes(spark: SparkSession, count: int = COHORT_NODES, slots: DataFrame | None = None) -> DataFrame:
    """Nodes of the given slots, else of the first ``count``."""
    i = F.col("slot")
    rows = spark.range(count).select(F.col("id").alias("slot")) if slots is None else slots.select("slot")
    return rows.select(i, (i + 1).alias("id"), (i % 8).cast("int").alias("kind"), (F.lit(0.22) + (i % 5) * 0.025).alias("radius"), (i * 37 % count).alias("rank"))


def cohort_edges(spark: SparkSession, count: int = COHORT_EDGES, nodes: int = COHORT_NODES, slots: DataFrame | None = None) -> DataFrame:
    """Edge i runs from i modulo nodes to a place 97 further for each lane; of the given slots, else of the first ``count``."""
    i = F.col("slot")
    lane = F.floor(i / nodes) + 1
    rows = spark.range(count).select(F.col("id").alias("slot")) if slots is None else slots.select("slot")
    return rows.select(i, (i + 1).alias("id"), (i % nodes).alias("source"), ((i % nodes + lane * 97) % nodes).alias("target"), (lane % 4).cast("int").alias("kind"))


def _unit(seed: int, salt: str) -> Column:
    """A number from 0 to 1 that a row's id and a seed fix, whatever the partitioning."""
    return F.xxhash64("id", F.lit(seed), F.lit(salt)).cast("double") / 2.0**64 + 0.5


# Nodes of a group and the least number of groups, by topology.
GROUPS = {"clustered": (250, 3), "hubs": (500, 1), "communities": (200, 2)}
TOPOLOGIES = ("uniform", "clustered", "hubs", "chain", "communities")


def groups_of(topology: str, count: int) -> int:
    size, least = GROUPS[topology]
    return max(1, min(max(count // size, least), count))


def random_nodes(spark: SparkSession, topology: str, count: int, seed: int = 42, ids: DataFrame | None = None) -> DataFrame:
    """Nodes (id, x, y, z, radius, color, kind) of a topology; numbers are fixed by id and seed. ``ids`` may name a table's own, from 1 to ``count``.

    Uniform: a box of 5 times the root of the count, flat in z. Clustered: boxes
    of 5 to 40 around centres within 8 times the root. Hubs: centres of radius 8
    and kind 1 on a circle of 150, the others at 10 to 120 from theirs. Chain: a
    closed formula. Communities: boxes of 40 on a circle of 6 times the root.
    """
    if topology not in TOPOLOGIES:
        raise ValueError(f"unknown topology {topology}")
    rows = spark.range(1, count + 1) if ids is None else ids.select("id")
    side = math.sqrt(max(count, 1))
    i = F.col("id") - 1
    between = lambda salt, low, high: _unit(seed, salt) * (high - low) + low
    spread = lambda salt, size: (_unit(seed, salt) * 2 - 1) * size
    number = lambda value: F.lit(float(value))
    if topology == "uniform":
        place = [spread("x", 5 * side), spread("y", 5 * side), spread("z", side)]
        radius, kind = between("radius", 1.0, 3.5), F.lit(0)
        color = [between("red", 0.2, 0.9), between("green", 0.3, 0.95), between("blue", 0.5, 1.0)]
    elif topology == "chain":
        place = [i * 8.0 - 4.0 * count, F.sin(i * 0.1) * 50.0, F.cos(i * 0.15) * 20.0]
        radius, kind, color = number(2), F.lit(0), [number(0.2), number(0.8), number(0.6)]
    else:
        groups = groups_of(topology, count)
        group = i % groups
        angle, hue = group * (2 * math.pi / groups), group / groups
        kind = group
        if topology == "clustered":
            center = lambda salt, size: (F.xxhash64(group, F.lit(seed), F.lit(salt)).cast("double") / 2.0**64 * 2) * size
            reach = between("reach", 5.0, 40.0)
            place = [center(f"c{a}", 8 * side * flat) + (_unit(seed, a) * 2 - 1) * reach * share for a, flat, share in (("x", 1, 1), ("y", 1, 1), ("z", 0.1, 0.3))]
            radius, color = between("radius", 1.2, 3.0), [hue * 0.8 + 0.1, 1.0 - hue * 0.5, hue * 0.9 + 0.1]
        elif topology == "communities":
            place = [F.cos(angle) * (6 * side) + spread("x", 40.0), F.sin(angle) * (6 * side) + spread("y", 40.0), spread("z", 15.0)]
            radius, color = between("radius", 1.5, 3.2), [hue, number(0.7), 1.0 - hue]
        else:
            hub = i < groups
            away, turn = between("away", 10.0, 120.0), _unit(seed, "turn") * (2 * math.pi)
            from_hub = lambda offset: F.when(hub, 0.0).otherwise(offset)
            place = [F.cos(angle) * 150.0 + from_hub(F.cos(turn) * away), F.sin(angle) * 150.0 + from_hub(F.sin(turn) * away), from_hub(spread("z", 10.0))]
            radius, kind = F.when(hub, 8.0).otherwise(between("radius", 1.0, 2.5)), F.when(hub, 1).otherwise(0)
            color = [F.when(hub, h).otherwise(o) for h, o in ((1.0, 0.3), (0.3, 0.7), (0.2, 0.9))]
    shade = F.array(*(c.cast("double") for c in color), number(1)).alias("color")
    return rows.select("id", *(p.cast("double").alias(a) for p, a in zip(place, "xyz")), radius.cast("double").alias("radius"), shade, kind.cast("int").alias("kind"))


def topology_edges(spark: SparkSession, topology: str, count: int, ids: DataFrame | None = None) -> DataFrame:
    """Edges (id, source, target) that a topology itself has: hub to spoke, or each link of a chain."""
    rows = spark.range(1, count + 1) if ids is None else ids.select("id")
    if topology == "hubs" and count:
        hubs = groups_of(topology, count)
        return rows.where(F.col("id") <= count - hubs).select("id", ((F.col("id") + hubs - 1) % hubs + 1).alias("source"), (F.col("id") + hubs).alias("target"))
    if topology == "chain":
        return rows.where(F.col("id") < count).select("id", F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    return spark.range(0).select("id", F.col("id").alias("source"), F.col("id").alias("target"))


def random_edges(spark: SparkSession, nodes: int, requested: int, seed: int = 42) -> DataFrame:
    """Distinct directed pairs without self loops, at most nodes * (nodes - 1) of them.

    Pair numbers are drawn from a permutation of all pairs (an affine map modulo
    a prime beyond their number), so they are distinct without being compared.
    """
    pairs = nodes * (nodes - 1)
    wanted = min(requested, max(pairs, 0))
    if wanted <= 0:
        return spark.range(0).select("id", F.col("id").alias("source"), F.col("id").alias("target"))
    prime = next(p for p in range(max(pairs, 2), 2 * max(pairs, 2) + 2) if all(p % q for q in range(2, math.isqrt(p) + 1)))
    factor, shift = seed * 2_654_435_761 % (prime - 1) + 1, seed * 40_503 % prime
    draw = ((F.col("id").cast("decimal(38,0)") * factor + shift) % prime).cast("bigint")
    # the ids that draw no pair are as few as the gap below the prime; each moves the last id on by one
    back = pow(factor, -1, prime)
    last = wanted
    for unused in sorted((number - shift) * back % prime for number in range(pairs, prime)):
        last += unused < last
    kept = spark.range(0, last, 1, _parts(last)).select("id", draw.alias("pair")).where(F.col("pair") < pairs)
    source = F.expr(f"pair div {max(nodes - 1, 1)}")
    other = F.col("pair") % max(nodes - 1, 1)
    return kept.select("id", (source + 1).alias("source"), (F.when(other >= source, other + 1).otherwise(other) + 1).alias("target"))


def _parts(rows: int) -> int:
    """Tasks that make so many rows, each a bounded number of them."""
    return max(1, -(-rows // TASK_ROWS))


def _least(rows: DataFrame, key: str, wanted: int) -> DataFrame:
    """The ``wanted`` rows with the smallest ``key`` (evenly spread bigints), then ids.

    Rows are counted by the key's first bits; only the range in which the last
    wanted row lies is sorted.
    """
    place = F.call_function("shiftright", F.col(key), F.lit(64 - KEY_BITS))
    before = 0
    for r in sorted(rows.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()):  # 2 to the KEY_BITS at most
        if before + r.n >= wanted:
            last = rows.where(place == r.place).orderBy(key, "id").limit(wanted - before)
            return rows.where(place < r.place).unionByName(last)
        before += r.n
    return rows


def jitter(nodes: DataFrame, ratio: float, revision: int, seed: int = 42) -> DataFrame:
    """An update lane of a share of the live nodes, rounded up and at least one: x and y move by up to 1.5, red by up to 0.04."""
    count = nodes.count()
    wanted = max(min(math.ceil(count * ratio), count), min(count, 1))
    pick = F.xxhash64("id", F.lit(seed + revision), F.lit("pick"))
    moved = _least(nodes.withColumn("_pick", pick), "_pick", wanted).drop("_pick")
    by = lambda salt, size: (_unit(seed + revision, salt) * 2 - 1) * size
    rows = moved.withColumns({"x": F.col("x") + by("x", 1.5), "y": F.col("y") + by("y", 1.5)})
    if "color" in nodes.columns:
        red = F.least(F.greatest(F.element_at("color", 1) + by("red", 0.04), F.lit(0.05)), F.lit(1.0))
        rows = rows.withColumn("color", F.concat(F.array(red), F.slice("color", 2, 3)))
    return rows.select(F.lit(revision).cast("bigint").alias("revision"), F.lit("update").alias("op"), *nodes.columns)


# The five layouts' coordinates x, y, z of node i.
LAYOUTS = {
    "hybrid": ("i % 100 - 49.5D", "i div 100 % 100 - 49.5D", "i * 37 % 211 * 0.025D - 2.625D"),
    "hopf": (
        "(34D + i div 100 % 8 * 1.4D + (4D + i % 11 * 0.12D) * cos(i * 0.017453292D * 7 + i % 100 * 0.031D)) * cos(i * 0.017453292D)",
        "(34D + i div 100 % 8 * 1.4D + (4D + i % 11 * 0.12D) * cos(i * 0.017453292D * 7 + i % 100 * 0.031D)) * sin(i * 0.017453292D)",
        "(4D + i % 11 * 0.12D) * sin(i * 0.017453292D * 7 + i % 100 * 0.031D)",
    ),
    "caps": (
        "cos(i % 16 * (pi() / 8)) * 32D + cos(i * 0.017453292D) * (18D + i % 97 * 0.08D)",
        "sin(i % 16 * (pi() / 8)) * 32D + sin(i * 0.017453292D) * (18D + i % 97 * 0.08D)",
        "i div 16 % 80 * 0.18D - 7.2D",
    ),
    "transit": ("(i % 100 - 49.5D) * 1.35D", "(i % 12 - 5.5D) * 5.5D + sin(i * 0.017453292D * 3) * 0.8D", "(i div 100 % 100 - 49.5D) * 0.22D"),
    "siegel": ("sqrt(i) * 0.45D * cos(i * 0.017453292D)", "sqrt(i) * 0.45D * sin(i * 0.017453292D)", "(i % 257 - 128D) * 0.035D"),
}


def cohort_layout(nodes: DataFrame, manifold: str) -> DataFrame:
    """(slot, x, y, z) of a closed-form layout over slots."""
    if manifold not in LAYOUTS:
        raise ValueError(f"unknown manifold {manifold}")
    rows = nodes.select("slot", F.col("slot").alias("i"))
    return rows.select("slot", *(F.expr(f"cast({formula} as double)").alias(a) for a, formula in zip("xyz", LAYOUTS[manifold])))


def guide_strokes(spark: SparkSession, level: int, strokes: int = 8, points: int = 65) -> DataFrame:
    """Circles as (stroke, points): closed strokes of evenly spaced points; ``level`` is the layout's number."""
    angle = lambda k: k * F.lit(2 * math.pi / (points - 1))
    radius = F.col("stroke") * 5.5 + 10.0
    ring = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda k: F.struct((F.cos(angle(k)) * radius).alias("x"), (F.sin(angle(k)) * radius).alias("y"), F.lit(level * 0.25).alias("z")),
    )
    return spark.range(strokes).select(F.col("id").alias("stroke")).select("stroke", ring.alias("points"))


def stable_position(entity: Column) -> Column:
    """Coordinates from -18 to 18 that an id fixes, from the digest of the id."""
    digest = F.sha2(entity.cast("string").cast("binary"), 256)
    unit = lambda k: F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("double") / F.lit(4294967295.0) * 2.0 - 1.0
    return F.struct(*((unit(k) * 18.0).alias(a) for k, a in enumerate("xyz")))
