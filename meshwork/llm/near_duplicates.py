"""N-gram Jaccard join by count vectors: exact links between whole texts.

A text's set is its distinct word shingles, as 64-bit hashes; equal sets form a
class. Classes meet in three steps, none of which can lose a link:

1. *Candidates.* Shingles are hashed into G groups. A pair over the threshold
   differs in at most d shingles, so at least G - d groups are the same in both;
   G is chosen by size band so that this exceeds the groups that are empty by
   chance. Each class is keyed by (band, group, sum of the group's hashes).
   Classes that meet under a key are compared by their vectors of group counts
   (about ``PER_COORDINATE`` shingles a coordinate): a summed minimum of
   coordinates bounds the overlap from above. First each class is held against
   the key's centre; keys where that fails go through an R-tree of their
   classes. What survives gives edges, their components are blocks.
2. *Leaves.* A block is dealt into leaves of bounded size. In a leaf, a vector
   of group counts is a point of an R-tree: nodes hold the coordinate-wise
   maxima, and a summed minimum of coordinates bounds the overlap from above.
   Pairs that survive and are not yet in one component are compared exactly.
3. *Between leaves.* A block of several leaves shares a pivot class; what does
   not join the block's largest component is dealt into tiles of bounded size,
   and every tile visits every leaf.

Hot keys (passages that very many texts share) are found on a sample of classes;
they are aggregated map-side and joined back by broadcast, so their rows are
never shuffled to one task. The sample decides only which of two equal plans a
key takes. Under a key of more than ``LEAF_CLASSES`` classes only those stay
that have so many such keys that a link might show under nothing else.

Links are found up to components: two texts are compared only until they are
known to be connected. Rows with no words have an empty set and no link.

Defined results: null and empty texts have 0 shingles and are their own
component; fewer words than a shingle make one shingle of all words; repeated
rows and equal texts share a component; a component's id is the smallest doc_id
that is not null (a row whose component has none gets null); an empty table
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, map_batches, read_table, skewed_join, written

#: Shingles a coordinate of a count vector; unrelated sets of this density overlap by some 80 % at most.
PER_COORDINATE = 8
LEAST_COORDINATES = 64
NODE = 64
LEAF_SHINGLES = 1_000_000
LEAF_CLASSES = 4_096
#: Up to this many rows (of some 60 bytes) the candidates' ids are broadcast to the texts; beyond, texts are shuffled.
BROADCAST_ROWS = 400_000
#: A key is hot with more than one in so many of all keyed rows: there are never more hot keys than this.
HOT_SHARE = 20_000
#: Sampled rows of a key at that share.
HOT_SAMPLED = 50
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    return (x ^ (x >> np.uint64(27))) * _MIX


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; A-Z lower-cased, words part at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(hashes) - size + 1
    joined = hashes[:n]
    for k in range(1, size):
        joined = _mixed(joined + _MIX) + hashes[k : k + n]
    joined = _mixed(joined)
    joined.sort()
    return joined[np.concatenate(([True], joined[1:] != joined[:-1]))]


@dataclass
class Threshold:
    """Sets of word shingles link when overlap / union >= numerator / denominator."""

    size: int = 5
    numerator: int = 80
    denominator: int = 100

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.denominator * both >= self.numerator * (a + b - both)

    def least_overlap(self, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
        """Smallest overlap of linked sets of a and b shingles."""
        total = self.denominator + self.numerator
        return -(-(self.numerator * (a + b)) // total)

    @cached_property
    def bounds(self) -> list[int]:
        """Lower ends of the size bands. A wider band has fewer sets in two bands, but smaller groups."""
        ratio = 1 + 2.5 * (self.denominator - self.numerator) / self.numerator
        found = [1]
        while found[-1] < 1 << 40:
            found.append(max(found[-1] + 1, int(found[-1] * ratio)))
        return found

    @cached_property
    def _groups(self) -> dict[int, int]:
        return {}

    def groups(self, band: int) -> int:
        """Groups of a band: the fewest that leave its smallest sets more groups with shingles than can differ."""
        if band not in self._groups:
            low, d = self.bounds[band], self.differing(band)
            g, most = d + 4, max(d + 4, 4 * low)
            while g < most:
                empty = g * np.exp(-low / g)
                spread = np.sqrt(max(0.0, empty * (1 - (1 + low / g) * np.exp(-low / g))))
                if g - empty - 3 * spread >= d + 2:
                    break
                g += 1 + g // 50
            self._groups[band] = min(g, most)
        return self._groups[band]

    def differing(self, band: int) -> int:
        """How many shingles may be in one only of two linked sets, the smaller of which is of this band."""
        return (self.bounds[band + 1] - 1) * (self.denominator - self.numerator) // self.numerator

    def bands(self, n: int) -> list[int]:
        """Bands under which a set of n shingles is keyed: its own, and lower ones with sizes it can link to."""
        found = []
        for band in range(bisect_right(self.bounds, n) - 1, -1, -1):
            most = self.bounds[band + 1] - 1
            if n > most and n * self.numerator > most * self.denominator:
                break
            # sizes a <= most and b <= a * denominator / numerator
            found.append(band)
        return found

    def keys(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and with each how many keys of its band any linked set must share."""
        found, spares = [], []
        for band in self.bands(len(s)):
            groups, d = self.groups(band), self.differing(band)
            group = ((s >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            group, ordered = group[order], s[order]
            starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            sums = np.add.reduceat(_mixed(ordered), starts)
            tags = (np.uint64(band) << np.uint64(40)) + group[starts].astype(np.uint64)
            if len(starts) <= d:
                # so many groups are empty that only empty ones may be shared
                empty = np.setdiff1d(np.arange(groups), group[starts]).astype(np.uint64)
                sums = np.concatenate((sums, np.zeros(len(empty), dtype=np.uint64)))
                tags = np.concatenate((tags, (np.uint64(band) << np.uint64(40)) + empty))
            found.append(_mixed(sums + _mixed(tags + _MIX)))
            spares.append(np.full(len(tags), len(tags) - d, dtype=np.int32))
        return np.concatenate(found), np.concatenate(spares)


def _class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def coordinates(n: int) -> int:
    """Coordinates of a count vector of n shingles: a power of two, so that longer vectors fold into shorter ones."""
    return max(LEAST_COORDINATES, 1 << (-(-n // PER_COORDINATE) - 1).bit_length())


def count_vector(s: np.ndarray, groups: int, kind: type = np.int32) -> np.ndarray:
    """How many of the shingles fall into each group, up to the largest number of ``kind``."""
    counts = np.bincount((s >> np.uint64(20)).astype(np.int64) % groups, minlength=groups)
    return np.minimum(counts, np.iinfo(kind).max).astype(kind)


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Count vectors over fewer groups; rows with a full byte hold no bound and become as large as can be."""
    full = (points == 255).any(-1)
    out = points.reshape(len(points), -1, groups).sum(1, dtype=np.int32)
    out[full] = 1 << 20
    return out


def overlap_bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper bounds of overlaps by summed coordinate minima."""
    return np.minimum(x, y).sum(-1, dtype=np.int64)


class CountTree:
    """R-tree over group-count vectors: leaves of ``NODE`` points in order of size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, threshold: Threshold):
        self.threshold = threshold
        self.points = points
        self.sizes = sizes
        self.order = np.argsort(self.sizes, kind="stable")
        starts = np.arange(0, len(points), NODE)
        self.most = np.maximum.reduceat(self.points[self.order], starts, axis=0)
        self.low = np.minimum.reduceat(self.sizes[self.order], starts)
        self.high = np.maximum.reduceat(self.sizes[self.order], starts)

    def near(self, point: np.ndarray, size: int, free: np.ndarray) -> np.ndarray:
        """Indices among the ``free`` ones whose bound allows a link to the point."""
        t = self.threshold
        fits = (self.low * t.numerator <= size * t.denominator) & (size * t.numerator <= self.high * t.denominator)
        fits &= overlap_bound(self.most, point) >= t.least_overlap(size, self.low)
        nodes = np.flatnonzero(fits)
        if not len(nodes):
            return nodes
        at = (nodes[:, None] * NODE + np.arange(NODE)).ravel()
        found = self.order[at[at < len(self.order)]]
        found = found[free[found]]
        return found[overlap_bound(self.points[found], point) >= t.least_overlap(size, self.sizes[found])]


def leaf_components(sets: list[np.ndarray], threshold: Threshold, known: np.ndarray | None = None, ask: np.ndarray | None = None) -> np.ndarray:
    """Component label (an index) of every set. ``known``: labels to start from; ``ask``: these sets search all others."""
    label = np.arange(len(sets)) if known is None else known.copy()
    if len(sets) < 2:
        return label
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    groups = coordinates(int(np.median(sizes)))
    tree = CountTree(np.array([count_vector(s, groups) for s in sets]), sizes, threshold)
    distinct, dense = np.unique(np.concatenate(sets), return_inverse=True)
    dense = dense.astype(np.int32)
    offsets = np.concatenate(([0], np.cumsum(tree.sizes)))
    flags = np.zeros(len(distinct), dtype=bool)
    del distinct
    for i in range(len(sets)) if ask is None else np.flatnonzero(ask):
        free = label != label[i]
        if ask is not None:
            free &= ~ask
        if not free.any():
            continue
        found = tree.near(tree.points[i], int(tree.sizes[i]), free)
        if not len(found):
            continue
        own = dense[offsets[i] : offsets[i + 1]]
        flags[own] = True
        # a few are compared one by one, until one is linked and others become known with it; many in one sweep
        shared = np.add.reduceat(flags[dense], offsets[:-1], dtype=np.int64)[found] if len(found) > 100 else None
        for k, j in enumerate(found):
            if label[j] != label[i]:
                both = int(np.count_nonzero(flags[dense[offsets[j] : offsets[j + 1]]])) if shared is None else int(shared[k])
                if threshold.linked(both, len(own), int(tree.sizes[j])):
                    a, b = sorted((label[i], label[j]))
                    label[label == b] = a
        flags[own] = False
    return label


def bound_components(points: np.ndarray, sizes: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Component labels of count vectors whose bound allows a link."""
    label = np.arange(len(points))
    tree = CountTree(points, sizes, threshold) if len(points) > NODE else None
    if tree is None:
        fits = overlap_bound(points[:, None], points[None]) >= threshold.least_overlap(sizes[:, None], sizes[None])
    for i in range(len(points)):
        free = label != label[i]
        for j in np.flatnonzero(fits[i] & free) if tree is None else tree.near(points[i], int(tree.sizes[i]), free):
            if label[j] != label[i]:
                a, b = sorted((label[i], label[j]))
                label[label == b] = a
    return label


SIZED_SCHEMA = (
    "doc_id bigint, text_key bigint, n_shingles bigint, class bigint, vector binary, keys array<struct<key: bigint, spare: int>>"
)


def _sized(docs: DataFrame, threshold: Threshold) -> DataFrame:
    """Size and class of every row; vector and keys with the first row of a class that a task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, owners, vectors = [], [], []
                keys, spares, ends = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int32)], [0]
                for text in part.column(2).to_pylist():
                    s = shingles(text, threshold.size)
                    owner = _class_of(s) if len(s) else None
                    sizes.append(len(s))
                    owners.append(owner)
                    if owner is None or owner in seen:
                        vectors.append(None)
                        ends.append(ends[-1])
                        continue
                    seen.add(owner)
                    vectors.append(count_vector(s, coordinates(len(s)), np.uint8).tobytes())
                    found, spare = threshold.keys(s)
                    keys.append(found)
                    spares.append(spare)
                    ends.append(ends[-1] + len(found))
                pairs = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(spares))], names=["key", "spare"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(sizes, pa.int64()),
                        pa.array(owners, pa.int64()),
                        pa.array(vectors, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "class", "vector", "keys"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string")), F.col("text").cast("string"))
    return map_batches(rows, run, SIZED_SCHEMA)


def near_duplicates(docs: DataFrame, threshold: Threshold = Threshold()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    sized = written(_sized(docs, threshold), "sized")
    # Step 1: edges between classes that share a key and whose count vectors allow a link, then blocks.
    stars, edges = _survivors(sized, threshold)
    blocks = components(edges, "blocks")
    blocks = blocks.select(F.col("node").alias("class"), F.col("component").alias("block"))

    # Step 2: one row per class, its leaf, and its text.
    classes = sized.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), F.max("n_shingles").alias("n_shingles")
    )
    members = classes.join(blocks, "class")
    leaves = members.groupBy("block").agg(
        F.greatest(F.ceil(F.sum("n_shingles") / LEAF_SHINGLES), F.ceil(F.count("*") / LEAF_CLASSES)).alias("leaves")
    )
    members = written(members.join(leaves, "block"), "members")
    texts = written(_texts(docs, members.select("text_key").distinct()), "member-texts")
    degree = stars.groupBy("center").agg(F.count("*").alias("degree")).withColumnRenamed("center", "class")
    pivots = members.where("leaves > 1").join(degree, "class").groupBy("block").agg(F.max_by("class", F.struct("degree", "class")).alias("pivot"))
    home = F.pmod(F.xxhash64("class"), F.col("leaves"))
    everywhere = F.sequence(F.lit(0).cast("bigint"), F.col("leaves") - 1)
    placed = members.join(pivots, "block", "left").select(
        "class",
        "block",
        "text_key",
        F.explode(F.when(F.col("class") == F.col("pivot"), everywhere).otherwise(F.array(home))).alias("leaf"),
        F.lit(0).cast("bigint").alias("tile"),
        F.col("class").alias("part"),
        F.lit(None).cast("boolean").alias("visits"),
    )
    inside = written(_leaf_links(placed.join(texts, "text_key"), threshold), "inside")

    # Step 3: what is outside the largest component of a block of several leaves visits the others, in tiles.
    several = members.where("leaves > 1")
    links = inside
    if several.limit(1).count():
        parts = components(inside.select(F.col("class").alias("a"), F.col("to").alias("b")), "parts")
        several = several.join(parts.withColumnRenamed("node", "class"), "class", "left")
        several = several.withColumn("part", F.coalesce("component", F.col("class"))).drop("component")
        sizes = several.groupBy("block", "part").count().groupBy("block").agg(F.max_by("part", F.struct("count", "part")).alias("largest"))
        several = written(several.join(sizes, "block").withColumn("home", home), "several")
        visitors = several.where("part <> largest")
        tiles = visitors.groupBy("block").agg(
            F.greatest(F.ceil(F.sum("n_shingles") / LEAF_SHINGLES), F.ceil(F.count("*") / LEAF_CLASSES)).alias("tiles")
        )
        visiting = visitors.join(tiles, "block").withColumn("tile", F.pmod(F.xxhash64("class", F.lit(1)), F.col("tiles")))
        visiting = visiting.withColumn("leaf", F.explode(everywhere)).where("leaf <> home").withColumn("visits", F.lit(True))
        at_home = several.join(tiles, "block").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
        at_home = at_home.withColumn("leaf", F.col("home")).withColumn("visits", F.lit(False))
        both = visiting.unionByName(at_home).select("class", "block", "text_key", "leaf", "tile", "part", "visits")
        links = links.unionByName(_leaf_links(both.join(texts, "text_key"), threshold))
    linked = components(links.select(F.col("class").alias("a"), F.col("to").alias("b")), "linked")
    linked = linked.select(F.col("node").alias("class"), F.col("component").alias("part"))
    named = classes.join(linked, "class", "left").withColumn("part", F.coalesce("part", "class"))
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    named = named.join(least, "part").select("class", "component_id")
    return skewed_join(sized.select("doc_id", "n_shingles", "class"), named, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text for each wanted text_key; repeated texts are one before they are shuffled."""
    texts = docs.select(F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    small = wanted.count() <= BROADCAST_ROWS
    return texts.join(F.broadcast(wanted) if small else wanted, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))


def _vectors(vectors: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v, dtype=np.uint8) for v in vectors.to_pylist()]


def _pair_bounds(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Upper bounds of the overlap of each pair of count vectors, at the shorter one's coordinates."""
    out = np.zeros(len(left), dtype=np.int64)
    shapes: dict[tuple[int, int], list[int]] = {}
    for k, (x, y) in enumerate(zip(left, right)):
        shapes.setdefault((len(x), len(y)), []).append(k)
    for shape, at in shapes.items():
        groups = min(shape)
        step = max(1, (1 << 22) // max(shape))
        for start in range(0, len(at), step):
            some = at[start : start + step]
            out[some] = overlap_bound(folded(np.array([left[k] for k in some]), groups), folded(np.array([right[k] for k in some]), groups))
    return out


def _met(sized: DataFrame) -> DataFrame:
    """(key, class, spare, center, m): classes that share a key with others, its smallest class, and how many they are."""
    keyed = sized.where(F.size("keys") > 0).select("class", F.inline("keys"))
    rows = sized.agg(F.sum(F.size("keys"))).first()[0] or 0
    every = max(1, rows // (HOT_SHARE * HOT_SAMPLED))
    sample = keyed.where(F.pmod(F.xxhash64("class"), F.lit(every)) == 0)
    hot = sample.groupBy("key").count().where(F.col("count") >= max(HOT_SAMPLED // 2, 1)).select("key")
    hot = written(hot, "hot-keys")
    # one task may see a class that another has seen: a class counts once, by its extremes
    grouped = keyed.join(F.broadcast(hot), "key").groupBy("key").agg(
        F.min("class").alias("center"), F.max("class").alias("last"), F.count("*").alias("m")
    )
    grouped = written(grouped.where("center <> last").drop("last"), "hot-centers")
    columns = ["key", "class", "spare", "center", "m"]
    warm = keyed.join(F.broadcast(grouped), "key").select(*columns)
    by_key = Window.partitionBy("key")
    cold = keyed.join(F.broadcast(hot), "key", "left_anti").select(
        "key", "class", "spare", F.min("class").over(by_key).alias("center"), F.max("class").over(by_key).alias("last"), F.count("*").over(by_key).alias("m")
    )
    return written(cold.where("center <> last").select(*columns).unionByName(warm), "met")


def _needed(met: DataFrame) -> DataFrame:
    """``met`` without the crowded keys of classes whose links must all show under other keys too.

    A linked set shares at least ``spare`` keys of the band, so a class with
    fewer crowded keys than that shares one that is not crowded.
    """
    crowded = met.where(F.col("m") > LEAF_CLASSES)
    if not crowded.limit(1).count():
        return met
    enough = crowded.groupBy("class", "spare").agg(F.count_distinct("key").alias("n")).where("n >= spare").select("class", "spare")
    kept = crowded.join(enough, ["class", "spare"], "left_semi")
    return written(met.where(F.col("m") <= LEAF_CLASSES).unionByName(kept), "needed")


def _survivors(sized: DataFrame, threshold: Threshold) -> tuple[DataFrame, DataFrame]:
    """(class, center) of all that meet a centre and may link to it, and (a, b) edges whose components hold all links."""
    met = _needed(_met(sized))
    vectors = sized.where(F.col("vector").isNotNull()).groupBy("class").agg(F.first("vector").alias("vector"), F.first("n_shingles").alias("n"))
    stars = met.where(F.col("class") != F.col("center")).select("class", "center").distinct()
    pairs = written(stars.join(vectors, "class"), "stars")
    centers = vectors.select(F.col("class").alias("center"), F.col("vector").alias("other"), F.col("n").alias("n_other"))
    pairs = skewed_join(pairs, centers, "center")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
                fits = _pair_bounds(_vectors(batch.column(2)), _vectors(batch.column(3))) >= threshold.least_overlap(*sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fits)], names=["class", "center", "fits"])

    judged = written(map_batches(pairs.select("class", "center", "vector", "other", "n", "n_other"), bound, "class bigint, center bigint, fits boolean"), "judged")
    good = judged.where("fits").select("class", "center")
    edges = good.select(F.col("class").alias("a"), F.col("center").alias("b"))
    bad = judged.where("not fits").select("class", "center")
    n_bad = bad.count()
    if not n_bad:
        return good, edges
    # keys whose classes do not all fit their centre: an R-tree of each
    bad_keys = met.join(F.broadcast(bad) if n_bad <= BROADCAST_ROWS else bad, ["class", "center"], "left_semi").select("key").distinct()
    bad_keys = written(bad_keys, "bad-keys")
    crowded = met.join(F.broadcast(bad_keys) if bad_keys.count() <= BROADCAST_ROWS else bad_keys, "key", "left_semi")
    # keys under which the same classes meet are one
    sets = crowded.groupBy("key", "center").agg(F.max("m").alias("m"), F.count("*").alias("rows"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("same"))
    one = written(sets.groupBy("center", "m", "rows", "same").agg(F.min("key").alias("key")).select("key", "rows"), "one")
    crowded = written(crowded.drop("m").join(F.broadcast(one) if one.count() <= BROADCAST_ROWS else one, "key"), "crowded")
    # What is left under a key beyond a leaf's size consists of little else than what the key's classes share: one block.
    joined = crowded.where(F.col("rows") > LEAF_CLASSES).where("class <> center")
    edges = edges.unionByName(joined.select(F.col("class").alias("a"), F.col("center").alias("b")).distinct())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a key's classes are linked once its last row has come."""
        key, owners, points, sizes = None, [], [], []
        left, right = [], []

        def link() -> None:
            if len(owners) > 1:
                groups = min(map(len, points))
                same = np.concatenate([folded(p[None], groups) for p in points])
                label = bound_components(same, np.array(sizes, dtype=np.int64), threshold)
                for k in np.flatnonzero(label != np.arange(len(label))):
                    left.append(owners[k])
                    right.append(owners[label[k]])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (0, 1, 3))
            for (k, owner, size), point in zip(zip(*columns), _vectors(batch.column(2))):
                if k != key:
                    link()
                    key, owners, points, sizes = k, [], [], []
                owners.append(owner)
                points.append(point)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
            left.clear()
            right.clear()
        link()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    few = crowded.where(F.col("rows") <= LEAF_CLASSES).join(vectors, "class").select("key", "class", "vector", "n")
    few = few.repartition("key").sortWithinPartitions("key")
    return good, edges.unionByName(map_batches(few, search, "a bigint, b bigint").distinct())


def _leaf_links(rows: DataFrame, threshold: Threshold) -> DataFrame:
    """(class, to): edges that span the linked components of each leaf.

    ``part`` names what is linked already. Where ``visits`` is set, visitors
    search the others only: these have met inside their leaf.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t, threshold.size) for t in pdf["text"]]
        owners = pdf["class"].to_numpy(dtype=np.int64)
        right = np.array([len(s) > 0 and _class_of(s) == c for s, c in zip(sets, owners)])
        _, firsts = np.unique(np.where(right, owners, 0), return_index=True)
        keep = np.array([i for i in firsts if right[i]], dtype=np.int64)
        if len(keep) < 2:
            return pd.DataFrame(np.zeros((0, 2), dtype=np.int64), columns=["class", "to"])
        owners, parts = owners[keep], pdf["part"].to_numpy(dtype=np.int64)[keep]
        visits = None if pdf["visits"].isna().all() else pdf["visits"].to_numpy(dtype=bool)[keep]
        _, first_of, known = np.unique(parts, return_index=True, return_inverse=True)
        label = leaf_components([sets[i] for i in keep], threshold, known, visits)
        # an edge from each part that moved to the part that it joined
        moved = [(int(owners[i]), int(owners[first_of[label[i]]])) for k, i in enumerate(first_of) if label[i] != k]
        return pd.DataFrame(np.array(moved, dtype=np.int64).reshape(-1, 2), columns=["class", "to"])

    columns = ["block", "leaf", "tile", "class", "part", "visits", "text"]
    return rows.select(*columns).groupBy("block", "leaf", "tile").applyInPandas(run, "class bigint, to bigint")


#: The contract's links: three words, 90 %.
CONTRACT = Threshold(3, 90, 100)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), CONTRACT)
