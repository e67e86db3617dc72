"""Prefix trie of conversations by Patricia construction over sorted sequences.

A conversation is the sequence of its turns (role, text). Turns are named by 128 bits
of SHA-256, so a conversation is a key of 16 bytes a turn, and texts never move.

1. Equal keys become one, with the number of conversations, the smallest id and the
   digest of all ids. Ids are joined to pieces within sorted ranges, so that the one task
   that digests the ids of a common conversation gets few rows; it streams them.
2. Distinct keys are dealt by sampled splitters to ranges of at most ``HEAD_TURNS``
   turns' depth and sorted. A task reads its range as a stream: the stack holds the
   points of the path to the last key, and the common length with the next key says
   which points are complete and where a branch is made. Only branches, ends and leaves
   become points; unary nodes lie on edges.
3. Sums go up the compressed tree as points are completed. A node of an edge adds what
   its point knows: sums of the edge's end give all nodes on it.
4. Nodes on a path that goes on in the next range are given one by one as partial
   sums and added up; there are fewer than 2 ``HEAD_TURNS`` of them a range. A node is
   counted as a child, and once as a text, by the range in which it begins.
5. Each edge finds the point above it by that prefix's digest, and is spread to its
   unary nodes.

Defined results: rows without conv_id belong to no conversation. Turns are in order
of turn, null first; rows of one turn are ordered by their 128-bit name. Null roles and
texts are empty. Repeated rows are turns of their own; conversations may hold no turn and
are members of the root then. Texts of any length are hashed whole. An empty
table gives no nodes. Columns other than conv_id, turn, role and text are not read.
A conversation's key meets in one row, as its turns make one sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, read_table, skewed_join, written

TURN_BYTES = 16
#: Turns of a key that splitters see; ranges differ within these, so no shared path is longer.
HEAD_TURNS = 64
#: Ids in one piece of a digest, and rows of one batch.
PIECE_IDS = 4_096
BATCH_ROWS = 2_000
NO_IDS = hashlib.sha256(b"").hexdigest()
_UNIT = "fp binary, parent_fp binary, top int, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved array<bigint>, ends string"


def turn_name(role: Column, text: Column) -> Column:
    """128 bits of SHA-256 of a turn as hex digits; the role's length keeps role and text apart."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * TURN_BYTES)


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, steps): names and UTF-8 bytes of each conversation's turns in order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("placed"), F.coalesce("turn", F.lit(0)).alias("turn"), turn_name(role, text).alias("name"), F.octet_length(text).cast("bigint").alias("size")).alias("t"),
    )
    steps = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["name"].alias("name"), t["size"].alias("size")))
    return turns.groupBy("conv_id").agg(steps.alias("steps"))


def rebuilt(rows: DataFrame, family: int = 5, most_shared: int = 8) -> DataFrame:
    """Sequences that begin with up to ``most_shared`` turns of their family's first conversation, and go on with their own."""
    own = written(sequences(rows), "sequences")
    heads = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("steps", 1, most_shared).alias("head"))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(heads, "base", "left")
    taken = crc_mod(F.col("conv_id"), most_shared + 1).cast("int")
    begun = F.coalesce(F.slice("head", F.lit(1), taken), F.slice("steps", 1, 0))
    return joined.select("conv_id", F.concat(begun, F.slice("steps", taken + 1, F.size("steps"))).alias("steps"))


def _by_key(steps: DataFrame) -> DataFrame:
    """conv_id, key, its digest and the sizes of its turns."""
    key = F.unhex(F.array_join(F.transform("steps", lambda s: s["name"]), ""))
    keyed = steps.select("conv_id", key.alias("key"), F.transform("steps", lambda s: s["size"]).alias("sizes"))
    return keyed.withColumn("fp", F.unhex(F.substring(F.sha2("key", 256), 1, 2 * TURN_BYTES)))


def _distinct(keyed: DataFrame) -> DataFrame:
    """Each key once: key, sizes, the smallest conv_id, n and the digest of its ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, ids, out = None, [], []
        for batch in batches:
            for one, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (one != fp or len(ids) >= PIECE_IDS):
                    out.append((fp, ids[0], len(ids), ",".join(map(str, ids))))
                    ids = []
                fp = one
                ids.append(conv)
            yield _batch(out, "fp binary, conv_id bigint, n bigint, ids string")
            out = []
        if ids:
            yield _batch([(fp, ids[0], len(ids), ",".join(map(str, ids)))], "fp binary, conv_id bigint, n bigint, ids string")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = "conv_id bigint, n bigint, ends string", []
        fp = first = state = None
        n = 0
        for batch in batches:
            for one, conv, some, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if one == fp:
                    n += some
                    state.update(("," + ids).encode())
                    continue
                if state is not None:
                    out.append((first, n, state.hexdigest()))
                fp, first, n, state = one, conv, some, hashlib.sha256(ids.encode())
            yield _batch(out, schema)
            out = []
        if state is not None:
            yield _batch([(first, n, state.hexdigest())], schema)

    ids = keyed.select("fp", "conv_id").repartitionByRange("fp", "conv_id").sortWithinPartitions("fp", "conv_id")
    joined = ids.mapInArrow(pieces, "fp binary, conv_id bigint, n bigint, ids string")
    ends = joined.repartition("fp").sortWithinPartitions("fp", "conv_id").mapInArrow(digests, "conv_id bigint, n bigint, ends string")
    return keyed.select("conv_id", "key", "sizes").join(ends, "conv_id")


_TYPES = {"binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns both keys begin with."""
    low, high = 0, min(len(a), len(b)) // TURN_BYTES
    if a[: high * TURN_BYTES] == b[: high * TURN_BYTES]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * TURN_BYTES : mid * TURN_BYTES] == b[low * TURN_BYTES : mid * TURN_BYTES]:
            low = mid
        else:
            high = mid
    return low


def prefix_name(key: bytes, depth: int) -> bytes:
    return hashlib.sha256(key[: depth * TURN_BYTES]).digest()[:TURN_BYTES]


@dataclass
class _Point:
    """A branch, end or leaf of which what has been read so far is known."""

    depth: int
    on_first: bool  # on the path to the range's first key
    conv_id: int | None = None
    n_convs: int = 0
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0  # of all nodes below this one
    ends: str = NO_IDS
    childless: bool = True

    def add(self, conv_id: int, n_convs: int, n_leaves: int, saved: int) -> None:
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)
        self.n_convs += n_convs
        self.n_leaves += n_leaves
        self.saved += saved


@dataclass
class _Range:
    """The compressed tree of one range of sorted keys, built as they are read.

    ``before`` and ``after`` are the turns that its first and last key share with the
    neighbouring ranges, -1 where there is none.
    """

    before: int
    after: int
    key: bytes = b""
    sizes: list[int] = field(default_factory=list)
    points: list[_Point] = field(default_factory=lambda: [_Point(0, True)])
    units: list[tuple] = field(default_factory=list)
    shared: list[tuple] = field(default_factory=list)
    began: bool = False

    def read(self, key: bytes, sizes: list[int], conv_id: int, n: int, ends: str) -> None:
        self._close_to(common_turns(self.key, key) if self.began else 0)
        depth = len(key) // TURN_BYTES
        if depth > self.points[-1].depth:
            self.points.append(_Point(depth, not self.began))
        self.key, self.sizes, self.began = key, sizes, True
        self.points[-1].ends = ends
        self.points[-1].add(conv_id, n, 0, 0)

    def _close_to(self, depth: int) -> None:
        """Completes all points below ``depth`` on the path, and makes it a branch."""
        while self.points[-1].depth > depth:
            point = self.points.pop()
            if self.points[-1].depth < depth:
                self.points.append(_Point(depth, point.on_first))
            self._complete(point, self.points[-1], self.before if point.on_first else -1, point.childless)

    def end(self) -> None:
        """Completes the path to the last key, which the next range may share or go on from."""
        while self.points:
            point = self.points.pop()
            before = self.before if point.on_first else -1
            self._complete(point, self.points[-1] if self.points else None, max(before, self.after), point.childless and self.after < point.depth)

    def _complete(self, point: _Point, above: _Point | None, shared_to: int, leaf: bool) -> None:
        """Adds the point to the one above it, and gives its edge; nodes down to ``shared_to`` have more in other ranges."""
        top = above.depth if above else -1
        point.n_leaves += leaf
        begun_before = self.before if point.on_first else -1
        running, sums = point.saved, []
        for depth in range(point.depth, top, -1):
            size = self.sizes[depth - 1] if depth else 0
            running += (point.n_convs - (depth > begun_before)) * size
            sums.append(running)
        sums.reverse()
        if above:
            above.childless = False
            above.n_children += top + 1 > begun_before
            above.add(point.conv_id, point.n_convs, point.n_leaves, running)
        alone = max(top, min(shared_to, point.depth))
        for depth in range(top + 1, alone + 1):
            last = depth == point.depth
            children = point.n_children if last else int(depth + 1 > begun_before)
            names = prefix_name(self.key, depth), prefix_name(self.key, depth - 1) if depth else None
            ends = point.ends if last else NO_IDS
            self.shared.append((*names, depth, point.conv_id, point.n_convs, children, point.n_leaves, sums[depth - top - 1], ends))
        if alone < point.depth:
            names = prefix_name(self.key, point.depth), prefix_name(self.key, alone) if alone >= 0 else None
            saved = sums[alone - top :]
            self.units.append((*names, alone, point.conv_id, point.n_convs, point.n_children, point.n_leaves, saved, point.ends))


def prefix_trie(steps: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row for each distinct prefix of the sequences (conv_id, steps); conv_id is unique and not null."""
    keyed = written(_by_key(steps), "keys")
    head = F.substring("key", 1, HEAD_TURNS * TURN_BYTES)
    distinct = _distinct(keyed).withColumn("head", head)
    dealt = distinct.repartitionByRange(ranges, "head") if ranges else distinct.repartitionByRange("head")
    placed = written(dealt.withColumn("part", F.spark_partition_id()), "ranges")
    # the ends of each range, cut to the turns that splitters see: one short row a range
    ends = sorted(placed.groupBy("part").agg(F.min("head").alias("low"), F.max("head").alias("high")).collect(), key=lambda r: r.part)
    shared = [common_turns(bytes(a.high), bytes(b.low)) for a, b in zip(ends, ends[1:])]
    around = {r.part: (before, after) for r, before, after in zip(ends, [-1, *shared], [*shared, -1])}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree = None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != part:
                    if tree:
                        tree.end()
                        yield from given(tree)
                    part, tree = row[0], _Range(*around[row[0]])
                tree.read(*row[1:])
                if len(tree.units) + len(tree.shared) >= BATCH_ROWS:
                    yield from given(tree)
        if tree:
            tree.end()
            yield from given(tree)

    def given(tree: _Range) -> Iterator[pa.RecordBatch]:
        rows = [("u", *u) for u in tree.units] + [("s", *s[:7], [s[7]], s[8]) for s in tree.shared]
        tree.units, tree.shared = [], []
        yield _batch(rows, "kind string, " + _UNIT)

    in_order = placed.select("part", "key", "sizes", "conv_id", "n", "ends").repartitionByRange(max(1, len(ends)), "part").sortWithinPartitions("part", "key")
    made = written(in_order.mapInArrow(build, "kind string, " + _UNIT), "points")
    # of a shared node, ``top`` is its own depth
    sums = made.where("kind = 's'").groupBy("fp", "parent_fp", "top").agg(
        F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves")),
        F.sum(F.element_at("saved", 1)).alias("saved"),
        # at most one range holds the key that ends here
        F.coalesce(F.max(F.when(F.col("ends") != NO_IDS, F.col("ends"))), F.lit(NO_IDS)).alias("ends"),
    )
    sums = sums.withColumn("saved", F.array("saved")).withColumn("top", F.col("top") - 1)
    units = written(made.where("kind = 'u'").drop("kind").unionByName(sums), "units")
    above = written(units.where("n_children > 0").select(F.col("fp").alias("parent_fp"), F.col("conv_id").alias("above")), "branches")
    joined = skewed_join(units, above, "parent_fp", "left")
    spread = joined.select("*", F.posexplode("saved").alias("at", "saved_tokens"))
    last = F.col("at") == F.size("saved") - 1
    return spread.select(
        "conv_id",
        (F.col("top") + 1 + F.col("at")).cast("bigint").alias("depth"),
        F.when(F.col("at") == 0, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).cast("bigint").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.when(last, F.col("ends")).otherwise(NO_IDS).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(rebuilt(rows))
