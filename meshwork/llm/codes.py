"""Vector codes by product quantization with integer k-means, nearest entries by ball trees.

1. Each component becomes floor(1024 x); vectors are cut into ``PARTS``
   consecutive parts, and each part position has a codebook of ``ENTRIES`` entries.
2. A codebook begins as that part of the vectors with the smallest ids. In each
   round every part goes to its nearest entry, and entries move to the floored
   mean of their parts. Tasks hand on one sum and count for each entry they
   used, never points.
3. A ball tree over the entries of a part position finds the nearest one for all
   parts of a batch at once: a batch is split by the nearer child, and goes on
   to the other child only with those parts whose ball may hold an entry at
   most as far as the best so far. Radii are rounded up and bounds down, bounds
   are compared non-strictly so that an equally near entry of a lower index is
   seen, and entries in leaves are compared by exact integer distances.

The driver and every task hold the codebooks only: ``ENTRIES`` vectors, whatever
the table's size.

Defined results: vectors that are null or hold null or non-finite components
are left out. The length of vectors is that of the row with the smallest id
left; a vector of another length has neither code nor error, since codebooks
have one width. Lengths that ``PARTS`` does not divide are cut as evenly as
may be; parts of no components are all equal. Ids sort with nulls last; rows that
share an id are told apart by their components, so the first codebooks do not depend on
the order of rows. With fewer rows than ``ENTRIES`` there are fewer entries.
A component beyond what 64 bits can hold of squared distances (2^18 for
parts of 16) counts as the nearest one within. An empty table gives no rows.
Columns other than the three named ones are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import read_table, skewed_join, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LEAF_ENTRIES = 16
#: Bytes of vectors that a task handles at once.
BLOCK_BYTES = 4 << 20


class EntryTree:
    """A ball tree over integer vectors that gives the nearest one, of equally near ones the one of the lowest index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        self.rough = self.entries.astype(np.float64)
        self.most = int(np.abs(self.entries).max(initial=0))
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self._grow(np.arange(len(entries)))

    def _grow(self, at: np.ndarray) -> int:
        me, points = len(self.centres), self.rough[at]
        centre = points.mean(0)
        away = _squares(points, centre[None])[1][:, 0]
        self.centres.append(centre)
        self.radii.append(math.sqrt(away.max(initial=0.0)) * (1 + 1e-9) + 1e-9)
        self.members.append(at)
        self.children.append(None)
        if len(at) > LEAF_ENTRIES:
            one = points[away.argmax()]
            other = points[_squares(points, one[None])[1][:, 0].argmax()]
            nearer = _squares(points, one[None])[1][:, 0] < _squares(points, other[None])[1][:, 0]
            if nearer.any() and not nearer.all():
                self.children[me] = self._grow(at[nearer]), self._grow(at[~nearer])
        return me

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, and the squared distance."""
        points = points.astype(np.int64)
        found = _Search(self, points)
        found.visit(0, np.arange(len(points)))
        return found.index, found.best


class _Search:
    """The best entry so far of each point of one batch."""

    def __init__(self, tree: EntryTree, points: np.ndarray):
        self.tree, self.points, self.rough = tree, points, points.astype(np.float64)
        self.index = np.full(len(points), len(tree.entries), dtype=np.int64)
        self.best = np.full(len(points), np.iinfo(np.int64).max, dtype=np.int64)
        self.tested = 0
        most = max(tree.most, int(np.abs(points).max(initial=0)))
        #: Whether doubles hold all terms of squared distances exactly.
        self.exact = 4 * points.shape[1] * most * most < 2**53

    def visit(self, node: int, at: np.ndarray) -> None:
        if not len(at):
            return
        children = self.tree.children[node]
        if children is None:
            self.scan(node, at)
            return
        low, high = _squares(self.rough[at], np.stack([self.tree.centres[c] for c in children]))
        first = high[:, 0] <= high[:, 1]
        for child in (0, 1):
            self.visit(children[child], at[first == (child == 0)])
        for child in (0, 1):
            later = first == (child == 1)
            distance, radius = np.sqrt(low[later, child]), self.tree.radii[children[child]]
            bound = np.maximum(distance - radius - 1e-9 * (distance + radius), 0.0)
            self.visit(children[child], at[later][bound * bound * (1 - 1e-9) <= self.best[at[later]]])

    def scan(self, node: int, at: np.ndarray) -> None:
        members = self.tree.members[node]
        self.tested += len(at) * len(members)
        if self.exact:
            x, y = self.rough[at], self.tree.rough[members]
            away = ((x * x).sum(1)[:, None] - 2.0 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
        else:
            x, y = self.points[at], self.tree.entries[members]
            away = np.stack([((x - e) ** 2).sum(1) for e in y], axis=1)
        nearest = away.argmin(1)  # members ascend, so of ties the lowest index
        best, index = away[np.arange(len(at)), nearest], members[nearest]
        better = (best < self.best[at]) | ((best == self.best[at]) & (index < self.index[at]))
        self.best[at[better]], self.index[at[better]] = best[better], index[better]


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds below and above the squared distances of the rows of ``x`` and ``y``."""
    xx, yy = (x * x).sum(1)[:, None], (y * y).sum(1)
    found = xx - 2.0 * (x @ y.T) + yy
    error = (xx + yy) * 1e-13 + 1e-9
    return np.maximum(found - error, 0.0), np.maximum(found + error, 0.0)


def cuts(width: int) -> list[int]:
    """Where the parts of a vector begin and end."""
    return [k * width // PARTS for k in range(PARTS + 1)]


def bound(width: int) -> int:
    """The largest component: squared distances over all parts stay below 2^62."""
    longest = max(1, -(-width // PARTS))
    return min(2**31 - 1, math.isqrt(2**58 // longest))


def _integers(rows: DataFrame) -> DataFrame:
    """vec_id, label and the floored components of usable vectors as 32-bit integers."""

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lengths = np.diff(lists.offsets.to_numpy())
            components = lists.flatten() if not lists.null_count else lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py())
            values = components.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            row = np.repeat(np.arange(len(lengths)), lengths)
            bad = np.bincount(row[~np.isfinite(values)], minlength=len(lengths)) > 0
            usable = ~bad & ~np.asarray(lists.is_null())
            ends = np.cumsum(lengths)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(values * SCALE)
            made = [
                np.clip(scaled[end - n : end], -bound(n), bound(n)).astype("<i4").tobytes() for end, n in zip(ends[usable].tolist(), lengths[usable].tolist())
            ]
            kept = batch.take(pa.array(np.flatnonzero(usable)))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(made, pa.binary())], names=["vec_id", "label", "vector"])

    named = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = StructType([StructField("vec_id", LongType()), StructField("label", named.schema["label"].dataType), *StructType.fromDDL("vector binary").fields])
    return named.mapInArrow(floored, schema)


def _blocks(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of bounded bytes with their vectors as rows of an array."""
    step = max(1, BLOCK_BYTES // max(1, 8 * width))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield part, np.frombuffer(b"".join(part.column(column).to_pylist()), dtype="<i4").reshape(part.num_rows, width)


def _moved(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: floored means of the parts that each entry is nearest to."""
    ends = cuts(sum(b.shape[1] for b in books))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [EntryTree(b) for b in books]
        totals, counts = [np.zeros(b.shape, dtype=np.int64) for b in books], [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            for _, x in _blocks(batch, 0, ends[-1]):
                for k, tree in enumerate(trees):
                    part = x[:, ends[k] : ends[k + 1]]
                    index, _ = tree.nearest(part)
                    order = np.argsort(index, kind="stable")
                    used, first = np.unique(index[order], return_index=True)
                    counts[k] += np.bincount(index, minlength=len(counts[k]))
                    if part.shape[1]:
                        totals[k][used] += np.add.reduceat(part[order].astype(np.int64), first, axis=0)
        rows = [(k, e, int(counts[k][e]), totals[k][e].tobytes()) for k in range(PARTS) for e in np.flatnonzero(counts[k]).tolist()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))] if rows else []
        if columns:
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "total"])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, np.ndarray]] = {}  # as many as there are entries at most
        for batch in batches:
            for part, entry, n, total in zip(*(c.to_pylist() for c in batch.columns)):
                before, so_far = held.get((part, entry), (0, 0))
                held[part, entry] = before + n, so_far + np.frombuffer(total, dtype=np.int64).astype(object)  # sums over all tasks are of any size
        rows = [(*key, np.array([int(t) // n for t in total], dtype=np.int64).tobytes()) for key, (n, total) in held.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], names=["part", "entry", "vector"])

    partial = vectors.select("vector").mapInArrow(sums, "part int, entry int, n bigint, total binary")
    after = [b.copy() for b in books]
    for r in partial.repartition("part", "entry").mapInArrow(means, "part int, entry int, vector binary").collect():
        after[r.part][r.entry] = np.frombuffer(r.vector, dtype=np.int64)
    return after


def learn_codebooks(vectors: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part position from (vec_id, vector); ``ENTRIES`` rows and the entries' means meet on the driver."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = vectors.orderBy(*order).select("vector").first()
    if first is None:
        return []
    width = len(first.vector) // 4
    alike = vectors.where(F.octet_length("vector") == 4 * width)
    seeds = np.stack([np.frombuffer(r.vector, dtype="<i4") for r in alike.orderBy(*order).select("vector").limit(ENTRIES).collect()]).astype(np.int64)
    ends = cuts(width)
    books = [seeds[:, ends[k] : ends[k + 1]] for k in range(PARTS)]
    for _ in range(rounds):
        books = _moved(alike, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for entry in b.tolist() for x in entry).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error of each vector."""
    width = sum(b.shape[1] for b in books)
    ends = cuts(width)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [EntryTree(b) for b in books]
        for batch in batches:
            alike = np.array([len(v) == 4 * width for v in batch.column(2).to_pylist()], dtype=bool)
            for part, x in _blocks(batch.take(pa.array(np.flatnonzero(alike))), 2, width):
                found = [tree.nearest(x[:, ends[k] : ends[k + 1]]) for k, tree in enumerate(trees)]
                text = np.stack([i for i, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                codes = [text[2 * PARTS * r : 2 * PARTS * (r + 1)] for r in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes), pa.array(sum(e for _, e in found))], names=names)
            other = batch.take(pa.array(np.flatnonzero(~alike)))
            if other.num_rows:
                yield pa.RecordBatch.from_arrays([other.column(0), other.column(1), pa.nulls(other.num_rows, pa.string()), pa.nulls(other.num_rows, pa.int64())], names=names)

    schema = StructType([*vectors.select("vec_id", "label").schema.fields, StructField("code", StringType()), StructField("error", LongType())])
    names = schema.names
    return vectors.select("vec_id", "label", "vector").mapInArrow(coded, schema)


def compress_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each usable row of ``rows`` (vec_id, embedding, label)."""
    vectors = written(_integers(rows), "integers")
    books = learn_codebooks(vectors)
    # null labels form one group of their own
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("key")
    coded = written(encode(vectors, books).select("vec_id", key, "code", "error"), "codes")
    totals = coded.groupBy("key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    totals = written(totals.select("key", F.least("total", F.lit(2**63 - 1).cast("decimal(38,0)")).cast("bigint").alias("label_error")), "label-errors")
    joined = skewed_join(coded, totals, "key")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(read_table(spark, sf_dir, "embeddings"))
