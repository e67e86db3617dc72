"""Media columns: content-addressed payloads in tar shards.

A text's bytes, padded with 255 to a positive multiple of 576, are a greyscale
picture of rows of 576 samples and are stored losslessly as a PNG file. Each
task streams the pictures of its partition into one tar shard in the shared
folder; within a shard a payload is stored once, under its digest. The manifest
holds digest, shard, offset and length; a digest that several shards hold is
resolved to one of them, so each payload has one address and is read back once.

Metadata columns (width, height, bits) come from range reads of a picture's
header only; digests of stored bytes and features come from reading the address
in full, which must hold as many samples as the header says.

A retried task writes a shard of its own name; only the shards named in the
manifest of successful tasks are ever read. The manifest is a written table,
so later stages never write shards again.

Defined results: null and empty texts are one row of padding; equal texts share
an address and all values; an empty table gives no rows. Texts of any length are
stored whole.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, new_path, read_table, skewed_join, written

UNIT = 576
PAD = b"\xff"
COMPRESSION = 6
#: The signature and the header chunk of a PNG file.
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(data) // UNIT)) * UNIT
    return data.ljust(size, PAD), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_picture(payload: bytes) -> bytes:
    """The payload as an 8-bit greyscale PNG file, rows unfiltered."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), COMPRESSION)) + _chunk(b"IEND", b"")


def picture_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits per sample from the first ``HEADER_BYTES`` bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def decode_picture(data: bytes) -> bytes:
    """The samples of a picture that ``encode_picture`` wrote."""
    width, height, _ = picture_header(data[:HEADER_BYTES])
    at, packed = HEADER_BYTES, b""
    while data[at + 4 : at + 8] != b"IEND":
        size = struct.unpack(">I", data[at : at + 4])[0]
        if data[at + 4 : at + 8] == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += size + 12
    lines = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows are supported")
    return lines[:, 1:].tobytes()


def features(payload: bytes, header: tuple[int, int, int]) -> str:
    samples = np.frombuffer(payload, dtype=np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    entropy = float(-(share * np.log2(share)).sum())
    width, height, bits = header
    return f"png:{width}x{height}x{bits}:mean={samples.mean():.4f}:std={samples.std():.4f}:entropy={entropy:.4f}:distinct={len(share)}"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def store_payloads(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the shards; (doc_id, n_bytes, digest, shard, offset, length) of every row, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        shard = f"shard-{uuid.uuid4().hex}.tar"
        at: dict[bytes, tuple[int, int]] = {}
        with system.open_output_stream(f"{root}/{shard}") as out:
            position = 0
            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    part = batch.slice(start, 1000)
                    sizes, digests = [], []
                    for text in part.column(1).to_pylist():
                        payload, n_bytes = payload_of(text)
                        digest = hashlib.sha256(payload).digest()
                        if digest not in at:
                            data = encode_picture(payload)
                            info = tarfile.TarInfo(f"{digest.hex()}.png")
                            info.size = len(data)
                            head = info.tobuf(tarfile.USTAR_FORMAT)
                            out.write(head)
                            out.write(data)
                            out.write(bytes(-len(data) % tarfile.BLOCKSIZE))
                            at[digest] = (position + len(head), len(data))
                            position += len(head) + len(data) + -len(data) % tarfile.BLOCKSIZE
                        sizes.append(n_bytes)
                        digests.append(digest)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0),
                            pa.array(sizes, pa.int64()),
                            pa.array(digests, pa.binary()),
                            pa.array([shard] * len(digests), pa.string()),
                            pa.array([at[d][0] for d in digests], pa.int64()),
                            pa.array([at[d][1] for d in digests], pa.int64()),
                        ],
                        names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
                    )
            out.write(bytes(2 * tarfile.BLOCKSIZE))

    schema = "doc_id bigint, n_bytes bigint, digest binary, shard string, offset bigint, length bigint"
    return written(map_batches(docs.select("doc_id", F.col("text").cast("string")), run, schema), "manifest")


def addresses(manifest: DataFrame) -> DataFrame:
    """One (digest, shard, offset, length) for each payload."""
    least = manifest.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return least.select("digest", "at.*")


ADDRESS = "digest binary, shard string, offset bigint, length bigint"
HEADER = "width bigint, height bigint, bits bigint"


def in_shard_order(index: DataFrame) -> DataFrame:
    """Addresses dealt by shard and in order of place, so that each task reads its shards once from front to back."""
    return index.select("digest", "shard", "offset", "length").repartition("shard").sortWithinPartitions("shard", "offset")


def header_columns(placed: DataFrame, folder: str) -> DataFrame:
    """Addresses with width, height and bits, from range reads of headers only."""
    return _read(placed, folder, HEADER_BYTES, lambda data, _: picture_header(data), ADDRESS, HEADER)


def _read(placed: DataFrame, folder: str, most: int | None, of, given: str, columns: str) -> DataFrame:
    """``placed`` (``given``) with columns made from the first ``most`` stored bytes (None: all) of each address."""
    schema = f"{given}, {columns}"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}
    fields = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        opened, name = None, None
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                _, shard, offset, length = row[:4]
                if shard != name:
                    if opened:
                        opened.close()
                    opened, name = system.open_input_file(f"{root}/{shard}"), shard
                data = opened.read_at(length if most is None else min(most, length), offset)
                rows.append((*row, *of(data, row)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), fields)] if rows else [pa.array([], t) for t in fields], names=names)
        if opened:
            opened.close()

    return map_batches(placed, run, schema)


def _measure(data: bytes, row: tuple) -> tuple:
    """What a stored picture reads as; its payload must be that of its address, and as long as its header says."""
    digest, header = row[0], row[4:7]
    payload = decode_picture(data)
    if header[0] * header[1] * header[2] != 8 * len(payload):
        raise ValueError(f"the header stored for {digest.hex()} is not that of its payload")
    if hashlib.sha256(payload).digest() != digest:
        raise ValueError(f"the payload stored as {digest.hex()} reads as another one")
    return (
        len(payload),
        zlib.crc32(payload[-32:]),
        len(data),
        hashlib.sha256(data).digest(),
        features(payload, header),
    )


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores the texts of ``docs`` in ``folder`` and returns every row with its address and what reading it back gives."""
    folder = folder or new_path(docs.sparkSession, "media")
    manifest = store_payloads(docs, folder)
    columns = "payload_bytes bigint, tail_crc32 bigint, media_bytes bigint, media binary, feature string"
    headers = header_columns(in_shard_order(addresses(manifest)), folder)
    measured = written(_read(headers, folder, None, _measure, f"{ADDRESS}, {HEADER}", columns), "measured")
    # one payload (such as that of empty texts) may stand for a third of all rows
    rows = skewed_join(manifest.select("doc_id", "n_bytes", "digest"), measured, "digest")
    # digests travel as bytes and are spelt out last; a payload's was held against what was read back
    name = lambda c: F.lower(F.hex(c))
    return rows.select(
        "doc_id", "n_bytes", "payload_bytes", name("digest").alias("payload_sha256"), "tail_crc32", "media_bytes", name("media").alias("media_sha256"), "feature",
        name("digest").alias("digest"), "width", "height", "bits", "shard", "offset", "length",
    )


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read_table(spark, sf_dir, "documents"))
