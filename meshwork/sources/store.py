"""Immutable generations of scene tables behind one atomically replaced manifest.

A generation is a folder of Parquet tables that is never written twice. The
manifest names the current one and is the only commit point: tables are written
first, the manifest is renamed over last, and a manifest that does not match
its own digest is an error, never a reason to look for older generations.
Files are reached through Hadoop's file system, so any store that Spark knows works.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.operators.scene import identity_mismatches
from meshwork.operators.validate import require_valid, union, violations

REGISTRY_ONLY, FULL = "registry_only", "full"
TABLES = ("node_identity", "node_style", "topology", "edge", "positions", "node_product", "edge_product", "entity_node", "product_reference")


class PublicationError(ValueError):
    pass


@dataclass(frozen=True)
class Receipt:
    generation: int
    kind: str
    registry_revision: int
    node_count: int
    edge_count: int
    entity_count: int
    digests: dict[str, str]

    def encode(self) -> str:
        body = json.dumps(asdict(self), sort_keys=True)
        return json.dumps({"body": body, "digest": hashlib.sha256(body.encode()).hexdigest()})

    @staticmethod
    def decode(text: str) -> Receipt:
        try:
            data = json.loads(text)
            body, digest = data["body"], data["digest"]
        except (ValueError, KeyError, TypeError) as error:
            raise PublicationError("CorruptManifest") from error
        if hashlib.sha256(body.encode()).hexdigest() != digest:
            raise PublicationError("CorruptManifestHash")
        return Receipt(**json.loads(body))


class GenerationStore:
    """Publishes and opens generations under a folder; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.folder}/{name}")

    def current_receipt(self) -> Receipt | None:
        if not self._files.exists(self._at("manifest.json")):
            return None
        text = self.spark.read.option("wholetext", True).text(f"{self.folder}/manifest.json").first()
        return Receipt.decode(text.value if text else "")

    def next_generation(self) -> int:
        receipt = self.current_receipt()
        return 1 if receipt is None else receipt.generation + 1

    def open_current(self) -> dict[str, DataFrame] | None:
        """The tables of the generation that the manifest names; their digests must match."""
        receipt = self.current_receipt()
        if receipt is None:
            return None
        tables = {t: self.spark.read.parquet(f"{self._stem(receipt.generation)}/{t}") for t in receipt.digests}
        for name, df in tables.items():
            if table_digest(df) != receipt.digests[name]:
                raise PublicationError(f"CorruptTable({name})")
        return tables

    def _stem(self, generation: int) -> str:
        return f"{self.folder}/generation-{generation:016x}"

    def publish(self, generation: int, kind: str, registry_revision: int, tables: dict[str, DataFrame]) -> Receipt:
        """Validates, writes the tables once, then commits; a registry never replaces a full scene, and that is checked first."""
        require_valid(publication_violations(tables, kind))
        current = self.current_receipt()
        if current and current.kind == FULL and kind == REGISTRY_ONLY:
            raise PublicationError(f"FullGenerationProtected({current.generation}, {generation})")
        if current and generation <= current.generation:
            raise PublicationError(f"StaleGeneration({current.generation}, {generation})")
        if self._files.exists(self._path(self._stem(generation))):
            raise PublicationError(f"ArtifactExists({generation})")
        digests, counts = {}, {}
        for name, df in tables.items():
            if name not in TABLES:
                raise PublicationError(f"UnknownTable({name})")
            writer = df.write.mode("error")
            (writer.partitionBy("manifold") if name == "positions" else writer).parquet(f"{self._stem(generation)}/{name}")
            stored = self.spark.read.parquet(f"{self._stem(generation)}/{name}")
            digests[name], counts[name] = table_digest(stored), stored.count()
        receipt = Receipt(generation, kind, registry_revision, counts.get("node_identity", 0), counts.get("edge", 0), counts.get("entity_node", 0), digests)
        self._commit(receipt)
        return receipt

    def _commit(self, receipt: Receipt) -> None:
        pending = self._at(f"manifest-{uuid.uuid4().hex}.pending")
        out = self._files.create(pending, True)
        out.write(bytearray(receipt.encode().encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(pending.toUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(pending, self._at("manifest.json"), overwrite)


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows in any order: count and summed row hashes."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{sorted(df.columns)}:{row.n}:{row.s}".encode()).hexdigest()


def publication_violations(tables: dict[str, DataFrame], kind: str) -> DataFrame:
    """Pages and products must name the same ids slot by slot; ids are not zero; a registry has no edges."""
    frames = []
    for page, product, key in (("node_identity", "node_product", "node_id"), ("edge", "edge_product", "edge_id")):
        if page in tables and product in tables:
            wrong = identity_mismatches(tables[page], tables[product].select("slot", F.col(key).alias("id")))
            frames.append(violations(wrong, "IdentityMismatch", F.lit(True), "slot", F.col("slot"), 0, F.lit(page)))
        if page in tables:
            frames.append(violations(tables[page], "ZeroIdentity", F.col("id") == 0, "id", F.col("slot"), 1))
    if kind == REGISTRY_ONLY and "edge" in tables:
        frames.append(violations(tables["edge"], "RegistryWithEdges", F.lit(True), "id", F.col("slot"), 2))
    if not frames:
        raise PublicationError("EmptyPublication")
    return union(frames)
