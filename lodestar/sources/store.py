"""A versioned index store: Parquet entries, a JSON manifest that is published last, an asset catalog and a checkpoint.

Files are reached through Hadoop's file system, so the root may be in any store that Spark can open. Readers follow the
manifest, so they see either the old version or the new one."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.catalog_ops import upsert
from .codec import ENTRY, CorruptIndex

ASSET = "asset_id string, library_id string, fingerprint string, created_at timestamp, updated_at timestamp"
SCHEMA_VERSION = 1


@dataclass(frozen=True)
class Manifest:
    model_id: str
    model_version: str
    display_name: str
    embedding_dimension: int
    image_size: int
    context_length: int
    model_fingerprint: str
    resource_fingerprint: str
    created_at: str
    updated_at: str
    item_count: int = 0
    schema_version: int = SCHEMA_VERSION
    entries: str = ""

    def __post_init__(self):
        for k in ("model_id", "model_version", "display_name", "model_fingerprint", "resource_fingerprint"):
            if not getattr(self, k).strip():
                raise CorruptIndex(f"manifest: {k} is empty")
        for k in ("embedding_dimension", "image_size", "context_length"):
            if getattr(self, k) <= 0:
                raise CorruptIndex(f"manifest: {k} must be positive")
        if self.item_count < 0 or self.schema_version != SCHEMA_VERSION:
            raise CorruptIndex("manifest: wrong count or version")


STAGES = ("idle", "building", "ready", "failed")


@dataclass(frozen=True)
class Checkpoint:
    stage: str
    candidate_ids: tuple[str, ...] = ()
    completed: int = 0
    total: int = 0
    message: str | None = None
    candidates: str = ""  # the table of ids, where there are too many for a list
    failed: int = 0

    def __post_init__(self):
        if self.stage not in STAGES or not 0 <= self.completed <= max(self.total, 0):
            raise ValueError("no such checkpoint")

    @property
    def progress(self) -> float | None:
        return self.completed / self.total if self.total > 0 else None


def validated(entries: DataFrame, dim: int) -> DataFrame:
    """Entries with an id, a fingerprint and a finite vector of the dimension; reading another one fails."""
    fine = (F.length("asset_id") > 0) & (F.length("fingerprint") > 0) & V.is_valid("embedding") & (F.size("embedding") == dim)
    return entries.where(F.when(F.coalesce(fine, F.lit(False)), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("invalid entry "), F.coalesce("asset_id", F.lit("null")))).cast("boolean")))


class Folder:
    """Small JSON files of a folder in any store that Spark can open. A store without an atomic rename keeps no promise of
    old or new; the driver's JVM is used, so sessions over Spark Connect have none."""
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        if not self._fs().exists(self._path(name)):
            return None
        stream = self._fs().open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, name: str, value: dict) -> None:
        """Under a temporary name first, then renamed over what is there: readers find the old file or the new one."""
        folder, _, last = name.rpartition("/")
        fs, part = self._fs(), self._path(f"{folder}/.{last}-{uuid.uuid4().hex}".lstrip("/"))
        fs.mkdirs(self._path(folder))
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(value, indent=1, sort_keys=True).encode()))
        out.close()
        self._replace(part, self._path(name))

    def _replace(self, part, path) -> None:
        fs = self._jvm.org.apache.hadoop.fs
        kind = getattr(fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        fs.FileContext.getFileContext(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getUri(),
                                      self.spark.sparkContext._jsc.hadoopConfiguration()).rename(part, path, how)


class IndexStore(Folder):
    """The index of a folder: manifest, entries, catalog, checkpoint, and what a build has staged."""

    def load_manifest(self) -> Manifest | None:
        found = self._read("manifest.json")
        return Manifest(**found) if found else None

    def save_snapshot(self, manifest: Manifest, entries: DataFrame) -> Manifest:
        """Checks and writes the entries, sorted by id for pruning by row groups, then publishes the manifest."""
        where = f"entries-{uuid.uuid4().hex}"
        validated(entries.select("asset_id", "fingerprint", "embedding", "created_at", "updated_at"), manifest.embedding_dimension).repartitionByRange(
            "asset_id").sortWithinPartitions("asset_id").write.parquet(f"{self.root}/{where}")
        n = self.spark.read.schema(ENTRY).parquet(f"{self.root}/{where}").count()
        done = replace(manifest, item_count=n, entries=where)
        self._write("manifest.json", asdict(done))
        self.clear_staged()
        return done

    def load_snapshot(self) -> tuple[Manifest, DataFrame] | None:
        m = self.load_manifest()
        if m is None:
            return None
        if not self._fs().exists(self._path(m.entries)):
            raise CorruptIndex("a manifest without entries")
        entries = self.spark.read.schema(ENTRY).parquet(f"{self.root}/{m.entries}")
        if entries.count() != m.item_count:  # from the files' footers
            raise CorruptIndex("entries and manifest differ in number")
        if m.item_count and entries.select(F.size("embedding").alias("n")).first()["n"] != m.embedding_dimension:
            raise CorruptIndex("entries and manifest differ in dimension")
        return m, entries

    def load_catalog(self) -> DataFrame:
        found = self._read("catalog.json")
        return self.spark.read.schema(ASSET).parquet(f"{self.root}/{found['at']}") if found else self.spark.createDataFrame([], ASSET)

    def upsert_catalog(self, assets: DataFrame) -> DataFrame:
        where = f"assets-{uuid.uuid4().hex}"
        upsert(self.load_catalog(), assets).sortWithinPartitions("asset_id").write.parquet(f"{self.root}/{where}")
        self._write("catalog.json", {"at": where})
        return self.load_catalog()

    def stage(self, entries: DataFrame, name: str | None = None) -> dict:
        """Writes entries (ENTRY; with a column error, those that have one are failures) and commits them: a record that is
        renamed into place says where they are and how many. What was written without a record is never read, so a write
        that died leaves nothing, and one that is done over replaces its record."""
        where = f"staged/{name or 'slice'}-{uuid.uuid4().hex}"
        rows = entries if "error" in entries.columns else entries.withColumn("error", F.lit(None).cast("string"))
        rows.write.parquet(f"{self.root}/{where}")
        good, bad = F.col("error").isNull(), F.col("error").isNotNull()
        t = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{where}").agg(
            F.count_if(good).alias("done"), F.count_if(bad).alias("failed"), F.min(F.when(good, F.col("asset_id"))).alias("low"), F.max(F.when(good, F.col("asset_id"))).alias("high")).first()
        record = {"at": where, "done": t["done"], "failed": t["failed"], "low": t["low"], "high": t["high"]}
        self._write(f"commits/{name or where.rpartition('-')[2]}.json", record)
        return record

    def committed(self, name: str) -> bool:
        return self._fs().exists(self._path(f"commits/{name}.json"))

    def commits(self) -> list[dict]:
        fs, at = self._fs(), self._path("commits")
        names = sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []
        return [self._read(f"commits/{n}") for n in names if n.endswith(".json") and not n.startswith(".")]

    def _staged(self) -> DataFrame:
        rows = ENTRY + ", error string"
        found = [f"{self.root}/{c['at']}" for c in self.commits()]
        return self.spark.read.schema(rows).parquet(*found) if found else self.spark.createDataFrame([], rows)

    def staged(self) -> DataFrame:
        """Committed entries, sorted out by id: of an id that was staged more than once the newest, ties to the smaller fingerprint."""
        newest = F.max_by(F.struct("fingerprint", "embedding", "created_at", "updated_at"), F.struct("updated_at", F.hash("fingerprint"))).alias("e")
        return self._staged().where("error is null").groupBy("asset_id").agg(newest).select("asset_id", "e.*")

    def failures(self) -> DataFrame:
        """(asset_id, error) of what could not be encoded and has not been since."""
        rows = self._staged()
        return rows.where("error is not null").select("asset_id", "error").join(rows.where("error is null").select("asset_id"), "asset_id", "left_anti").dropDuplicates(["asset_id"])

    def save_candidates(self, ids: DataFrame) -> tuple[str, int]:
        """Where the ids (asset_id) of a build are, and how many."""
        where = f"staged/candidates-{uuid.uuid4().hex}"
        ids.select("asset_id").write.parquet(f"{self.root}/{where}")
        return where, self.spark.read.parquet(f"{self.root}/{where}").count()

    def load_candidates(self, where: str) -> DataFrame:
        return self.spark.read.schema("asset_id string").parquet(f"{self.root}/{where}")

    def save_checkpoint(self, c: Checkpoint) -> None:
        self._write("checkpoint.json", asdict(c))

    def load_checkpoint(self) -> Checkpoint | None:
        found = self._read("checkpoint.json")
        return Checkpoint(**found | {"candidate_ids": tuple(found["candidate_ids"])}) if found else None

    def clear_staged(self) -> None:
        for name in ("commits", "staged", "checkpoint.json"):  # records first: none tells of what is gone
            self._fs().delete(self._path(name), True)

    def clear_index(self) -> None:
        """All but the catalog."""
        m = self.load_manifest()
        self._fs().delete(self._path("manifest.json"), False)
        if m is not None:
            self._fs().delete(self._path(m.entries), True)
        self.clear_staged()

    def clear(self) -> None:
        self._fs().delete(self._path(""), True)

    def size_mb(self) -> float:
        fs = self._fs()
        return fs.getContentSummary(self._path("")).getLength() / 1e6 if fs.exists(self._path("")) else 0.0
