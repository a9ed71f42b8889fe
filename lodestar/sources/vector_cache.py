"""A cache of embeddings by the fingerprint of what was embedded, kept in a folder under a budget of bytes.

Entries are Parquet tables (fingerprint, embedding, bytes, used), appended by each call; what a call found is noted as used. Over the
budget, the cache is written anew without the entries that were used longest ago. A Bloom filter of a fixed size tells
which fingerprints can't be there, so that a cold call shuffles nothing against the cache. One writer at a time."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoders import Encoder, embed
from ..operators.catalog_ops import with_offsets
from ..plans.session import cut
from .store import Folder

ENTRY, USE = "fingerprint string, embedding array<float>, bytes long, used long", "fingerprint string, used long"
#: Bytes of an entry besides its vector: the fingerprint.
OVERHEAD, HASHES = 64, 4


@dataclass(frozen=True)
class CacheManifest:
    model: str = ""
    clock: int = 0
    entries: list[str] = field(default_factory=list)
    uses: list[str] = field(default_factory=list)
    bloom: str = ""


class VectorCache(Folder):
    """budget: bytes of vectors and fingerprints; bits: of the Bloom filter, a multiple of 64."""

    def __init__(self, spark: SparkSession, root: str, budget: int = 500_000_000, bits: int = 1 << 23):
        super().__init__(spark, root)
        self.budget, self.bits = budget, bits

    def _manifest(self) -> CacheManifest:
        found = self._read("cache.json")
        return CacheManifest(**found) if found else CacheManifest()

    def _put(self, rows: DataFrame, name: str) -> str:
        where = f"{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{where}")
        return where

    def _table(self, names: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        """(fingerprint, embedding, bytes, used: the last call that stored or found it)."""
        m = self._manifest()
        rows = self._table(m.entries, ENTRY)
        if not m.uses:
            return rows
        last = self._table(m.uses, USE).groupBy("fingerprint").agg(F.max("used").alias("_last"))
        return rows.join(last, "fingerprint", "left").withColumn("used", F.greatest("used", "_last")).drop("_last")

    def counts(self) -> dict[str, int]:
        t = self._table(self._manifest().entries, ENTRY).agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
        return t.asDict()

    def clear(self) -> None:
        self._fs().delete(self._path(""), True)

    # ---- Bloom filter

    def _places(self, fingerprint: Column) -> Column:
        return F.array(*(F.pmod(F.xxhash64(fingerprint, F.lit(i)), F.lit(self.bits)) for i in range(HASHES)))

    def _bloom(self, fingerprints: DataFrame, known: str) -> str:
        """The filter of fingerprints and of an earlier filter, as words of 64 bits."""
        at = fingerprints.select(F.explode(self._places(F.col("fingerprint"))).alias("at"))
        words = at.select(F.floor(F.col("at") / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("bits"))
        if known:
            words = words.union(self._table([known], "word long, bits long"))
        return self._put(words.groupBy("word").agg(F.bit_or("bits").alias("bits")), "bloom")

    def might_hold(self, fingerprint: Column) -> Column:
        """False: certainly not in the cache. The filter's words, of a fixed size, go through the driver to the tasks."""
        known = self._manifest().bloom
        words = np.zeros(self.bits // 64, np.uint64)
        for r in self._table([known] if known else [], "word long, bits long").toArrow().to_batches():
            words[r.column("word").to_numpy()] = r.column("bits").to_numpy().view(np.uint64)
        shared = self.spark.sparkContext.broadcast(words)

        @F.pandas_udf("boolean")
        def told(places: pd.Series) -> pd.Series:
            at = np.stack(places.to_list()).astype(np.int64) if len(places) else np.zeros((0, HASHES), np.int64)
            return pd.Series(((shared.value[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)).astype(bool).all(1))

        return told(self._places(fingerprint))

    # ---- what a user calls

    def embed(self, rows: DataFrame, payload_col: str, encoder: Encoder) -> DataFrame:
        """rows with fingerprint and embedding. Each distinct payload that isn't cached is encoded once and stored; the entries
        of another model are dropped first. A null payload counts as an empty one."""
        m, model = self._manifest(), encoder.descriptor.fingerprint()
        if m.model != model:
            self._replace_all(m, CacheManifest(model, m.clock))
            m = self._manifest()
        now = m.clock + 1
        payload = F.coalesce(F.col(payload_col), F.lit(b""))
        keyed = rows.withColumn("fingerprint", F.sha2(payload, 256))
        asked = cut(keyed.groupBy("fingerprint").agg(F.min(payload).alias("payload")).withColumn("maybe", self.might_hold(F.col("fingerprint"))), "asked")
        held = self._table(m.entries, ENTRY)
        found = cut(held.join(asked.where("maybe").select("fingerprint"), "fingerprint", "left_semi").select("fingerprint", "embedding"), "found")
        miss = asked.where("not maybe").select("fingerprint", "payload").union(
            asked.where("maybe").join(found.select("fingerprint"), "fingerprint", "left_anti").select("fingerprint", "payload"))
        new = self._put(embed(miss, "payload", encoder).select(
            "fingerprint", "embedding", (F.size("embedding") * 4 + OVERHEAD).cast("long").alias("bytes"), F.lit(now).cast("long").alias("used")), "entries")
        used = self._put(found.select("fingerprint", F.lit(now).cast("long").alias("used")), "uses")
        fresh = self._table([new], ENTRY).select("fingerprint", "embedding")
        answer = cut(found.union(fresh), "answer")  # stays readable whatever is evicted
        self._write("cache.json", asdict(CacheManifest(model, now, [*m.entries, new], [*m.uses, used], self._bloom(fresh, m.bloom))))
        if m.bloom:
            self._fs().delete(self._path(m.bloom), True)
        self.evict()
        return keyed.join(answer, "fingerprint").select(*rows.columns, "fingerprint", "embedding")

    def evict(self) -> int:
        """Keeps the entries used last whose bytes fit the budget, ties by fingerprint. Returns how many went."""
        before = self.counts()
        if before["bytes"] <= self.budget:
            return 0
        m = self._manifest()
        ordered = self.entries().withColumn("_order", F.struct((-F.col("used")).alias("a"), F.col("fingerprint").alias("b")))
        kept = self._put(with_offsets(ordered, [], "_order", "bytes").where(F.col("offset") + F.col("bytes") <= self.budget).select("fingerprint", "embedding", "bytes", "used"), "entries")
        self._replace_all(m, replace(m, entries=[kept], uses=[], bloom=self._bloom(self._table([kept], ENTRY), "")))
        return before["count"] - self.counts()["count"]

    def _replace_all(self, old: CacheManifest, new: CacheManifest) -> None:
        self._write("cache.json", asdict(new))
        for name in {*old.entries, *old.uses, old.bloom}.difference(new.entries, new.uses, [new.bloom, ""]):
            self._fs().delete(self._path(name), True)
