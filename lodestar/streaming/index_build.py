"""Index builds by slices that are each committed, and metrics, as jobs and streams."""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoders import Encoder, embed
from ..operators.catalog_ops import ABORT_AT, failure_runs, missing
from ..plans.session import cut
from ..sources.codec import ENTRY, CorruptIndex
from ..sources.store import Checkpoint, IndexStore, Manifest


#: Ids of a slice that are broadcast to the scan of its assets; a slice of more is joined.
BROADCAST_IDS = 200_000


class Cancellation:
    """Ends a build from another thread or from its progress callback: no further slice starts, and the jobs of the running one are
    interrupted by their tag."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self._set = spark, f"build-{uuid.uuid4().hex}", threading.Event()

    def cancel(self) -> None:
        self._set.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def __bool__(self) -> bool:
        return self._set.is_set()

    @contextmanager
    def tagged(self):
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            yield
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)


class Nothing(ValueError):
    """There is no asset to index."""


@dataclass(frozen=True)
class Slice:
    """Ids from low to high, those of the parts from first to last."""

    first: int
    last: int
    low: str
    high: str
    rows: int


def slices_of(store: IndexStore, todo: DataFrame, rows: int, rows_a_slice: int) -> tuple[DataFrame, list[Slice]]:
    """(the ids of todo, so many rows, with `part`, written; the slices): ranges of ids of about rows_a_slice, so that a table of assets
    sorted by id is read in pieces, not whole for each slice. Into how many parts Spark ranges them is its own affair: neighbours
    are joined until they make a slice. The driver gets one row a part."""
    path = f"{store.root}/staged/todo-{uuid.uuid4().hex}"
    ranged = todo.select("asset_id").repartitionByRange(max(1, -(-rows // rows_a_slice)), "asset_id")
    ranged.withColumn("part", F.spark_partition_id()).write.parquet(path)
    dealt = store.spark.read.schema("asset_id string, part int").parquet(path)
    parts = dealt.groupBy("part").agg(F.min("asset_id").alias("low"), F.max("asset_id").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    slices: list[Slice] = []
    for p in parts:
        if slices and slices[-1].rows + p["n"] / 2 <= rows_a_slice:
            s = slices[-1]
            slices[-1] = Slice(s.first, p["part"], s.low, p["high"], s.rows + p["n"])
        else:
            slices.append(Slice(p["part"], p["part"], p["low"], p["high"], p["n"]))
    return dealt, slices


def _failures_in_a_row(store: IndexStore, record: dict, before: int) -> tuple[int, int]:
    """(the longest run of failures in a staged slice, in the order of ids and with the run that it began in, the run at its end)."""
    if not record["failed"]:
        return 0, 0
    log = store.spark.read.schema(ENTRY + ", error string").parquet(f"{store.root}/{record['at']}")
    if record["low"] is None:
        return before + record["failed"], before + record["failed"]
    bad = log.where("error is not null")
    ends = bad.agg(F.count_if(F.col("asset_id") < record["low"]).alias("first"), F.count_if(F.col("asset_id") > record["high"]).alias("last")).first()
    runs = failure_runs(log.select(F.lit(0).alias("log"), "asset_id", F.when(F.col("error").isNull(), "success").otherwise("failure").alias("status")),
                        ["log"], "asset_id", "status").agg(F.max("consecutive_failures")).first()[0]
    return max(runs, before + ends["first"]), ends["last"]


def build(store: IndexStore, assets: DataFrame, encoder: Encoder, manifest: Manifest, candidates: DataFrame | None = None, fresh: bool = False,
          rows_a_slice: int = 100_000, cancellation: Cancellation | None = None, progress: Callable[[Checkpoint], None] | None = None,
          reuse: bool = True) -> Manifest | Checkpoint:
    """assets (asset_id, payload binary, created_at, updated_at) to a published snapshot, slice by slice.

    Each slice is one job, whose entries are committed by a record of their own, and after each the checkpoint tells how many
    are done. What has been committed is not encoded again, so a build whose driver died, that failed or was cancelled goes
    on after its last slice; `fresh` drops it first. With `reuse`, entries of the published snapshot whose fingerprint
    is that of the asset, made by the same model, are carried over without encoding: only what was added or changed costs.
    Assets that can't be encoded are counted and passed over, but ABORT_AT in a row end the build, and a
    snapshot is published only if every candidate has an entry. Of repeated ids the newest asset counts, ties
    to the larger fingerprint; where ids are unique, no payload is shuffled.

    Cancelled before a slice, in it or after it, the build saves its checkpoint and returns it."""
    stop = Cancellation(store.spark) if cancellation is None else cancellation
    if fresh:
        store.clear_staged()
    named = assets.select("asset_id").where("length(asset_id) > 0")  # payloads are read slice by slice only
    if candidates is not None and not candidates.isEmpty():
        named = named.join(candidates.select("asset_id"), "asset_id", "left_semi")
    where, total = store.save_candidates(named.distinct())
    if not total:
        raise Nothing("there is no asset to index")
    unique = named.count() == total
    done = failed = 0

    def tell(stage: str, message: str | None = None) -> Checkpoint:
        c = Checkpoint(stage, (), min(done, total), total, message, where, failed)
        store.save_checkpoint(c)
        if progress:
            progress(c)
        return c

    try:
        ids = store.load_candidates(where)
        if reuse:
            _carry_over(store, assets, manifest)
        todo = ids
        if store.commits():
            todo = cut(ids.join(store.staged().select("asset_id"), "asset_id", "left_anti"), "todo")
            done = total - todo.count()
        tell("building")
        dealt, slices = slices_of(store, todo, total - done, rows_a_slice)
        in_a_row = 0
        for s in slices:
            if stop:
                return tell("building")
            todo = dealt.where(F.col("part").between(s.first, s.last)).select("asset_id")
            own = assets.where(F.col("asset_id").between(s.low, s.high)).join(F.broadcast(todo) if s.rows <= BROADCAST_IDS else todo, "asset_id", "left_semi")
            one = (own if unique else newest(own)).coalesce(store.spark.sparkContext.defaultParallelism)  # as many files as cores
            try:
                with stop.tagged():
                    record = store.stage(embed(one, "payload", encoder, keep_failures=True).select(
                        "asset_id", F.sha2("payload", 256).alias("fingerprint"), "embedding", "created_at", "updated_at", "error"), where.rpartition("-")[2] + f"-{s.first}")
            except Exception:
                if stop:
                    return tell("building")
                raise
            done, failed = done + record["done"], failed + record["failed"]
            longest, in_a_row = _failures_in_a_row(store, record, in_a_row)
            tell("building")
            if longest >= ABORT_AT:
                raise CorruptIndex(f"{longest} failures in a row")
        if stop:
            return tell("building")
        gate = missing(ids, store.staged()).first()
        if not gate["complete"]:
            raise CorruptIndex(f"{gate['missing']} assets have no entry")
        return store.save_snapshot(manifest, store.staged().join(ids, "asset_id", "left_semi"))
    except Exception as e:
        tell("failed", str(e)[:500])
        raise


def _carry_over(store: IndexStore, assets: DataFrame, manifest: Manifest) -> None:
    """Stages entries of the published snapshot that still hold: same model, same fingerprint of the payload."""
    found = store.load_snapshot()
    if found is None or any(getattr(found[0], k) != getattr(manifest, k) for k in ("model_fingerprint", "resource_fingerprint", "embedding_dimension")):
        return
    changes = change_set(found[1], assets)
    same = changes.where("change = 'same'").select("asset_id")
    carried = found[1].join(same, "asset_id", "left_semi").join(store.staged().select("asset_id"), "asset_id", "left_anti")
    store.stage(carried)


def newest(assets: DataFrame) -> DataFrame:
    """One asset of each id: the newest, ties to the larger fingerprint."""
    kept = F.max_by(F.struct("payload", "created_at", "updated_at"), F.struct("updated_at", F.sha2("payload", 256)))
    return assets.groupBy("asset_id").agg(kept.alias("a")).select("asset_id", "a.*")


def change_set(entries: DataFrame, assets: DataFrame) -> DataFrame:
    """(asset_id, change: added, changed, removed or same), by the fingerprint of the newest payload of each id."""
    own = assets.select("asset_id", "updated_at", F.sha2("payload", 256).alias("now"))  # payloads stay where they are
    now = own.groupBy("asset_id").agg(F.max(F.struct("updated_at", "now")).alias("m")).select("asset_id", "m.now")
    change = (F.when(F.col("fingerprint").isNull(), "added").when(F.col("now").isNull(), "removed")
              .when(F.col("now") == F.col("fingerprint"), "same").otherwise("changed"))
    return entries.select("asset_id", "fingerprint").join(now, "asset_id", "full_outer").select("asset_id", change.alias("change"))


def resume(store: IndexStore, assets: DataFrame, encoder: Encoder, manifest: Manifest, **how) -> Manifest | Checkpoint | None:
    """Goes on with a build that was stopped: only if the checkpoint says that one is being built, for its candidates alone. Without
    one, what is published; if no candidate is among the assets any more, nothing, and what was staged is dropped."""
    c = store.load_checkpoint()
    if c is None or c.stage != "building":
        return store.load_manifest()
    ids = store.load_candidates(c.candidates) if c.candidates else store.spark.createDataFrame([(i,) for i in c.candidate_ids], "asset_id string")
    named = assets.select("asset_id")
    if (named if ids.isEmpty() else named.join(ids, "asset_id", "left_semi")).isEmpty():
        store.clear_staged()
        return None
    return build(store, assets, encoder, manifest, cut(ids, "candidates"), **how)


def add_and_rebuild(store: IndexStore, new: DataFrame, payloads: Callable[[DataFrame], DataFrame], encoder: Encoder, manifest: Manifest, **how) -> Manifest | Checkpoint:
    """Puts assets (ASSET) into the catalog and brings the index up to it. payloads adds payload to catalog rows."""
    store.upsert_catalog(new)
    return rebuild(store, payloads, encoder, manifest, **how)


def rebuild(store: IndexStore, payloads: Callable[[DataFrame], DataFrame], encoder: Encoder, manifest: Manifest, **how) -> Manifest | Checkpoint:
    """The index of the whole catalog: what was staged before is dropped, entries that still hold are carried over."""
    return build(store, payloads(store.load_catalog()), encoder, manifest, **{"fresh": True} | how)


def stage_stream(spark: SparkSession, source: str, schema: str, store: IndexStore, encoder: Encoder, state: str, files_a_batch: int = 12):
    """Encodes files of assets as they arrive and stages them: only ids that are not staged yet are encoded, and a micro-batch
    that is given again after its commit is passed over. Returns the query."""

    def each(batch: DataFrame, number: int) -> None:
        name = f"batch-{hashlib.sha256(state.encode()).hexdigest()[:16]}-{number}"
        if store.committed(name):
            return
        fresh = newest(batch).join(store.staged().select("asset_id"), "asset_id", "left_anti")
        store.stage(embed(fresh, "payload", encoder, keep_failures=True).select(
            "asset_id", F.sha2("payload", 256).alias("fingerprint"), "embedding", "created_at", "updated_at", "error"), name)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start()


def latest_metrics_stream(events: DataFrame, name: str):
    """The last value of each key, kept up to date in a memory table. events: key, at, value, as a stream."""
    last = events.groupBy("key").agg(F.max(F.struct("at", "value")).alias("m")).select("key", "m.at", "m.value")
    return last.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()


def keep_latest_metrics(events: DataFrame, root: str):
    """Keeps the last value of each key in a folder: a micro-batch is reduced by itself and written, and one that is done over
    replaces itself. events: key, at, value, as a stream."""

    def each(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("key").agg(F.max(F.struct("at", "value")).alias("m")).select("key", "m.at", "m.value")
        last.write.mode("overwrite").parquet(f"{root}/metrics/batch={number}")

    return events.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()


def latest_metrics(spark: SparkSession, root: str) -> DataFrame:
    """(key, at, value): the last value of each key, of what the batches left."""
    rows = spark.read.option("basePath", f"{root}/metrics").parquet(f"{root}/metrics")
    return rows.groupBy("key").agg(F.max(F.struct("at", "value")).alias("m")).select("key", "m.at", "m.value")
