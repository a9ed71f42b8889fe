"""Operations on asset catalogs, build logs, histories and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts as T
from ..plans.session import cut

#: Entries that a history keeps, failures in a row that end a build, and scan limits.
HISTORY, ABORT_AT = 20, 10
SCAN_LIMITS, DEFAULT_SCAN = (1000, 3000, 5000, 10000, 20000, 0), 3000


def upsert(old: DataFrame, new: DataFrame, key: str = "asset_id", created: str = "created_at") -> DataFrame:
    """Catalog rows by trimmed key: new values win, the first creation time stays; rows without a key are dropped."""
    tidy = lambda d: d.withColumn(key, T.trimmed(F.col(key))).where(F.length(key) > 0)
    o, n = tidy(old).alias("o"), tidy(new).alias("n")
    pick = [F.coalesce(f"o.{key}", f"n.{key}").alias(key)]
    for c in old.columns:
        if c == key:
            continue
        first, second = ("o", "n") if c == created else ("n", "o")
        value = F.when(F.col(f"{first}.{key}").isNotNull(), F.col(f"{first}.{c}")).otherwise(F.col(f"{second}.{c}"))
        pick.append(value.alias(c))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*pick)


def recent(rows: DataFrame, at: str, tie: str, limit: int = DEFAULT_SCAN) -> DataFrame:
    """The newest `limit` rows; 0: all."""
    ordered = rows.orderBy(F.desc(at), tie)
    return ordered.limit(limit) if limit else ordered


def pending(assets: DataFrame, entries: DataFrame, key: str = "asset_id", candidates: DataFrame | None = None) -> DataFrame:
    """Assets without an entry; with candidates, only those, and no candidates at all mean every asset."""
    left = assets
    if candidates is not None and not candidates.isEmpty():
        left = left.join(candidates.select(key), key, "left_semi")
    return left.join(entries.select(key), key, "left_anti")


def missing(candidates: DataFrame, entries: DataFrame, key: str = "asset_id") -> DataFrame:
    """(missing: long, complete: boolean), the gate before an index is published."""
    return candidates.join(entries.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("missing")).withColumn("complete", F.col("missing") == 0)


def payloads(assets: DataFrame, store: DataFrame, library_col: str, granted: Column, key: str) -> DataFrame:
    """assets with their payload columns, and `reason` where there is none: unreadable, expired or no access."""
    found = store.withColumn("_found", F.lit(True))
    d = assets.join(found, assets[library_col] == found[key], "left")
    reason = (F.when(~T.is_backed(F.col(library_col).cast("string")), "unreadable").when(F.col("_found"), F.lit(None))
              .when(granted, "expired").otherwise("no access"))
    return d.withColumn("reason", reason).drop("_found")


def failure_runs(log: DataFrame, by: list[str], order: str, status: str) -> DataFrame:
    """Adds consecutive_failures and abort to a build log: successes reset the count, cancellations neither count nor reset;
    abort from the tenth failure in a row.

    Each range of a log is counted by itself, and takes over what the ranges before it left: no task meets a whole log."""
    dealt = _in_ranges(log, *by, order)
    so_far = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = dealt.withColumn("_failed", F.sum(F.when(F.col(status) == "failure", 1).otherwise(0)).over(so_far))
    d = d.withColumn("_reset", F.max(F.when(F.col(status) == "success", F.col("_failed"))).over(so_far))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy(*by, "_part").agg(F.max("_failed").alias("_n"), F.max("_reset").alias("_last"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    parts = parts.withColumn("_carried", F.col("_before") - F.coalesce(F.max(F.col("_before") + F.col("_last")).over(earlier), F.lit(0)))
    left, right = d.alias("d"), parts.alias("p")
    met = F.col("d._part") == F.col("p._part")
    for c in by:
        met = met & F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}"))
    n = F.col("_failed") + F.coalesce(-F.col("_reset"), F.col("_carried"))
    return left.join(right, met).select("d.*", n.cast("long").alias("consecutive_failures"), (n >= ABORT_AT).alias("abort")).drop(
        "_part", "_failed", "_reset")


def _in_ranges(rows: DataFrame, *by: str) -> DataFrame:
    """rows with _part, the number of their range of `by`; written, so that a row's part stays what it is."""
    return cut(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranges")


def with_offsets(rows: DataFrame, by: list[str], order: str, size: str, name: str = "offset") -> DataFrame:
    """rows with the sum of `size` over the rows before them in their group. Ranges are summed by themselves, and one row of each
    meets the others of its group."""
    dealt = _in_ranges(rows, *by, order)
    before = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*by, "_part").agg(F.sum(size).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inner = dealt.withColumn(name, F.coalesce(F.sum(size).over(before), F.lit(0)))
    return inner.join(parts, [*by, "_part"]).withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def with_previous(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """rows with the value of the row before, null for the first. Ranges are sorted by themselves; one row of each meets
    the next range."""
    dealt = _in_ranges(rows, order)
    lasts = dealt.groupBy("_part").agg(F.max_by(F.struct(value), F.struct(order))[value].alias("_last"))
    carried = lasts.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_carried"))
    w = Window.partitionBy("_part").orderBy(order)
    d = dealt.withColumn("_nth", F.row_number().over(w)).withColumn(name, F.lag(value).over(w)).join(F.broadcast(carried), "_part")  # a row a range
    return d.withColumn(name, F.when(F.col("_nth") == 1, F.col("_carried")).otherwise(F.col(name))).drop("_part", "_nth", "_carried")


def restored_state(stage: Column, has_progress: Column, has_manifest: Column) -> Column:
    """The state to start in: an unfinished build goes on (as preparing, if it had no progress yet), a failure stays one,
    and whatever else is ready if there is a manifest, idle if not. stage is null without a checkpoint."""
    return (F.when(stage == "building", F.when(has_progress, "building").otherwise("preparing")).when(stage == "failed", "failed")
            .when(has_manifest, "ready").otherwise("idle"))


def history(searches: DataFrame, query: str = "query", at: str = "ts", tie: str = "event_id", keep: int = HISTORY) -> DataFrame:
    """The newest entry of each trimmed, non-empty query; of these the newest `keep`."""
    d = searches.withColumn(query, T.trimmed(F.col(query))).where(F.length(query) > 0)
    newest = d.groupBy(query).agg(F.max_by(F.struct(*d.columns), F.struct(at, tie)).alias("_row")).select("_row.*")
    return newest.orderBy(F.desc(at), F.desc(tie)).limit(keep)


def latest(metrics: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """The last value of each key, combined before the shuffle."""
    return metrics.groupBy(key).agg(F.max(F.struct(at, tie, value)).alias("m")).select(key, f"m.{at}", f"m.{value}")


def tally(log: DataFrame, status: str, *by: str) -> DataFrame:
    """succeeded, failed, completed: one row, or one for each source, say, of an import."""
    return log.groupBy(*by).agg(F.count_if(F.col(status) == "success").alias("succeeded"), F.count_if(F.col(status) == "failure").alias("failed"),
                   F.count_if(F.col(status).isin("success", "failure")).alias("completed"))


#: Words in a failure message, in the order in which they are looked for, and what kind of failure they tell.
FAILURE_RULES = (
    (("模型", "推理"), "model"),
    (("存储", "vectors", "manifest"), "storage"),
    (("系统相册", "相册"), "library"),
    (("资源", "sidecar", "不可读"), "resource"),
    (("图片", "输入"), "input"),
)


def failure_kind(message: Column) -> Column:
    """The first rule that a trimmed message meets; unfinished for an empty one, other for none."""
    m = T.trimmed(message)
    out = F.when(F.coalesce(F.length(m), F.lit(0)) == 0, "unfinished")
    for words, kind in FAILURE_RULES:
        met = F.lit(False)
        for w in words:
            met = met | F.contains(m, F.lit(w))
        out = out.when(met, kind)
    return out.otherwise("other")


def budget(parts: DataFrame, kind: str, amount: str) -> DataFrame:
    """One row per kind (memory, disk ...) with its total, and the total of all in every row."""
    per = parts.groupBy(kind).agg(F.sum(amount).alias("total"))
    return per.crossJoin(F.broadcast(parts.agg(F.sum(amount).alias("all"))))  # one row


def can_cluster(state: Column, indexed: Column) -> Column:
    """Ready, or built in part with at least one entry."""
    return F.coalesce((state == "ready") | (state.isin("building", "preparing", "failed") & (indexed > 0)), F.lit(False))
