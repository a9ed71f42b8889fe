"""Density-based clustering over a table of similarity edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.session import cut
from .search import similarity_join


@dataclass(frozen=True)
class Preset:
    threshold: float
    min_neighbors: int


#: The three strengths of clustering.
LENIENT, BALANCED, STRICT = Preset(0.75, 2), Preset(0.80, 3), Preset(0.85, 4)


def numbered(roots: DataFrame) -> DataFrame:
    """(root, cluster): the distinct roots numbered from 1 in their order. Roots are sorted by ranges and numbered within
    each part; only one row for each part meets the others."""
    dealt = cut(roots.repartitionByRange("root").withColumn("part", F.spark_partition_id()))
    before = dealt.groupBy("part").agg(F.min("root").alias("low"), F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("root"))
    return dealt.join(before, "part").select("root", (F.col("before") + nth).cast("int").alias("cluster"))


def dbscan(points: DataFrame, edges: DataFrame, min_neighbors: int, id_col: str = "vec_id",
           degrees: DataFrame | None = None) -> DataFrame:
    """(id, cluster): clusters are numbered from 1 by the smallest id of their core points, -1 is noise.

    edges: (src, dst) in both directions. A core point has min_neighbors or more, by its edges or by
    degrees (src, n) where points stand for several rows. Cores are joined by label propagation
    with pointer jumping, a written table each round; a border point goes to the lowest-numbered cluster beside it."""
    if degrees is None:
        degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    cores = degrees.where(F.col("n") >= min_neighbors).select(F.col("src").alias("id"))
    cores = cut(cores)
    links = cut(edges.join(cores.select(F.col("id").alias("src")), "src", "left_semi").join(cores.select(F.col("id").alias("dst")), "dst", "left_semi"))
    label = cores.withColumn("root", F.col("id"))
    while True:
        low = links.join(label.select(F.col("id").alias("dst"), "root"), "dst").groupBy("src").agg(F.min("root").alias("low"))
        near = label.join(low, label["id"] == low["src"], "left").select("id", "root", F.least("root", F.coalesce("low", "root")).alias("new"))
        jump = label.select(F.col("id").alias("new"), F.col("root").alias("up"))
        nxt = cut(near.join(jump, "new").select("id", F.least("new", "up").alias("root"), (F.least("new", "up") != F.col("root")).alias("moved")))
        label = nxt.select("id", "root")
        if not nxt.where("moved").limit(1).count():
            break
    core = label.join(numbered(label.select("root").distinct()), "root").select("id", "cluster")
    border = (edges.join(core.select(F.col("id").alias("dst"), "cluster"), "dst").groupBy("src").agg(F.min("cluster").alias("beside")))
    return (points.select(F.col(id_col).alias("id")).join(core, "id", "left").join(border, F.col("id") == F.col("src"), "left")
            .select("id", F.coalesce("cluster", "beside", F.lit(-1)).cast("int").alias("cluster")))


class NothingToCluster(ValueError):
    """There is no index, or it is empty."""


def cluster_index(entries: DataFrame | None, preset: Preset = BALANCED, id_col: str = "asset_id", vec_col: str = "embedding") -> DataFrame:
    """clusters() of an index's entries at a preset's strength; NothingToCluster without an index or without entries."""
    if entries is None:
        raise NothingToCluster("no index has been built")
    if entries.isEmpty():
        raise NothingToCluster("the index is empty")
    return clusters(cluster_vectors(entries, preset.threshold, preset.min_neighbors, id_col, vec_col), preset.threshold)


def cluster_vectors(index: DataFrame, threshold: float, min_neighbors: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster) of dbscan() over all edges of a similarity self-join.

    Rows of equal vectors have the same neighbours: the one with the smallest id stands for them all, with their number.
    Rows whose vector is null, empty or not finite are noise."""
    v = F.col(vec_col)
    reps = cut(index.where(V.is_valid(v)).groupBy(v).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("n")))
    edges = cut(similarity_join(reps, threshold, id_col, vec_col).select("src", "dst"))
    near = edges.join(reps.select(F.col(id_col).alias("dst"), "n"), "dst").groupBy("src").agg(F.sum("n").alias("near"))
    itself = F.when(F.exists(v, lambda x: x != 0), 1.0).otherwise(0.0)
    degrees = reps.select(F.col(id_col).alias("src"), F.when(itself >= threshold, F.col("n") - 1).otherwise(0).alias("equal")).join(near, "src", "left").select(
        "src", (F.col("equal") + F.coalesce("near", F.lit(0))).alias("n"))
    labels = dbscan(reps, edges, min_neighbors, id_col, degrees)
    classes = reps.select(F.col(id_col).alias("_rep"), v.alias("_v")).join(labels.withColumnRenamed("id", "_rep"), "_rep")
    return index.select(F.col(id_col).alias("id"), v.alias("_v")).join(classes, "_v", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def clusters(labels: DataFrame, threshold: float, members: bool = True) -> DataFrame:
    """(cluster, size, center_id: the first member, members, similarity_score: the threshold), for clusters, not noise.

    A cluster's members in one row suit small clusters only; without `members` there are aggregates alone, and
    members_of() has a row each."""
    lists = [F.sort_array(F.collect_list("id")).alias("members")] if members else []
    return labels.where("cluster > 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("center_id"), *lists).withColumn(
        "similarity_score", F.lit(threshold))


def members_of(labels: DataFrame, first: int | None = None) -> DataFrame:
    """(cluster, id), or with `first` (cluster, nth, id) of the first members of each cluster, which Spark finds in each task before
    the shuffle, however large a cluster is."""
    own = labels.where("cluster > 0").select("cluster", "id")
    if first is None:
        return own
    return own.withColumn("nth", F.row_number().over(Window.partitionBy("cluster").orderBy("id"))).where(F.col("nth") <= first).select("cluster", "nth", "id")


def statistics(labels: DataFrame) -> DataFrame:
    """One row: cluster_count, grouped_count, average_size (null without clusters)."""
    sizes = labels.where("cluster > 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("cluster_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("grouped_count"), F.avg("n").alias("average_size"))
