"""Helpers that the operators of this package share: durable cuts of lineage, table reading, graph components."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset, a session on one machine
    (tests) gets a temporary folder; on a cluster it is an error, for executors see no folder of the driver's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestar-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Computes df once into a Parquet table in the shared checkpoint folder: lost executors lose nothing, later reads
    start there, with only the columns they need."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Computes df once into a Parquet table in the shared folder, bucketed by `key`: a join or a grouping by it with as
    many shuffle partitions moves the other side alone. The catalog's entry goes at once, the files stay."""
    spark, called = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("compression", "zstd").option(
        "path", f"{shared_dir(spark)}/{called}").saveAsTable(called)
    got = spark.table(called).select("*")
    spark.sql(f"DROP TABLE {called}")
    return got


def with_rows(docs: DataFrame) -> DataFrame:
    """(row: a unique number, doc: all columns of docs): written once, so that numbers hold however often it is read."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(docs[c] for c in docs.columns)).alias("doc"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id for each node of `edges` (src, dst: long), by alternating large-star and small-star steps.

    Each round is two aggregations and two joins over the remaining edges, whose result is written to the shared folder. A node's neighbour list
    is never gathered: only its minimum is, so a hub with millions of edges is combined before the shuffle. Rounds grow
    with the logarithm of the number of nodes. Returns (node, component), nodes of `edges` only; no edges: no rows."""
    e = written(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst")
                .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "links")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour is linked to the smallest node of the neighbourhood
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.where("u > m").select("u", F.col("m").alias("v")))
                 .where("u > v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: smaller neighbours and the node itself are linked to the smallest of them
        small = (large.join(low2, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low2.select("u", F.col("m").alias("v"))).distinct())
        nxt = written(small, "stars")
        # ended: a set of stars, where no centre is itself a leaf
        done = nxt.groupBy("u").count().where("count > 1").isEmpty() and nxt.join(
            nxt.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        e = nxt
        if done:
            break
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("c")), "node", "left").select(
        "node", F.coalesce("c", "node").alias("component"))


def ranked(df: DataFrame, keys: list[str], order: str, salts: int | None = None) -> DataFrame:
    """Adds `rank`, a gapless 0-based number within each group of `keys`, without one task per group.

    A group is dealt into `salts` buckets (as many as shuffle partitions, 64 at least, so that one that holds most rows
    is spread over all tasks) by a hash of `order`, a unique column; ranks are numbered in each bucket and moved by the
    sizes of the buckets before it. So the order of ranks is (bucket, order), stable for the same rows."""
    salts = salts or max(64, partitions(df.sparkSession))
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)).cast("int"))
    sizes = dealt.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    inner = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(order)) - 1)
    return inner.join(before, [*keys, "_salt"]).withColumn(
        "rank", F.col("_r") + F.coalesce("_before", F.lit(0))).drop("_r", "_before", "_salt")


def labelled(labels: DataFrame, label: str, held_out: str, id_col: str = "doc_id") -> DataFrame:
    """(id, y): the labelled ids that aren't held out; of repeated ids the larger label."""
    return labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).where("id is not null and y in (0, 1)").where(
        ~F.expr(held_out.format(id="id"))).groupBy("id").agg(F.max("y").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: str, per_class: int,
                    id_col: str = "doc_id", text_col: str = "text", most_chars: int = 50_000) -> DataFrame:
    """(id, text, y): at most per_class labelled ids of each label that aren't held out, the smallest by a hash of the id;
    of a repeated id the smallest text, and no text of over most_chars. So the sample has a bounded size in bytes.

    The ids are chosen first, so that the texts are found by a join with a table of a bounded size, which is broadcast."""
    own = labelled(labels, label, held_out, id_col)
    few = None
    for k in (0, 1):
        part = own.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(per_class)
        few = part if few is None else few.union(part)
    got = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return got.where(F.length("text") <= most_chars).join(F.broadcast(few), "id").groupBy("id").agg(
        F.min("text").alias("text"), F.max(F.col("y").cast("int")).alias("y"))


def fitted(sample: DataFrame, fit) -> object:
    """What fit(texts, labels) returns for a sample of a bounded size, run in one task; None if a label is missing.

    Only the sample is sent to that task: the tables it comes from are read by as many tasks as they have parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        y = [r[2] for r in rows]
        model = fit([r[1] for r in rows], y) if len(set(y)) == 2 else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    got = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else None
