"""Nearest-neighbour search, similarity self-join and what is done to ranked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.session import cut, partitions

#: Results of an engine search and of the views, and the adaptive cutoff's tiers.
ENGINE_TOP_K, VIEW_TOP_K = 12, 30
HIGH, FAIR = 0.8, 0.6
MOST_HIGH, MOST_FAIR, MOST_OTHER = 25, 20, 15

#: Vectors of a block of a search or join, and bytes of queries that are broadcast to where the index is read.
BLOCK, BROADCAST_BYTES = 4096, 32 << 20


class SearchError(ValueError):
    """A query that can't be answered: empty, not finite, of another dimension, or for no rows."""


def checked_query(query: list[float], k: int, dim: int | None = None) -> np.ndarray:
    q = np.asarray(query, np.float64)
    if q.ndim != 1 or not len(q) or not np.isfinite(q).all():
        raise SearchError("a query is a vector of finite numbers")
    if k <= 0:
        raise SearchError("k must be positive")
    if dim is not None and len(q) != dim:
        raise SearchError(f"the index has dimension {dim}, the query {len(q)}")
    return q


def top_k(index: DataFrame, query: list[float], k: int = ENGINE_TOP_K, id_col: str = "vec_id", vec_col: str = "embedding",
          metric: str = "cosine") -> DataFrame:
    """The k best rows for one query, as (id, score): ties to smaller ids; metric: cosine, dot or euclidean.

    An expression, so the plan is a scan and a TakeOrderedAndProject: no shuffle of the index."""
    q = F.lit(checked_query(query, k).tolist())
    score = {"cosine": V.cosine, "dot": V.dot, "euclidean": V.euclidean}[metric](F.col(vec_col), q)
    best = F.asc("score") if metric == "euclidean" else F.desc("score")
    return index.select(F.col(id_col).alias("id"), score.alias("score")).orderBy(best, "id").limit(k)


def vector_blocks(rows: DataFrame, id_col: str, vec_col: str, size: int | None = None, kept: bool = True, unit: bool = True) -> DataFrame:
    """(b: a number, dim, ids, v: a matrix of unit vectors, or of the vectors as they are) of at most BLOCK vectors of one length
    each, written once if `kept`. Vectors that are null, empty or not finite are left out; a zero vector stays one."""
    size = size or BLOCK
    v = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(V.is_valid("v"))

    def block(held: list[pa.RecordBatch], dim: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        x = np.asarray(t.column("v").chunk(0).flatten(), np.float64).reshape(-1, dim)
        x = _unit(x) if unit else x
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.ListArray.from_arrays([0, len(x)], t.column("id").chunk(0)), pa.array([x.tobytes()], pa.binary())], ["dim", "ids", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            dims = np.diff(b.column("v").offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                while part.num_rows:
                    own = held.setdefault(dim, [])
                    now = part.slice(0, size - sum(h.num_rows for h in own))
                    own.append(now)
                    part = part.slice(now.num_rows)
                    if sum(h.num_rows for h in own) == size:
                        yield block(held.pop(dim), dim)
        for dim, own in held.items():
            yield block(own, dim)

    kind = rows.schema[id_col].dataType.simpleString()
    made = v.mapInArrow(run, f"dim int, ids array<{kind}>, v binary").select(F.monotonically_increasing_id().alias("b"), "*")
    return cut(made, "blocks") if kept else made


def _side(blocks: DataFrame, name: str) -> DataFrame:
    return blocks.select(*(F.col(c).alias(f"{name}_{c}") for c in ("b", "ids", "v")), "dim")


def _dealt(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of blocks of one dimension, by an equi-join: left blocks are dealt into g groups and right ones into h, g * h
    cells for as many tasks, and each block goes once to every cell of its row or column."""
    tasks = partitions(left.sparkSession)
    n, m = left.count(), right.count()
    g = max(1, min(n, tasks, -(-tasks // max(1, min(m, int(tasks ** 0.5))))))
    h = max(1, min(m, -(-tasks // g)))
    group = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    one = _side(left, "l").withColumn("p", group("l_b", g)).withColumn("q", every(h))
    two = _side(right, "r").withColumn("q", group("r_b", h)).withColumn("p", every(g))
    return one.join(two, ["p", "q", "dim"]).drop("p", "q")


def _dealt_once(blocks: DataFrame) -> DataFrame:
    """All pairs of a block and another or itself, each once: as _dealt, with the cells on one side of the diagonal."""
    tasks = partitions(blocks.sparkSession)
    g = max(1, min(blocks.count(), int((2 * tasks) ** 0.5)))
    one, two = (_side(blocks, k).withColumn(c, F.pmod(F.xxhash64(f"{k}_b"), F.lit(g)).cast("int")) for k, c in (("l", "p"), ("r", "q")))
    one = one.withColumn("q", F.explode(F.sequence(F.col("p"), F.lit(g - 1))))
    two = two.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("q"))))
    return one.join(two, ["p", "q", "dim"]).where("p < q or l_b <= r_b").drop("p", "q")


def _matrices(b: pa.RecordBatch, i: int) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    dim = b.column("dim")[i].as_py()
    side = lambda k: (b.column(f"{k}_ids")[i].values, np.frombuffer(b.column(f"{k}_v")[i].as_buffer()).reshape(-1, dim))
    return *side("l"), *side("r")


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _asked(index: DataFrame, queries: DataFrame, id_col: str, vec_col: str, unit: bool = True) -> DataFrame:
    """Pairs of a block of the index and a block of queries: queries are broadcast if they measure little, else both are dealt."""
    q = vector_blocks(queries, id_col, vec_col, unit=unit)
    shortest, longest, size = q.agg(F.min("dim"), F.max("dim"), F.sum(F.octet_length("v"))).first()
    if shortest != longest:
        raise SearchError(f"vectors asked have dimensions from {shortest} to {longest}")
    if (size or 0) <= BROADCAST_BYTES:
        return _side(vector_blocks(index, id_col, vec_col, kept=False, unit=unit), "l").join(F.broadcast(_side(q, "r")), "dim")
    return _dealt(q if index is queries else vector_blocks(index, id_col, vec_col, unit=unit), q)


def batch_top_k(index: DataFrame, queries: DataFrame, k: int = ENGINE_TOP_K, id_col: str = "vec_id", vec_col: str = "embedding",
                exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the k best by cosine for each query, ties to smaller ids.

    Queries are written as blocks. If they measure no more than BROADCAST_BYTES they are broadcast, and the index stays where it
    is read; else both sides are dealt as blocks. Pairs of blocks are multiplied in tasks; a pair gives k rows a query, of
    which Spark keeps the first k of a task before the shuffle. Rows whose vector is null, not finite or of another length
    than the queries' take no part; queries must be of one length."""
    kind, asked = index.schema[id_col].dataType.simpleString(), queries.schema[id_col].dataType.simpleString()
    pairs = _asked(index, queries, id_col, vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                l_ids, x, r_ids, y = _matrices(b, i)
                ids, own = np.array(l_ids.to_pylist()), np.array(r_ids.to_pylist())
                of, to, scores = [], [], []
                for at in range(0, len(y), 256):
                    s = y[at:at + 256] @ x.T
                    for j, row in enumerate(s, at):
                        near = np.arange(len(row))
                        if len(row) > 4 * k:
                            near = np.flatnonzero(row >= np.partition(row, -(k + 1))[-(k + 1)] - 1e-9)
                        if exclude_self:
                            near = near[ids[near] != own[j]]
                        exact = np.round((x[near] * y[j]).sum(1), 12)
                        top = np.lexsort((ids[near], -exact))[:k]
                        of.append(np.full(len(top), j))
                        to.append(near[top])
                        scores.append(exact[top])
                of, to, scores = (np.concatenate(c) for c in (of, to, scores))
                yield pa.RecordBatch.from_arrays([r_ids.take(pa.array(of)), l_ids.take(pa.array(to)), pa.array(scores)], ["query_id", "id", "score"])

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.mapInArrow(run, f"query_id {asked}, id {kind}, score double").withColumn("rank", F.row_number().over(w)).where(
        F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _near_pairs(index: DataFrame, threshold: float, id_col: str, vec_col: str, answer, schema: str) -> DataFrame:
    """What answer(ids, other ids, places, other places, scores) gives for each pair of blocks with the pairs of rows whose cosine
    is at least threshold, each pair of different rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                l_ids, x, r_ids, y = _matrices(b, n)
                same, ids, own = b.column("l_b")[n] == b.column("r_b")[n], np.array(l_ids.to_pylist()), np.array(r_ids.to_pylist())
                for at in range(0, len(x), 512):
                    i, j = np.nonzero(x[at:at + 512] @ y.T >= threshold - 1e-9)
                    i += at
                    keep = (ids[i] != own[j]) & ((i < j) if same else True)
                    i, j = i[keep], j[keep]
                    score = np.concatenate([(x[i[c:c + 65536]] * y[j[c:c + 65536]]).sum(1) for c in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
                    fine = np.round(score, 12) >= threshold
                    yield from answer(l_ids, r_ids, i[fine], j[fine], score[fine])

    return _dealt_once(vector_blocks(index, id_col, vec_col)).mapInArrow(run, schema)


def similarity_join(index: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", most: int | None = None) -> DataFrame:
    """(src, dst, score) in both directions for pairs of rows with cosine >= threshold, a row never with itself.

    With `most`, the best that many of each row, as a clustering that asks for a bounded number of neighbours. Each pair
    of blocks is multiplied once, in a task. Vectors that are null or not finite take no part, nor pairs of unequal length."""
    kind = index.schema[id_col].dataType.simpleString()

    def answer(l_ids, r_ids, i, j, score):
        a, b = l_ids.take(pa.array(i)), r_ids.take(pa.array(j))
        for src, dst in ((a, b), (b, a)):
            yield pa.RecordBatch.from_arrays([src, dst, pa.array(score)], ["src", "dst", "score"])

    found = _near_pairs(index, threshold, id_col, vec_col, answer, f"src {kind}, dst {kind}, score double")
    if most is not None:
        w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
        found = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
    return found


def neighbor_counts(index: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, neighbors) of rows that have any: similarity_join counted in the tasks, so that no pair leaves them."""
    kind = index.schema[id_col].dataType.simpleString()

    def answer(l_ids, r_ids, i, j, score):
        for ids, places in ((l_ids, i), (r_ids, j)):
            at, n = np.unique(places, return_counts=True)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(n)], ["id", "n"])

    return _near_pairs(index, threshold, id_col, vec_col, answer, f"id {kind}, n long").groupBy("id").agg(F.sum("n").alias("neighbors"))


def adaptive_cutoff(ranked: DataFrame, by: list[str], score: str = "score", order: list[Column] | None = None) -> DataFrame:
    """Of each ranked list: with a best score of 0.8 or more, scores from 0.6 on, 25 at most; from 0.6 on the first 20;
    else the first 15.

    No rule keeps more than the first 25, which Spark finds in each task before the shuffle; as lists are ordered by their
    scores, or so that the best is among these, the best score is theirs."""
    w = Window.partitionBy(*by)
    first = ranked.withColumn("_r", F.row_number().over(w.orderBy(*(order or [F.desc(score)])))).where(F.col("_r") <= max(MOST_HIGH, MOST_FAIR, MOST_OTHER))
    d = first.withColumn("_best", F.max(score).over(w))
    keep = (F.when(F.col("_best") >= HIGH, (F.col(score) >= FAIR) & (F.col("_r") <= MOST_HIGH))
            .when(F.col("_best") >= FAIR, F.col("_r") <= MOST_FAIR).otherwise(F.col("_r") <= MOST_OTHER))
    return d.where(keep).drop("_best", "_r")


def lookup(index: DataFrame, ids: DataFrame | list, id_col: str = "vec_id") -> DataFrame:
    """Rows by id: a pushed-down filter for a list, a semi-join for a table."""
    return index.where(F.col(id_col).isin(ids)) if isinstance(ids, list) else index.join(ids.select(id_col), id_col, "left_semi")


def lsh_top_k(index: DataFrame, queries: DataFrame, k: int = ENGINE_TOP_K, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = 96,
              bits: int = 7, seed: int = 1) -> DataFrame:
    """Approximate batch_top_k: rows meet queries that lie on the same side of all `bits` random planes of some table.

    Blocks of vectors meet as in batch_top_k. In the task of a pair of blocks, rows that share a table's key with a query are
    its candidates; they are measured exactly and the first k leave the task, so that neither keys nor pairs are shuffled. A row of cosine c
    meets a query in a table with probability (1 - acos(c) / pi) ** bits: more bits, with more tables, measure fewer rows."""
    kind, asked = index.schema[id_col].dataType.simpleString(), queries.schema[id_col].dataType.simpleString()
    narrow = np.min_scalar_type((1 << bits) - 1)

    def keys(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
        """(tables, rows): the side of the planes of each table."""
        side = (x @ planes.T > 0).reshape(len(x), tables, bits) @ (1 << np.arange(bits))
        return np.ascontiguousarray(side.T.astype(narrow))

    def added(x: np.ndarray) -> np.ndarray:
        """Sums of rows from left to right, as Spark's expressions add."""
        return np.add.accumulate(x, axis=1)[:, -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for b in batches:
            for i in range(b.num_rows):
                l_ids, x, r_ids, y = _matrices(b, i)
                if planes is None or planes.shape[1] != x.shape[1]:
                    planes = np.random.default_rng(seed).normal(size=(tables * bits, x.shape[1]))
                ids, theirs, ours = np.array(l_ids.to_pylist()), keys(x, planes), keys(y, planes)
                unit, length, far = _unit(x), np.sqrt(added(x * x)), np.sqrt(added(y * y))
                of, to, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
                for at in range(0, len(y), 256):
                    met = np.zeros((len(y[at:at + 256]), len(x)), bool)
                    for t in range(tables):
                        met |= ours[t, at:at + 256, None] == theirs[t]
                    s = np.where(met, _unit(y[at:at + 256]) @ unit.T, -np.inf)
                    for j, row in enumerate(s, at):
                        near = np.flatnonzero(row > -np.inf)
                        if len(near) > 4 * k:
                            near = near[row[near] >= np.partition(row[near], -k)[-k] - 1e-9]
                        size = length[near] * far[j]
                        exact = np.divide(added(x[near] * y[j]), size, out=np.zeros(len(near)), where=size > 0)
                        top = np.lexsort((ids[near], -exact))[:k]
                        of.append(np.full(len(top), j))
                        to.append(near[top])
                        scores.append(exact[top])
                of, to, scores = (np.concatenate(c) for c in (of, to, scores))
                yield pa.RecordBatch.from_arrays([r_ids.take(pa.array(of)), l_ids.take(pa.array(to)), pa.array(scores)], ["query_id", "id", "score"])

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return _asked(index, queries, id_col, vec_col, unit=False).mapInArrow(run, f"query_id {asked}, id {kind}, score double").withColumn(
        "rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
