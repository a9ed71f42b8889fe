"""Hard negatives by a pivot table.

Components are scaled and rounded down, so scores are integers. A vector x gets one more component, sqrt(M^2 - |x|^2), where M is
the largest length, and an anchor q the component 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so a nearer row is one of a larger
inner product. For some pivots, chosen far from each other in a sample of `sampled` rows (the smallest by a hash of the id),
every row's distances are stored. By the triangle inequality, an anchor's distance to a row lies between the largest
difference and the smallest sum of their distances to a pivot: this brackets the score, and only rows whose bracket allows
them among the first are measured, in exact arithmetic.

Rows are written as blocks, sorted by label, with their pivot distances. Anchors are dealt in blocks too. If they measure no
more than BROADCAST_BYTES they are broadcast, each once; else each goes once to every group of row blocks by a join on the
group's number that shuffles both sides, so that copies for many groups never pass through the driver. A pair of blocks gives at most k rows for an anchor, or for each of its positives, and Spark keeps the first k of each
task before the shuffle.

Defined results: rows whose id or label is null, or whose vector is null or empty or holds a null or non-finite component,
or hasn't the commonest length (of equally common ones the shortest), take no part. Repeated ids: each row is an anchor,
a positive and a negative of its own, but rows of the anchor's id are not its positives; equal scores and ids
stand in for each other. Scores that need more than 64 bits are an error. An empty table gives no rows; other columns
are not read. Positives of negative score have no negatives, as their range is empty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, written

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Integers up to here, and sums of them, are exact in double precision.
EXACT = float(1 << 53)
#: Bytes of anchors that are broadcast, which the driver holds meanwhile.
BROADCAST_BYTES = 16 << 20


def usable(rows: DataFrame, id_col: str, label_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, label, v: array<double>, scaled but not yet rounded) of the rows that take part."""
    v = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v")).where(
        "id is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    common = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("v") == (common["n"] if common else 0)).withColumn("v", F.transform("v", lambda x: x * F.lit(float(scale))))


def _matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    return np.floor(np.asarray(b.column(name).flatten(), np.float64).reshape(b.num_rows, -1))


def pivots_of(x: np.ndarray, m: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to `most` augmented rows of x, each the farthest from those before, and their last components."""
    last = np.sqrt(np.maximum(m * m - (x * x).sum(1), 0))
    full = np.column_stack([x, last])
    chosen, far = [0], ((full - full[0]) ** 2).sum(1)
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((full - full[chosen[-1]]) ** 2).sum(1))
    return full[chosen, :-1], full[chosen, -1]


def sample_of(v: DataFrame, most: int) -> list:
    """The `most` first rows (id, v, ...) by a hash of the id, cut in tasks: the driver gets these alone, however many tasks read v."""
    order, n = F.xxhash64("id"), v.count()
    if n > 4 * most:  # about four times as many come together, whatever n is
        few = v.where(order <= F.lit(int((8 * most / n - 1) * (1 << 63))))
        v = few if few.count() >= most else v
    got = written(v.withColumn("order", order).orderBy("order", "id", "v").limit(most), "sample")
    return sorted(got.collect(), key=lambda r: (r["order"], r["id"], r["v"]))


class Pivots:
    """Distances to the pivots, and the brackets of scores that they give."""

    def __init__(self, x: np.ndarray, m: float, most: int):
        self.m, (self.p, self.last) = m, pivots_of(x, m, most)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """(n, pivots): of augmented rows."""
        last = np.sqrt(np.maximum(self.m ** 2 - (x * x).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.m ** 2 - 2 * (x @ self.p.T + last[:, None] * self.last), 0))

    def anchors(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.m ** 2 - 2 * q @ self.p.T, 0))

    def bracket(self, q: np.ndarray, dq: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchors, rows): least and largest score possible, widened by what rounding can do."""
        near, far = np.abs(dq[:, :1] - d[:, 0]), dq[:, :1] + d[:, 0]
        for j in range(1, d.shape[1]):
            np.maximum(near, np.abs(dq[:, j:j + 1] - d[:, j]), out=near)
            np.minimum(far, dq[:, j:j + 1] + d[:, j], out=far)
        both = (q * q).sum(1)[:, None] + self.m ** 2
        margin = 1e-9 * both + 1
        return (both - far * far) / 2 - margin, (both - near * near) / 2 + margin


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers in doubles, exact: as doubles where sums stay small, else as Python's integers."""
    if not x.size or np.abs(x).max() * np.abs(q).max() * x.shape[1] < EXACT:
        return x @ q
    whole = lambda a: np.array([[int(c) for c in r] for r in a], object)
    return whole(x) @ np.array([int(c) for c in q], object)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first: larger scores, then smaller ids."""
    if len(score) > 4 * k and score.dtype != object:
        held = np.flatnonzero(score >= np.partition(score, -k)[-k])
        return held[np.lexsort((ids[held], -score[held]))[:k]]
    return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], np.int64)


def positives_in(rows: dict, anchors: dict, pivots: Pivots, k: int) -> Iterator[tuple[int, int, int]]:
    """(anchor's number, id, score): of rows of one label, the first k for each anchor of that label."""
    lo, hi = pivots.bracket(anchors["v"], pivots.anchors(anchors["v"]), rows["d"])
    own = anchors["ids"][:, None] == rows["ids"]
    lo[own] = hi[own] = -np.inf
    for i, (number, q) in enumerate(zip(anchors["numbers"].tolist(), anchors["v"])):
        least = np.partition(lo[i], -k)[-k] if lo.shape[1] > k else -np.inf
        left = np.flatnonzero((hi[i] >= least) & ~own[i])
        score, ids = products(rows["v"][left], q), rows["ids"][left]
        for at in _first(score, ids, k).tolist():
            yield number, int(ids[at]), int(score[at])


def ranges(scores: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """The integers n with low * score <= 100 * n <= high * score, for each score; empty ones too."""
    return [(-(-low * s // 100), high * s // 100) for s in scores]


def negatives_in(rows: dict, anchors: dict, pivots: Pivots, k: int, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor's number, which positive, id, score): of rows, the first k in the range of each positive."""
    lo, hi = pivots.bracket(anchors["v"], pivots.anchors(anchors["v"]), rows["d"])
    for i, (number, q, scores) in enumerate(zip(anchors["numbers"].tolist(), anchors["v"], anchors["scores"])):
        spans = [(n, a, b) for n, (a, b) in enumerate(ranges(scores, low, high)) if a <= b]
        if not spans:
            continue
        first, least, top, last = min(a for _, a, _ in spans), max(a for _, a, _ in spans), max(b for _, _, b in spans), min(b for _, _, b in spans)
        sure = lo[i][(lo[i] >= least) & (hi[i] <= last)]  # in every positive's range, whatever they measure
        if len(sure) >= k:
            first = max(first, np.partition(sure, -k)[-k])
        left = np.flatnonzero((hi[i] >= first) & (lo[i] <= top))
        score, ids = products(rows["v"][left], q), rows["ids"][left]
        inside = score[(score >= least) & (score <= last)]
        if len(inside) >= k and inside.dtype != object:
            held = score >= np.partition(inside, -k)[-k]
            score, ids = score[held], ids[held]
        for n, a, b in spans:
            held = np.flatnonzero((score >= a) & (score <= b))
            for at in held[_first(score[held], ids[held], k)].tolist():
                yield number, n, int(ids[at]), int(score[at])


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())


def blocks(rows: DataFrame, pivots: Pivots, size: int) -> DataFrame:
    """Rows of the table, `size` at most in one, sorted by label: ids, labels, vectors and pivot distances."""

    def block(held: list[tuple]) -> pa.RecordBatch:
        ids, labels, x = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((ids, labels))
        x = x[order]
        return pa.RecordBatch.from_arrays([_packed(ids[order]), _packed(labels[order]), _packed(x), _packed(pivots.rows(x))], ["ids", "labels", "v", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, size - n)
                b = b.slice(part.num_rows)
                held.append((part.column("id").to_numpy(), part.column("label").to_numpy(), _matrix(part, "v")))
                n += part.num_rows
                if n == size:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return rows.mapInArrow(run, "ids binary, labels binary, v binary, d binary")


def _read(r: dict, width: int, pivots: int) -> dict:
    return {"ids": np.frombuffer(r["ids"], np.int64), "labels": np.frombuffer(r["labels"], np.int64),
            "v": np.frombuffer(r["v"]).reshape(-1, width), "d": np.asfortranarray(np.frombuffer(r["d"]).reshape(-1, pivots))}


def _part(rows: dict, at: slice) -> dict:
    return {k: x[at] for k, x in rows.items()}


def _dealt(anchors: DataFrame, groups: int, size: int) -> DataFrame:
    """(g, ...): blocks of anchors, `size` at most in one, for each group of row blocks."""
    names = anchors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                cols = [_packed(part.column(n).to_numpy()) for n in ("number", "id", "label")] + [_packed(_matrix(part, "v"))]
                scores = [part.column("scores").to_pylist()] if "scores" in names else [[]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(scores, pa.list_(pa.list_(pa.int64())))], ["a_numbers", "a_ids", "a_labels", "a_v", "a_scores"])

    made = anchors.mapInArrow(run, "a_numbers binary, a_ids binary, a_labels binary, a_v binary, a_scores array<array<long>>")
    return made.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))


def _met(table: DataFrame, anchors: DataFrame, groups: int, size: int, few: bool) -> DataFrame:
    """All pairs of a block of rows and a block of anchors: with `few`, anchors are broadcast once and rows stay where they are
    read. Else the hint keeps Spark, which doesn't see that anchors are repeated for each group, from broadcasting them."""
    if few:
        return table.drop("g").crossJoin(F.broadcast(_dealt(anchors, 1, size).drop("g")))
    return table.join(_dealt(anchors, groups, size).hint("merge"), "g").drop("g")


def _pairs(table: DataFrame, anchors: DataFrame, groups: int, size: int, few: bool, width: int, pivots: Pivots, answer, schema: str) -> DataFrame:
    """What answer(rows of a label, whether it is the anchors', anchors of a label) gives for all pairs of blocks."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                rows = _read(r, width, len(pivots.p))
                numbers, ids, labels = (np.frombuffer(r[k], np.int64) for k in ("a_numbers", "a_ids", "a_labels"))
                q, found = np.frombuffer(r["a_v"]).reshape(-1, width), []
                for label in np.unique(labels).tolist():
                    a, z = np.searchsorted(rows["labels"], [label, label + 1])
                    all_own = np.flatnonzero(labels == label)
                    for at in range(0, len(all_own), 64):
                        own = all_own[at:at + 64]
                        some = {"numbers": numbers[own], "ids": ids[own], "v": q[own], "scores": [r["a_scores"][j] for j in own] if r["a_scores"] else None}
                        found.extend(answer(rows, slice(a, z), some))
                cols = list(zip(*found)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return _met(table, anchors, groups, size, few).mapInArrow(run, schema)


def hard_negatives(rows: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
                   id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", pivots: int = 16, sampled: int = 2000,
                   block: int = 8192, anchors_a_block: int = 512) -> DataFrame:
    """RESULT: for each row for which is_anchor, a condition on `id`, holds, and each of its first `positives` rows of the
    same label, the first `negatives` rows of other labels whose score is low to high percent of the positive's."""
    spark = rows.sparkSession
    v = written(usable(rows, id_col, label_col, vec_col, scale), "rows")
    sample = sample_of(v, sampled)
    if not sample:
        return spark.createDataFrame([], RESULT)
    longest = v.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (F.abs(x) + 1) * (F.abs(x) + 1))))).first()[0]  # rounding down adds less than 1
    width = len(sample[0]["v"])
    table = Pivots(np.floor(np.array([r["v"] for r in sample])), longest, pivots)
    made = written(blocks(v, table, block).withColumn("number", F.monotonically_increasing_id()), "blocks")
    groups = max(1, min(made.count(), partitions(spark)))
    made = made.withColumn("g", F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int")).drop("number")
    anchors = written(v.where(is_anchor).withColumn("number", F.monotonically_increasing_id()), "anchors")
    few = anchors.count() * width * 8 <= BROADCAST_BYTES

    def same(of: dict, own: slice, some: dict):
        return positives_in(_part(of, own), some, table, positives) if own.start < own.stop else ()

    def other(of: dict, own: slice, some: dict):
        for at in (slice(0, own.start), slice(own.stop, len(of["ids"]))):
            if at.start < at.stop:
                yield from negatives_in(_part(of, at), some, table, negatives, low, high)

    w = Window.partitionBy("number").orderBy(F.desc("score"), "id")
    good = written(_pairs(made, anchors, groups, anchors_a_block, few, width, table, same, "number long, id long, score long").withColumn(
        "nth", F.row_number().over(w) - 1).where(F.col("nth") < positives), "positives")
    scores = good.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("nth", "score"))).alias("s")).select("number", F.col("s.score").alias("scores"))
    w = Window.partitionBy("number", "nth").orderBy(F.desc("negative_score"), "negative_id")
    bad = _pairs(made, anchors.join(scores, "number"), groups, anchors_a_block, few, width, table, other,
                 "number long, nth long, negative_id long, negative_score long").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    named = good.join(anchors.select("number", F.col("id").alias("anchor_id")), "number").select(
        "number", "nth", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return bad.join(named, ["number", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
with v as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id as anchor_id, b.id as id, a.label = b.label as same, list_inner_product(a.q::double[], b.q::double[])::bigint as score
  from v a join v b on a.id % 100 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where same and id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select * from (select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by s.score desc, s.id))::int as rank,
    s.id as negative_id, positive_score, s.score as negative_score
  from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
where rank <= 10"""
