"""Approximate nearest neighbours by additive quantisation, reranked exactly.

A unit vector is coded as a sum of one full-dimensional word from each of `books` codebooks, found by a beam search over
the residuals. The codebooks are fitted on a bounded sample (`sampled` vectors, the smallest by a hash of the id): residual
k-means first, then least squares against the beam search's codes in turn. Every vector is indexed. The index is a table
of blocks of vectors with their codes and the norms of what the codes add up to. A search meets each block with a batch of
queries of a bounded size, which is broadcast: lookup tables of the queries' products with all codewords score the codes,
the `rerank` best of a block are measured in double precision on the original vectors, and each block's best go on.

Equal vectors of a block share one code, with their k + 1 smallest ids: all that k neighbours, ties to smaller ids, can
need. So a vector that a third of all rows hold costs a block one candidate.

Defined results: vectors that are null, zero, or hold null or non-finite components, or whose length isn't the commonest
one, take no part, as queries or as candidates; of repeated ids each row is a candidate of its own; an empty table gives
no rows."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir, written


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in single precision."""
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def encode(x: np.ndarray, books: np.ndarray, beam: int = 4, block: int = 2048) -> np.ndarray:
    """(n, M) codes of x (n, d) in books (M, K, d), by a beam search."""
    m, k, d = books.shape
    own = (books * books).sum(2)
    out = np.empty((len(x), m), np.uint8)
    for at in range(0, len(x), block):
        res = x[at:at + block, None]
        err = (res * res).sum(2)
        n = len(res)
        codes = np.zeros((n, 1, m), np.uint8)
        for j in range(m):
            e = (err[:, :, None] - 2 * (res.reshape(-1, d) @ books[j].T).reshape(n, -1, k) + own[j]).reshape(n, -1)
            b = min(beam, e.shape[1])
            best = np.argpartition(e, b - 1, axis=1)[:, :b]
            err = np.take_along_axis(e, best, 1)
            up, word = np.divmod(best, k)
            res = np.take_along_axis(res, up[:, :, None], 1) - books[j][word]
            codes = np.take_along_axis(codes, up[:, :, None], 1).copy()
            codes[:, :, j] = word
        out[at:at + block] = codes[np.arange(n), err.argmin(1)]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(len(books)))


def _kmeans(x: np.ndarray, k: int, rnd: np.random.Generator, rounds: int = 6) -> np.ndarray:
    c = x[rnd.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rnd.choice(len(x), k)])
    return c


def train(x: np.ndarray, books: int = 8, words: int = 256, rounds: int = 2, seed: int = 0) -> np.ndarray:
    """Codebooks (books, words, d) for unit vectors x."""
    rnd = np.random.default_rng(seed)
    words = max(1, min(words, len(x)))
    c = np.empty((books, words, x.shape[1]), np.float32)
    left = x.copy()
    for j in range(books):
        c[j] = _kmeans(left, words, rnd)
        left -= c[j][((c[j] ** 2).sum(1) - 2 * left @ c[j].T).argmin(1)]
    for _ in range(rounds):
        codes = encode(x, c)
        col = codes + np.arange(books) * words
        gram = np.zeros((books * words, books * words), np.float64)
        for i in range(books):
            for j in range(books):
                np.add.at(gram, (col[:, i], col[:, j]), 1)
        right = np.zeros((books * words, x.shape[1]))
        for i in range(books):
            np.add.at(right, col[:, i], x)
        gram[np.diag_indices_from(gram)] += 1
        right += c.reshape(-1, x.shape[1])  # rare words stay near where they are
        c = np.linalg.solve(gram, right).reshape(c.shape).astype(np.float32)
    return c


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v: array<double>) of the vectors that take part."""
    v = vectors.select(F.col(id_col).try_cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        "id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
        " and exists(v, x -> x <> 0)")
    common = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("v") == (common["n"] if common else 0))


def _matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    col = b.column(name)
    return np.asarray(col.flatten(), np.float64).reshape(b.num_rows, -1)


def fitted_books(vectors: DataFrame, sampled: int, books: int, words: int) -> np.ndarray | None:
    """Codebooks fitted in one task on a sample of a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.asarray(b.column("id")), _matrix(b, "v")) for b in batches if b.num_rows]
        if parts:
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            x = x[np.lexsort((*x.T[::-1], ids))]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(unit(x), books, words))], pa.binary())], ["books"])

    got = vectors.orderBy(F.xxhash64("id"), "id").limit(sampled).coalesce(1).mapInArrow(run, "books binary").collect()
    return pickle.loads(got[0]["books"]) if got else None


FOUND = "query_id long, vec_id long, score double"
INDEX = "ids binary, at binary, codes binary, norms binary, vectors binary, n long, dim int"


def index(vectors: DataFrame, books: np.ndarray, keep: int, block: int = 16384) -> DataFrame:
    """A row per block of distinct vectors: codes, norms, vectors, and for each the `keep` smallest ids (ids[at[i]:at[i + 1]])."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def row(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        raw = np.ascontiguousarray(x + 0.0)  # minus zero is zero
        group = raw.view(np.dtype((np.void, raw.shape[1] * 8))).ravel()
        _, first, inverse = np.unique(group, return_index=True, return_inverse=True)
        order = np.lexsort((ids, inverse))
        g = inverse[order]
        nth = np.arange(len(g)) - np.searchsorted(g, g)
        order, g = order[nth < keep], g[nth < keep]
        own = raw[first]
        codes = encode(unit(own), shared.value)
        norms = np.sqrt((decode(codes, shared.value) ** 2).sum(1)).astype(np.float32)
        at = np.searchsorted(g, np.arange(len(first) + 1))
        values = (ids[order].astype(np.int64), at.astype(np.int64), codes, norms, own)
        return pa.RecordBatch.from_arrays([*(pa.array([v.tobytes()], pa.binary()) for v in values), pa.array([len(own)], pa.int64()), pa.array([own.shape[1]], pa.int32())],
                                          ["ids", "at", "codes", "norms", "vectors", "n", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, held = [], [], 0
        for b in batches:
            for i in range(0, b.num_rows, block):
                part = b.slice(i, block)
                ids.append(np.asarray(part.column("id")))
                x.append(_matrix(part, "v"))
                held += part.num_rows
                if held >= block:
                    yield row(np.concatenate(ids), np.concatenate(x))
                    ids, x, held = [], [], 0
        if held:
            yield row(np.concatenate(ids), np.concatenate(x))

    return vectors.mapInArrow(run, INDEX)


def search_block(b: dict, books: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int, rerank: int) -> Iterator[tuple[int, int, float]]:
    """(query, id, cosine) of the best k of one block for each query."""
    n, dim, m = b["n"], b["dim"], len(books)
    ids, at = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["at"], np.int64)
    codes = np.frombuffer(b["codes"], np.uint8).reshape(n, m)
    norms = np.maximum(np.frombuffer(b["norms"], np.float32), 1e-9)
    x = np.frombuffer(b["vectors"]).reshape(n, dim)
    scale = np.abs(x).max(1, keepdims=True)
    xu = x / scale
    size = np.sqrt((xu * xu).sum(1))
    tables = np.einsum("qd,mkd->qmk", unit(q), books)
    for i in range(len(q)):
        score = tables[i, 0][codes[:, 0]]
        for j in range(1, m):
            score = score + tables[i, j][codes[:, j]]
        score /= norms
        best = np.argpartition(-score, rerank - 1)[:rerank] if n > rerank else np.arange(n)
        own = q[i] / np.abs(q[i]).max()
        exact = (xu[best] * own).sum(1) / (size[best] * np.sqrt((own * own).sum()))
        cand = np.concatenate([ids[at[j]:at[j + 1]] for j in best])
        value = np.repeat(exact, (at[best + 1] - at[best]))
        other = cand != qid[i]
        cand, value = cand[other], value[other]
        top = np.lexsort((cand, -value))[:k]
        yield from zip([int(qid[i])] * len(top), cand[top].tolist(), value[top].tolist())


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the first k of each query's candidates."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: str, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", sampled: int = 10000,
            books: int = 16, words: int = 256, rerank: int = 256, batch_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of each row for which `is_query`, a condition on `id`, holds.

    Queries are broadcast in batches of about batch_bytes, each of which scans the index once. Of several batches, each
    one's answers are written and its queries dropped before the next, so the driver holds one batch at a time; the
    queries are written in the order of their batches, so a batch reads little but its own."""
    spark = vectors.sparkSession
    v = usable(vectors, id_col, vec_col)
    code = fitted_books(v, sampled, books, words)
    if code is None:
        return best_of(spark.createDataFrame([], FOUND), k)
    table = written(index(v, code, k + 1), "codes")
    queries = v.where(is_query)
    batches = -(-queries.count() * code.shape[2] * 8 // batch_bytes) or 1
    shared = spark.sparkContext.broadcast(code)

    def answers(batch: DataFrame):
        got = batch.collect()
        asked = spark.sparkContext.broadcast((np.array([r["id"] for r in got], np.int64), np.array([r["v"] for r in got]).reshape(len(got), code.shape[2])))

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows:
                for block in b.to_pylist():
                    cols = list(zip(*search_block(block, shared.value, *asked.value, k, rerank))) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())],
                                                     ["query_id", "vec_id", "score"])

        return best_of(table.mapInArrow(run, FOUND), k), asked

    if batches == 1:
        return answers(queries)[0]
    queries = written(queries.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches))).repartitionByRange("batch").sortWithinPartitions("batch"), "queries")
    path = f"{shared_dir(spark)}/neighbours-{uuid.uuid4().hex}"
    for i in range(batches):
        best, asked = answers(queries.where(F.col("batch") == i).select("id", "v"))
        best.write.mode("append").parquet(path)
        asked.destroy()
    return spark.read.schema(best.schema).parquet(path)
