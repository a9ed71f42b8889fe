import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import clustering as C
from lodestar.operators import search as S


def index(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"vec_id {kind}, embedding array<float>").repartition(3)


def test_golden_rows(spark):
    e = index(spark, [("asset-1", [1.0, 0.0, 0.0]), ("asset-2", [0.5, 0.5, 0.0])], "string")
    got = S.top_k(e, [1, 0, 0], 2).collect()
    assert [r.id for r in got] == ["asset-1", "asset-2"] and got[0].score == 1 and round(got[1].score, 5) == 0.70711
    assert [round(r.score, 5) for r in S.top_k(e, [1, 0, 0], 9, metric="dot").collect()] == [1, 0.5]
    assert S.lookup(e, ["asset-1"]).first().embedding == [1, 0, 0] and S.lookup(e, ["none"]).count() == 0
    ties = index(spark, [("9", [1.0, 0.0]), ("10", [2.0, 0.0]), ("1", [0.0, 1.0])], "string")
    assert [r.id for r in S.batch_top_k(ties, ties.where("vec_id = '1'"), 3).orderBy("rank").collect()] == ["1", "10", "9"]


def test_guards(spark):
    for q, k in (([], 3), ([float("nan")], 3), ([1.0], 0), ([[1.0]], 3)):
        with pytest.raises(S.SearchError):
            S.checked_query(q, k)
    with pytest.raises(S.SearchError):
        S.checked_query([1.0], 1, 2)
    empty = index(spark, [])
    assert S.top_k(empty, [1.0], 3).count() == 0 and S.batch_top_k(empty, empty, 3).count() == 0
    assert S.similarity_join(empty, 0.5).count() == 0 and S.lsh_top_k(empty, empty).count() == 0


def vectors(n=240, d=16, seed=0):
    rnd = np.random.default_rng(seed)
    c = rnd.normal(size=(12, d))
    return (c[rnd.integers(0, 12, n)] + 0.35 * rnd.normal(size=(n, d))).astype(np.float32)


@pytest.mark.parametrize("most", [0, 1 << 20])  # queries dealt, or broadcast
def test_batches_equal_brute_force(spark, monkeypatch, most):
    x = vectors()
    monkeypatch.setattr(S, "BROADCAST_BYTES", most)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cos = u @ u.T
    monkeypatch.setattr(S, "BLOCK", 37)  # several blocks
    e = index(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = {}
    for r in S.batch_top_k(e, e.where("vec_id % 5 = 0"), 7, exclude_self=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q, ids in got.items():
        order = [i for i in np.lexsort((np.arange(len(x)), -np.round(cos[q], 12))) if i != q]
        assert ids == order[:7]
    edges = {(r.src, r.dst) for r in S.similarity_join(e, 0.8).collect()}
    assert edges == {(i, j) for i, j in zip(*np.nonzero(cos >= 0.8)) if i != j}
    capped = S.similarity_join(e, 0.5, most=3)
    assert max(r["count"] for r in capped.groupBy("src").count().collect()) == 3


def test_lsh_recall(spark):
    e = index(spark, [(i, v.tolist()) for i, v in enumerate(vectors(600))])
    q = e.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.id) for r in S.batch_top_k(e, q, 5).collect()}
    near = {(r.query_id, r.id) for r in S.lsh_top_k(e, q, 5).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


@pytest.mark.parametrize("most", [0, 1 << 20])  # queries dealt, or broadcast
def test_lsh_measures_in_tasks_and_passes_over_odd_rows(spark, monkeypatch, most):
    monkeypatch.setattr(S, "BLOCK", 37)
    monkeypatch.setattr(S, "BROADCAST_BYTES", most)
    x = [v.tolist() for v in vectors(200)]
    e = index(spark, [*enumerate(x), (500, None), (501, []), (502, [1.0]), (503, [float("nan")] * 16), (504, [0.0] * 16)])
    found = S.lsh_top_k(e, e.where("vec_id % 20 = 0 and vec_id < 200"), 7, tables=400, bits=1)  # all but opposite vectors meet
    rows = found.orderBy("query_id", "rank").collect()
    a = np.array(x, np.float64)
    u = a / np.linalg.norm(a, axis=1, keepdims=True)
    for q in range(0, 200, 20):
        own = [r for r in rows if r.query_id == q]
        assert [r.id for r in own] == np.argsort(-(u @ u[q]), kind="stable")[:7].tolist() and [r.score for r in own] == pytest.approx(np.sort(u @ u[q])[::-1][:7])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(keys" not in plan and plan.count("hashpartitioning(query_id") == 1  # only the first k of a pair of blocks are shuffled by query


def test_cutoff_tiers(spark):
    lists = {"high": [0.8] + [0.7] * 30, "edge": [0.9, 0.6, 0.59], "fair": [0.6] + [0.1] * 30, "low": [0.59] * 30, "few": [0.1]}
    df = spark.createDataFrame([(q, i, s) for q, v in lists.items() for i, s in enumerate(v)], "query_id string, id int, score double")
    got = {r.query_id: r["count"] for r in S.adaptive_cutoff(df, ["query_id"]).groupBy("query_id").count().collect()}
    assert got == {"high": 25, "edge": 2, "fair": 20, "low": 15, "few": 1}


def sequential(cos, t, least):
    """The scan that the closed form stands for."""
    n = len(cos)
    near = [[j for j in range(n) if j != i and cos[i][j] >= t] for i in range(n)]
    label, k = [None] * n, 0
    for i in range(n):
        if label[i] is not None:
            continue
        if len(near[i]) < least:
            label[i] = -1
            continue
        k += 1
        label[i], todo = k, list(near[i])
        while todo:
            j = todo.pop(0)
            if label[j] == -1:
                label[j] = k
            if label[j] is None:
                label[j] = k
                if len(near[j]) >= least:
                    todo += near[j]
    return label


@pytest.mark.parametrize("t,least", [(0.75, 2), (0.8, 3), (0.85, 4), (0.6, 5), (0.9999, 2)])
def test_clusters_equal_sequential_scan(spark, t, least):
    x = vectors(120).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    e = index(spark, [(i, v.tolist()) for i, v in enumerate(vectors(120))])
    got = {r.id: r.cluster for r in C.cluster_vectors(e, t, least).collect()}
    want = sequential(u @ u.T, t, least)
    # ids are numbered by smallest core; the scan numbers them in the order of first cores too
    assert [got[i] for i in range(120)] == want
    stats = C.statistics(spark.createDataFrame(list(got.items()), "id long, cluster int")).first()
    assert stats.cluster_count == max(0, *want) and (stats.average_size is None) == (max(want) < 1)


def test_cluster_index(spark):
    with pytest.raises(C.NothingToCluster):
        C.cluster_index(None)
    rows = [(f"a{i}", [1.0, 0.01 * i]) for i in range(5)] + [(f"b{i}", [0.01 * i, 1.0]) for i in range(5)] + [("c", [-1.0, -1.0])]
    entries = spark.createDataFrame(rows, "asset_id string, embedding array<float>")
    with pytest.raises(C.NothingToCluster):
        C.cluster_index(entries.limit(0))
    got = {r.cluster: (r.size, r.center_id, r.members) for r in C.cluster_index(entries, C.STRICT).collect()}
    assert got == {1: (5, "a0", ["a0", "a1", "a2", "a3", "a4"]), 2: (5, "b0", ["b0", "b1", "b2", "b3", "b4"])}


def test_numbered_over_many_parts(spark):
    roots = spark.range(0, 3000, 3).select(F.col("id").alias("root"))
    assert sorted((r.root, r.cluster) for r in C.numbered(roots).collect()) == [(3 * i, i + 1) for i in range(1000)]
