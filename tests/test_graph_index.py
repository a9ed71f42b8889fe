import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import graph_index as G
from lodestar.operators import search as S


def vectors(n, d=16, seed=0, clusters=12):
    rnd = np.random.default_rng(seed)
    c = rnd.normal(size=(clusters, d))
    return (c[rnd.integers(0, clusters, n)] + 0.5 * rnd.normal(size=(n, d))).astype(np.float32)


def frame(spark, x, ids=None, kind="long"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in zip(range(len(x)) if ids is None else ids, x)], f"vec_id {kind}, embedding array<float>").repartition(3)


@pytest.fixture
def index(spark, tmp_path):
    return G.GraphIndex(spark, f"file://{tmp_path}/graph")


def found(index, queries, k=5, width=16):
    got = {}
    for r in index.search(queries, k, width).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 6)))
    return got


def exact(e, queries, k=5):
    got = {}
    for r in S.batch_top_k(e, queries, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 6)))
    return got


def test_few_rows_are_measured_and_most_neighbours_found(spark, index):
    x = vectors(3060, 24)
    e, asked = frame(spark, x[:3000]), frame(spark, x[3000:])
    assert index.replace(e, 24, rows_a_segment=1500, neighbours=20) == 3000 == index.count() and index.segments().count() == 2
    got, want = found(index, asked, 10, 12), exact(e, asked, 10)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 600
    share = G.share_measured(index.hits(asked, 10, 12), 3000).agg(F.avg("share")).first()[0]
    assert 0 < share < 0.1
    strange = frame(spark, vectors(60, 24, seed=7))  # between the clusters: a wider beam
    got, want = found(index, strange, 10, 64), exact(e, strange, 10)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 600
    g = index.neighbours()
    assert g.where("level = 0").select("id").distinct().count() == 3000 and g.groupBy("segment", "level", "id").count().agg(F.max("count")).first()[0] <= 24
    assert g.where("id = neighbour").count() == 0 and 100 < g.where("level = 1").select("id").distinct().count() < 300


def test_queries_that_are_dealt_find_what_broadcast_ones_do(spark, index, monkeypatch):
    x = vectors(300)
    index.replace(frame(spark, x), 16, rows_a_segment=64)
    asked = frame(spark, x[:50])
    want = found(index, asked)
    monkeypatch.setattr(G, "BROADCAST_BYTES", 0)
    assert found(index, asked) == want and len(want) == 50


def test_replace_insert_delete_and_compact_equal_a_fresh_build(spark, index, tmp_path):
    x = vectors(260)
    asked = frame(spark, vectors(20, seed=3))
    wide = 400  # wider than a segment: every node that can be reached is measured
    index.replace(frame(spark, x[:100]), 16, rows_a_segment=64)
    assert found(index, asked, width=wide) == exact(frame(spark, x[:100]), asked)
    assert index.insert(frame(spark, x[100:200], range(100, 200))) == 100 and index.count() == 200
    assert found(index, asked, width=wide) == exact(frame(spark, x[:200]), asked)
    moved = x[:200].copy()
    moved[50:60] = x[200:210]
    assert index.insert(frame(spark, x[200:210], range(50, 60))) == 10 and index.count() == 200  # replaced
    assert found(index, asked, width=wide) == exact(frame(spark, moved), asked)
    gone = spark.createDataFrame([(i,) for i in [*range(0, 90, 2), 55, 9999]], "vec_id long")
    assert index.delete(gone) == 46 and index.delete(gone) == 0 and index.count() == 154
    left = [i for i in range(200) if not (i < 90 and i % 2 == 0) and i != 55]
    want = exact(frame(spark, moved[left], left), asked)
    assert found(index, asked, width=wide) == want
    fresh = G.GraphIndex(spark, f"file://{tmp_path}/fresh")
    fresh.replace(frame(spark, moved[left], left), 16, rows_a_segment=64)
    assert found(fresh, asked, width=wide) == want
    again = G.restored(spark, index.root)
    assert found(again, asked, width=wide) == want and {r.id: r.v for r in again.get([51, 55, 120]).collect()} == {51: moved[51].tolist(), 120: moved[120].tolist()}
    assert again.compact() > 0 and again.count() == 154 and again.manifest().gone < 46
    assert found(index, asked, width=wide) == want and index.compact(0) == 0
    assert index.compact(2) > 0 and index.manifest().gone == 0 and index.segments().count() == 3 and found(index, asked, width=wide) == want


def test_guards_and_odd_rows(spark, index):
    assert G.restored(spark, index.root) is None and index.is_empty()
    with pytest.raises(S.SearchError):
        index.search(frame(spark, vectors(1)))
    with pytest.raises(S.SearchError):
        index.replace(frame(spark, vectors(1)), 16, metric="none")
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0]), ("d", None), ("e", [float("nan"), 0.0]), (None, [1.0, 1.0]), ("a", [0.5, 0.0]), ("z", [0.0, 0.0])]
    assert index.replace(spark.createDataFrame(rows, "vec_id string, embedding array<float>"), 2) == 3
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, None)], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.id) for r in index.search(asked, 9).orderBy("rank").collect()] == [(1, 1, "a"), (1, 2, "b"), (1, 3, "z")]
    with pytest.raises(Exception, match="dimension 2, a query 3"):
        index.search(spark.createDataFrame([(1, [1.0] * 3)], "vec_id long, embedding array<float>")).collect()
    with pytest.raises(S.SearchError):
        index.search(asked, 0)
    index.replace(spark.createDataFrame([], "vec_id long, embedding array<float>"), 2)
    assert index.search(asked).count() == 0 and index.insert(spark.createDataFrame([(1, [3.0, 4.0])], "vec_id long, embedding array<float>")) == 1
    assert index.search(asked).count() == 1 and index.delete(asked) == 1 and index.search(asked).count() == 0
    index.clear()
    assert index.manifest() is None


def test_euclidean_and_many_equal_vectors(spark, index):
    x = vectors(200, 8)
    x[:120] = x[0]
    asked = frame(spark, vectors(10, 8, seed=4))
    index.replace(frame(spark, x), 8, metric="euclidean")
    assert index.neighbours().where("level = 0").select("id").distinct().count() == 81
    far = lambda q: sorted((round(float(np.linalg.norm(q.astype(float) - v)), 6), i) for i, v in enumerate(x.astype(float)))
    for q, v in enumerate(vectors(10, 8, seed=4)):
        got = found(index, asked, 5, 300)[q]
        assert [s for _, s in got] == pytest.approx([s for s, _ in far(v)[:5]], abs=1e-5)


def test_equal_vectors_block_no_way_and_are_found_by_smaller_ids(spark, index):
    x = vectors(1500, 16, clusters=6)
    x[::3] = x[0]
    asked = frame(spark, np.concatenate([x[1:200:3], x[:1]]))
    index.replace(frame(spark, x), 16)
    index.delete(spark.createDataFrame([(0,), (6,)], "vec_id long"))
    left = [i for i in range(1500) if i not in (0, 6)]
    got, want = found(index, asked, 10), exact(frame(spark, x[left], left), asked, 10)
    assert got[67] == want[67] == [(i, 1.0) for i in (3, *range(9, 36, 3))]
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 10 * len(want)
    assert index.rows().where("v is not null").count() == 1498


@pytest.mark.parametrize("metric", G.METRICS)
def test_a_checked_search_misses_nothing(spark, index, metric):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(900, 48)).astype(np.float32)  # no structure: a narrow beam misses many
    x[100:140], x[140:150] = x[0], 2 * x[0]
    e, asked = frame(spark, x), frame(spark, np.concatenate([rnd.normal(size=(30, 48)).astype(np.float32), x[:2], 0 * x[:1]]))
    index.replace(e, 48, metric=metric, rows_a_segment=400)
    index.delete(e.where("vec_id in (0, 101, 300)"))
    left = e.where("vec_id not in (0, 101, 300)")
    if metric == "cosine":
        want = exact(left, asked, 10)
    else:
        got = {r.vec_id: np.array(r.embedding) for r in left.collect()}
        want = {q.vec_id: sorted(((i, round(float(np.linalg.norm(v - np.array(q.embedding))), 6)) for i, v in got.items()), key=lambda p: (p[1], p[0]))[:10] for q in asked.collect()}
    seen = {}
    for r in index.search(asked, 10, 10, exact=True).orderBy("query_id", "rank").collect():
        seen.setdefault(r.query_id, []).append((r.id, round(r.score, 6)))
    assert seen == want and found(index, asked, 10, 10) != want


def test_levels(spark):
    n = spark.range(20000).select(G.level(F.col("id")).alias("l")).groupBy("l").count().collect()
    n = {r.l: r["count"] for r in n}
    assert 1100 < sum(v for k, v in n.items() if k >= 1) < 1400 and 50 < sum(v for k, v in n.items() if k >= 2) < 110


def test_a_build_holds_matrices_of_a_bounded_size(monkeypatch):
    x, seen, taken = vectors(600, 8).astype(np.float64), [], np.argpartition
    want = G.neighbour_lists(x, 8)
    monkeypatch.setattr(G, "MEASURED", 600 * 32)
    monkeypatch.setattr(np, "argpartition", lambda d, *a, **b: seen.append(d.size) or taken(d, *a, **b))
    assert (G.neighbour_lists(x, 8) == want).all() and max(seen) == 600 * 32
