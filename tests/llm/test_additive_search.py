import numpy as np

from lodestar.llm import additive_search as A


def exact(rows, k, wanted):
    keep = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, x = np.array([i for i, _ in keep]), np.array([v for _, v in keep])
    out = {}
    for i, v in keep:
        if not wanted(i):
            continue
        s = (x * v).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((v * v).sum()))
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "c", 0) for i, v in rows], "vec_id long, embedding array<float>, id string, score int").repartition(3)
    got = {}
    for r in sorted(A.nearest(df, "id % 50 = 0", **more).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    return got


def test_recall_and_scores(spark):
    rnd = np.random.default_rng(0)
    centre = rnd.normal(size=(20, 32))
    x = (centre[rnd.integers(0, 20, 3000)] + 0.7 * rnd.normal(size=(3000, 32))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = exact(rows, 5, lambda i: i % 50 == 0)
    got = run(spark, rows, sampled=1500, rerank=64, batch_bytes=4000)
    assert set(got) == set(want)
    hit = sum(len({a for a, _ in want[q]} & {a for a, _, _ in got[q]}) for q in want)
    assert hit >= 0.9 * 5 * len(want)
    truth = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        assert [r for _, _, r in found] == [1, 2, 3, 4, 5]
        for v, s, _ in found:
            a, b = truth[q], truth[v]
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_odd_vectors_ties_and_few(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (3, [1.0, 0.0]), (2, [2.0, 0.0]), (1, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (100, [nan, 1.0]),
            (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (150, [-1.0, 0.0])]
    rows += [(200 + i, [1.0, 0.0]) for i in range(30)]
    got = run(spark, rows)
    assert [v for v, _, _ in got[0]] == [1, 2, 3, 200, 201] and {s for _, s, _ in got[0]} == {1.0}
    assert 100 not in got and [v for v, _, _ in got[200]] == [0, 1, 2, 3, 201]
    few = run(spark, rows[:3])
    assert [v for v, _, _ in few[0]] == [3, 50] and len(few[50]) == 2
    assert run(spark, [(0, None)]) == {} and run(spark, []) == {}


def test_beam_search_lowers_error():
    rnd = np.random.default_rng(1)
    x = A.unit(rnd.normal(size=(800, 16)))
    books = A.train(x, books=4, words=32)
    error = lambda b: ((x - A.decode(A.encode(x, books, b), books)) ** 2).sum()
    assert error(8) <= error(1) < (x**2).sum()
