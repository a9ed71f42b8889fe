import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, id long"


def plain(rows, anchor, positives=5, negatives=10, scale=256):
    rows = [r for r in rows if None not in (r[0], r[1], r[2]) and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    sizes = Counter(len(r[1]) for r in rows)
    size = min((s for s, n in sizes.items() if n == max(sizes.values())), default=0)
    rows = [(r[0], [math.floor(scale * x) for x in r[1]], r[2]) for r in rows if len(r[1]) == size]
    out = []
    for a, q, label in rows:
        if anchor(a):
            found = sorted((-sum(x * y for x, y in zip(q, v)), b, own == label) for b, v, own in rows)
            for ps, pid, _ in [f for f in found if f[2] and f[1] != a][:positives]:
                fits = [(s, b) for s, b, own in found if not own and 30 * -ps <= 100 * -s <= 90 * -ps][:negatives]
                out += [(a, pid, k, b, -ps, -s) for k, (s, b) in enumerate(fits, 1)]
    return sorted(out)


def vectors(n=600, dim=12, seed=3, clusters=8, noise=0.4):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(clusters, dim))[rnd.integers(0, clusters, n)] + noise * rnd.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v.tolist(), int(k), 1, 2) for i, (v, k) in enumerate(zip(x, rnd.integers(0, 4, n)))]


@pytest.mark.parametrize("block, pivots", [(50, 1), (64, 5), (8192, 16)])
def test_equals_brute_force(spark, block, pivots):
    rows = vectors()
    got = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(5), "id % 10 = 0", block=block, pivots=pivots, anchors_a_block=7, sampled=100)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, lambda i: i % 10 == 0)


def test_ties_nulls_repeats_and_odd_rows(spark):
    rows = vectors(120) + [(1000 + i, vectors(1)[0][1], i % 2, 1, 2) for i in range(200)]  # one vector 200 times
    rows += [(None, [1.0] * 12, 1, 1, 2), (2000, None, 1, 1, 2), (2010, [1.0] * 12, None, 1, 2), (2020, [], 1, 1, 2), (2030, [1.0, None] + [0.0] * 10, 1, 1, 2),
             (2040, [math.nan] * 12, 1, 1, 2), (2050, [math.inf] * 12, 1, 1, 2), (2060, [1.0] * 11, 1, 1, 2), (2070, [0.0] * 12, 1, 1, 2), (2080, [-1.0] * 12, 1, 1, 2),
             (2090, [30.0] * 12, 2, 1, 2)] + [(7, [0.1] * 12, 1, 1, 2)] * 2
    got = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), "id % 10 = 0", block=64)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, lambda i: i % 10 == 0)


def test_large_components_stay_exact(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, (rnd.integers(-2**27, 2**27, 4) * 1.0).tolist(), i % 3, 1, 2) for i in range(60)] + [(1, [3.0] * 4, 1, 1, 2)]
    got = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), "id % 5 = 0", scale=1.0, block=16)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, lambda i: i % 5 == 0, scale=1)
    with pytest.raises(Exception, match="Overflow|too large|out of bounds"):
        hn.hard_negatives(spark.createDataFrame([(i, [1e15] * 4, i % 2, 1, 2) for i in range(8)], SCHEMA), "id % 5 = 0").collect()


def test_few_rows_and_none(spark):
    for rows in ([], vectors(1), vectors(3), [(0, [1.0], 1, 1, 2), (1, [1.0], 2, 1, 2)]):
        got = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), "id % 10 = 0")
        assert got.schema.simpleString().startswith("struct<anchor_id:bigint") and sorted(tuple(r) for r in got.collect()) == plain(rows, lambda i: i % 10 == 0)


def test_brackets_hold_scores_and_exclude_rows():
    x = np.floor(256 * np.array([r[1] for r in vectors(2000, 16, clusters=20, noise=0.02)]))
    p = hn.Pivots(x[:500], float(np.sqrt((x * x).sum(1)).max()), 24)
    lo, hi = p.bracket(x[:50], p.anchors(x[:50]), p.rows(x))
    s = x[:50] @ x.T
    assert (lo <= s).all() and (s <= hi).all()
    fifth = np.sort(lo, 1)[:, -6]
    assert (hi >= fifth[:, None]).mean() < 0.25  # most rows are never measured where vectors lie in clusters


@pytest.mark.parametrize("most", [0, 1 << 20])  # anchors dealt to groups of blocks, or broadcast
def test_anchors_repeated_for_groups_are_not_broadcast(spark, monkeypatch, most):
    rows = vectors()
    e = spark.createDataFrame(rows, SCHEMA).repartition(8)
    made = hn.blocks(hn.usable(e, "vec_id", "label", "embedding", 256.0), hn.Pivots(np.ones((1, 12)), 1e4, 1), 50).withColumn("g", F.lit(0))
    anchors = hn.usable(e, "vec_id", "label", "embedding", 256.0).where("id % 10 = 0").withColumn("number", F.monotonically_increasing_id())
    met = hn._met(hn.written(made, "blocks"), hn.written(anchors, "anchors"), 4, 512, most > 0)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastExchange" in plan) == (most > 0)  # Spark takes written anchors for small, however often they are repeated
    monkeypatch.setattr(hn, "BROADCAST_BYTES", most)
    got = hn.hard_negatives(e, "id % 10 = 0", block=50, anchors_a_block=7, sampled=100)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, lambda i: i % 10 == 0)


def test_a_sample_is_cut_before_the_driver(spark):
    v = spark.createDataFrame([(i, [float(i)]) for i in [*range(900), *[7] * 50]], "id long, v array<double>").repartition(16)
    order = lambda d: [(r.id, r.v) for r in d.orderBy(F.xxhash64("id"), "id", "v").limit(20).collect()]
    assert [(r["id"], r["v"]) for r in hn.sample_of(v, 20)] == order(v) and len(hn.sample_of(v, 5000)) == 950
    same = v.withColumn("id", F.lit(3).cast("long"))
    assert [(r["id"], r["v"]) for r in hn.sample_of(same, 20)] == order(same)
