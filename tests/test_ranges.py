import random

import pytest

from lodestar.operators import catalog_ops as O
from lodestar.operators import clustering as C
from lodestar.operators import search as S


@pytest.fixture
def small_parts(spark):
    """Ranges stay as many as they are, however few their rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_failure_runs_across_ranges(spark, small_parts):
    """A build that holds most rows, one without successes, a null build and one of one row."""
    rnd = random.Random(3)
    rows = [(b, i, rnd.choices(("success", "failure", "cancelled", None), (1, 12, 3, 1))[0]) for i, b in enumerate(
        rnd.choices((1, 2, None), (8, 2, 1))[0] for _ in range(600))]
    rows = [(b, i, "failure" if b == 2 and s == "success" else s) for b, i, s in rows] + [(9, 600, "failure")]
    count, expected = {}, {}
    for b, i, s in rows:
        count[b] = 0 if s == "success" else count.get(b, 0) + (s == "failure")
        expected[i] = (count[b], count[b] >= 10)
    log = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "b int, i int, status string")
    got = O.failure_runs(log, ["b"], "i", "status")
    assert got.columns == ["b", "i", "status", "consecutive_failures", "abort"]
    assert {r.i: (r.consecutive_failures, r.abort) for r in got.collect()} == expected
    assert any(a for _, a in expected.values())
    assert O.failure_runs(log.limit(0), ["b"], "i", "status").collect() == []


def test_previous_with_gaps(spark, small_parts):
    rows = [(i * i - 40, None if i % 7 == 0 else f"v{i}") for i in range(50)]
    df = spark.createDataFrame(random.Random(2).sample(rows, 50), "at int, v string")
    got = {r["at"]: r.before for r in O.with_previous(df, "at", "v", "before").collect()}
    assert got == {a: (rows[k - 1][1] if k else None) for k, (a, _) in enumerate(rows)}
    assert O.with_previous(df.limit(0), "at", "v", "before").collect() == []


ODD = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 0.1]), (6, [0.0, 0.0]), (7, [0.9, 0.0])]


def test_vectors_without_a_place(spark):
    """Null, empty, null and not finite components: no partners, no answers, noise in a clustering."""
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>").repartition(3)
    longer = df.union(spark.createDataFrame([(8, [1.0, 0.0, 0.0])], df.schema))
    found = {(r.query_id, r["rank"], r.id) for r in S.batch_top_k(longer, df, 2).collect()}
    assert found == {(0, 1, 0), (0, 2, 7), (5, 1, 5), (5, 2, 0), (7, 1, 0), (7, 2, 7), (6, 1, 0), (6, 2, 5)}
    pairs = {(r.src, r.dst) for r in S.similarity_join(df, 0.9).collect()}
    assert pairs == {(a, b) for a in (0, 5, 7) for b in (0, 5, 7) if a != b}
    labels = {r.id: r.cluster for r in C.cluster_vectors(df, 0.9, 2).collect()}
    assert labels == {k: 1 if k in (0, 5, 7) else -1 for k, _ in ODD}
    with pytest.raises(S.SearchError):
        S.batch_top_k(df, longer, 2)
    assert S.batch_top_k(df, df.where("vec_id in (1, 2)"), 2).collect() == []
