import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(entry.catalog.QUERIES))
def test_same_as_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    if name not in entry.oracle_sql():
        assert rows
        return
    want = duck.execute(entry.oracle_sql()[name])
    at = [x[0] for x in want.description]
    assert sorted(at) == names
    assert rows == sorted((tuple(plain(r[at.index(c)]) for c in names) for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rounding_is_that_of_the_sql(spark, duck):
    """With the signs of zeros, that a comparison of written values sees."""
    x = [0.0, -0.0, -1e-7, 4e-6, -4e-6, 0.000005, -0.000005, 1.0000049999, -2.5, 12345.678915, 0.285675, 1.005, -1e9 - 0.3, float("inf")]
    for n in (2, 3, 5):
        got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(entry.catalog._r("x", n)).collect()]
        assert list(map(repr, got)) == [repr(duck.execute(f"select round(?::double, {n})", [v]).fetchone()[0]) for v in x]


def test_small_negative_components(spark, duck, tmp_path):
    spark.createDataFrame([(8, [-0.6, -1e-7, 0.8]), (4, [0.25, -1e-9, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.vec_id, r.norm, r.normalized, list(r.unit)) for r in entry.queries()["normalized_vectors"](spark, str(tmp_path)).collect())
    sql = entry.oracle_sql()["normalized_vectors"].replace("from embeddings", f"from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck.execute(f"select vec_id, norm, normalized, unit from ({sql}) order by vec_id").fetchall()
    assert list(map(repr, got)) == list(map(repr, want)) and "-0.0" in repr(want)
