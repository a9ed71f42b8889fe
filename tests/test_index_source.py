import datetime as dt
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import checksums as C
from lodestar.sources import codec
from lodestar.sources import index_source as I

AT = dt.datetime.fromtimestamp(1710000000)


def entries(spark, n, dim=8, parts=3):
    x = np.random.default_rng(1).normal(size=(n, dim)).astype(np.float32)
    return spark.createDataFrame([(f"a{i}", f"f{i}", v.tolist(), AT, AT) for i, v in enumerate(x)], codec.ENTRY).repartition(parts), x


def test_round_trip_in_ranges(spark, tmp_path):
    e, _ = entries(spark, 500)
    where = f"file://{tmp_path}/i"
    I.write(e, where, 8, rowsafile=100)
    assert len(I.files_of(where)) == 6 and not [n for n in os.listdir(tmp_path / "i") if n.startswith(".")]
    got = I.read(spark, where, rowsapartition=40)
    assert got.rdd.getNumPartitions() > 6 and sorted(map(tuple, got.collect())) == sorted(map(tuple, e.collect()))
    assert sorted(map(tuple, codec.read_files(spark, where).collect())) == sorted(map(tuple, e.collect()))
    I.write(e.limit(3), where, 8, "overwrite")
    assert I.read(spark, where).count() == 3
    one = I.files_of(where)[0]
    assert I.read(spark, one).count() <= 3


def test_lookup_reads_header_table_and_row(spark, tmp_path):
    e, x = entries(spark, 1000, 64, 1)
    I.write(e.coalesce(1).sortWithinPartitions("asset_id"), str(tmp_path), 64)
    got = I.read(spark, str(tmp_path)).where("asset_id = 'a7'")
    assert got.first().embedding == x[7].tolist() and I.read(spark, str(tmp_path)).where(F.col("asset_id").isin("a1", "a2", "none")).count() == 2
    reader = I.IndexReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([I.EqualTo(("asset_id",), "a7"), I.EqualTo(("fingerprint",), "f7")])) == [I.EqualTo(("fingerprint",), "f7")]
    part, = reader.partitions()
    with I.IndexFile(part.path) as f:
        assert [b.to_pylist()[0]["asset_id"] for b in reader.rows(f, part)] == ["a7"]
        assert f.read == codec.SIZE + f.table + 4 * 64 < os.path.getsize(part.path) / 3
        with pytest.raises(IndexError):
            f.vectors(999, 1001)
    assert I.read(spark, str(tmp_path)).where("asset_id = 'a7' and asset_id = 'a8'").count() == 0


def test_failed_jobs_leave_no_file_and_bad_files_are_refused(spark, tmp_path):
    e, _ = entries(spark, 50)
    bad = e.withColumn("embedding", F.when(F.col("asset_id") == "a9", F.array(F.lit(1.0).cast("float"))).otherwise(F.col("embedding")))
    with pytest.raises(Exception):  # noqa: B017
        I.write(bad, str(tmp_path / "x"), 8, rowsafile=5)
    assert I.files_of(str(tmp_path / "x")) == []
    I.write(e, str(tmp_path / "y"), 8)
    name = I.files_of(str(tmp_path / "y"))[0]
    raw = open(name, "rb").read()
    assert {(r.ok, r.bytes) for r in I.verified(spark, name, 100).collect()} == {(True, len(raw) - codec.SIZE)}
    open(name, "wb").write(raw[:-5] + bytes([raw[-5] ^ 1]) + raw[-4:])
    assert [r.ok for r in I.verified(spark, str(tmp_path / "y"), 64).orderBy("ok").collect()][0] is False
    open(name, "wb").write(raw[:-1])
    with pytest.raises(Exception, match="wrong length"):
        I.read(spark, name).collect()
    with pytest.raises(ValueError):
        I.local("hdfs://somewhere/x")
    assert I.read(spark, str(tmp_path / "x")).count() == 0


def test_checksums_of_parts(spark):
    raw = bytes(np.random.default_rng(2).integers(0, 256, 5000, dtype=np.uint8))
    assert C.combined(zlib.crc32(raw[:1234]), zlib.crc32(raw[1234:]), 5000 - 1234) == zlib.crc32(raw) and C.combined(7, 0, 0) == 7
    cuts = sorted({0, 1, 2, 900, 901, 4999, 5000, *range(0, 5000, 701)})
    rows = [("a", a, raw[a:b]) for a, b in zip(cuts, cuts[1:])] + [("b", 0, b""), ("c", 0, b"x"), ("c", 1, None)]
    got = C.merged(spark.createDataFrame(rows, "f string, at long, d binary").repartition(4), ["f"], "at", "d").collect()
    assert {r.f: (r.bytes, r.crc32) for r in got} == {"a": (5000, zlib.crc32(raw)), "b": (0, 0), "c": (1, zlib.crc32(b"x"))}
