import datetime as dt
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import encoders as E
from lodestar.functions import vectors as V
from lodestar.operators import catalog_ops as O
from lodestar.sources import codec, golden
from lodestar.sources.store import Checkpoint, IndexStore, Manifest
from lodestar.streaming import index_build as B

AT = dt.datetime.fromtimestamp(1710000000)
ROWS = [("asset-1", "fp-1", [1.0, 0.0, 0.0], AT, AT), ("asset-2", "fp-2", [0.5, 0.5, 0.0], AT, AT)]


def manifest(dim=3):
    return Manifest("test-model", "1.0.0", "Test Model", dim, 224, 52, "model-fingerprint", "resource-fingerprint", "2024-03-09", "2024-03-09")


@pytest.fixture
def store(spark, tmp_path):
    return IndexStore(spark, f"file://{tmp_path}/index")


def entries(spark, rows=ROWS):
    return spark.createDataFrame(rows, codec.ENTRY)


def test_round_trip(spark, store):
    assert store.load_manifest() is None and store.load_snapshot() is None and store.size_mb() == 0
    saved = store.save_snapshot(manifest(), entries(spark))
    m, back = store.load_snapshot()
    assert m == saved and m.item_count == 2 and sorted(map(tuple, back.collect())) == ROWS
    again = store.save_snapshot(manifest(), entries(spark, ROWS[:1]))
    assert again.item_count == 1 and store.load_snapshot()[1].count() == 1 and store.size_mb() > 0
    store.upsert_catalog(spark.createDataFrame([("a", None, "f", AT, AT)], "asset_id string, library_id string, fingerprint string, created_at timestamp, updated_at timestamp"))
    store.clear_index()
    assert store.load_snapshot() is None and store.load_catalog().count() == 1
    store.clear()
    assert store.load_catalog().count() == 0


def test_bad_entries_and_manifests(spark, store):
    for bad in (("", "f", [1.0, 0.0, 0.0]), ("a", None, [1.0, 0.0, 0.0]), ("a", "f", [1.0]), ("a", "f", [1.0, 0.0, float("nan")])):
        with pytest.raises(Exception, match="invalid entry"):
            store.save_snapshot(manifest(), entries(spark, [(*bad, AT, AT)]))
    assert store.load_manifest() is None
    for k, v in (("model_id", " "), ("embedding_dimension", 0), ("item_count", -1), ("schema_version", 2)):
        with pytest.raises(codec.CorruptIndex):
            Manifest(**{**manifest().__dict__, k: v})


def test_codec():
    rows = [{"asset_id": i, "fingerprint": f, "embedding": v, "created_at": 1710000000000, "updated_at": 1710000000000} for i, f, v, _, _ in ROWS]
    raw = codec.encode(rows, 3)
    table, x = codec.decode(raw)
    assert [r["id"] for r in table] == ["asset-1", "asset-2"] and x.tolist() == [[1, 0, 0], [0.5, 0.5, 0]] and codec.row_vector(raw, 1).tolist() == [0.5, 0.5, 0]
    with pytest.raises(IndexError):
        codec.row_vector(raw, 2)
    assert codec.decode(codec.encode([], 3))[1].shape == (0, 3)

    def put(at, fmt, value, fix=False):
        b = bytearray(raw)
        struct.pack_into(fmt, b, at, value)
        if fix:
            struct.pack_into("<I", b, 28, zlib.crc32(bytes(b[36:])))
        return bytes(b)

    for bad in (raw[:20], put(0, "<B", 1), put(4, "<I", 2), put(8, "<I", 0), put(12, "<Q", 3), put(20, "<Q", 999), put(28, "<I", 1), raw + b"x", raw[:-1],
                put(40, "<B", 7), put(36, "<B", 7, True)):
        with pytest.raises(codec.CorruptIndex):
            codec.decode(bad)


def test_binary_files(spark, tmp_path):
    f = codec.encoded_files(entries(spark).coalesce(1), 3).first().file
    (tmp_path / "a.bin").write_bytes(bytes(f))
    assert sorted(map(tuple, codec.read_files(spark, f"file://{tmp_path}").collect())) == ROWS


def assets(spark, n):
    return spark.range(n).select(F.concat(F.lit("a"), "id").alias("asset_id"), F.concat(F.lit("text "), "id").cast("binary").alias("payload"),
                                 F.lit(AT).alias("created_at"), F.lit(AT).alias("updated_at"))


def test_build_resumes_and_gates(spark, store):
    enc = E.HashingEncoder(8)
    with pytest.raises(Exception, match="no encoder"):
        B.build(store, assets(spark, 3), E.NoEncoder(), manifest(8))
    assert store.load_checkpoint().stage == "failed"
    store.stage(E.embed(assets(spark, 2), "payload", enc).select("asset_id", F.lit("kept").alias("fingerprint"), "embedding", "created_at", "updated_at"))
    done = B.build(store, assets(spark, 5), enc, manifest(8))
    got = {r.asset_id: r.fingerprint for r in store.load_snapshot()[1].collect()}
    assert done.item_count == 5 and got["a0"] == got["a1"] == "kept" and got["a4"] != "kept" and store.load_checkpoint() is None and store.staged().count() == 0
    only = spark.createDataFrame([("a1",), ("a2",)], "asset_id string")
    assert B.build(store, assets(spark, 5), enc, manifest(8), only).item_count == 2


def test_stream_stages_each_file_once(spark, store, tmp_path):
    src = f"file://{tmp_path}/in"
    enc = E.HashingEncoder(8)
    schema = assets(spark, 1).schema
    for n in (3, 6):
        assets(spark, n).where(f"cast(substring(asset_id, 2) as int) >= {n - 3}").coalesce(1).write.mode("append").parquet(src)
        B.stage_stream(spark, src, schema, store, enc, f"file://{tmp_path}/state").awaitTermination()
        assert store.staged().count() == n


def test_metrics_stream(spark, tmp_path):
    src = f"file://{tmp_path}/events"
    spark.createDataFrame([("a", 1, 0.5), ("a", 3, 0.7), ("b", 2, 0.1)], "key string, at int, value double").write.parquet(src)
    B.latest_metrics_stream(spark.readStream.schema("key string, at int, value double").parquet(src), "latest_values").awaitTermination()
    assert {(r.key, r.at, r.value) for r in spark.table("latest_values").collect()} == {("a", 3, 0.7), ("b", 2, 0.1)}


def test_latest_metrics_are_kept_over_streams(spark, tmp_path):
    src, root = f"file://{tmp_path}/events", f"file://{tmp_path}/kept"
    for rows in ([("a", 1, 0.5), ("a", 3, 0.7), ("b", 2, 0.1)], [("a", 2, 0.9), ("b", 4, 0.3), ("c", 1, 0.2)]):
        spark.createDataFrame(rows, "key string, at int, value double").write.mode("append").parquet(src)
        B.keep_latest_metrics(spark.readStream.schema("key string, at int, value double").parquet(src), root).awaitTermination()
    assert {tuple(r) for r in B.latest_metrics(spark, root).select("key", "at", "value").collect()} == {("a", 3, 0.7), ("b", 4, 0.3), ("c", 1, 0.2)}


def test_checkpoints(store):
    c = Checkpoint("building", ("a", "b"), 1, 2)
    store.save_checkpoint(c)
    assert store.load_checkpoint() == c and c.progress == 0.5 and Checkpoint("idle").progress is None
    for bad in (("none",), ("building", (), 3, 2), ("building", (), -1, 2)):
        with pytest.raises(ValueError):
            Checkpoint(*bad)
    store.clear_staged()
    assert store.load_checkpoint() is None


def test_failure_policy(spark):
    def last(codes):
        df = spark.createDataFrame([(1, i, {"f": "failure", "s": "success", "c": "cancelled"}[c]) for i, c in enumerate(codes)], "b int, i int, status string")
        r = O.failure_runs(df, ["b"], "i", "status").orderBy("i").collect()
        return [(x.consecutive_failures, x.abort) for x in r][-1]

    assert last("f" * 9) == (9, False) and last("f" * 10) == (10, True) and last("fffsff") == (2, False) and last("ff" + "c" * 3 + "f") == (3, False)


def test_states(spark):
    rows = [("building", True, True, "building"), ("building", False, True, "preparing"), ("failed", False, True, "failed"), ("idle", False, True, "ready"),
            ("ready", True, False, "idle"), (None, False, True, "ready"), (None, False, False, "idle")]
    df = spark.createDataFrame(rows, "stage string, p boolean, m boolean, want string")
    assert all(r[0] == r[1] for r in df.select(O.restored_state(F.col("stage"), F.col("p"), F.col("m")), "want").collect())


def test_upsert_and_pending(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "asset_id string, v int, created_at int")
    new = spark.createDataFrame([(" b ", None, 99), ("c", 3, 30), ("  ", 4, 40), (None, 5, 50)], "asset_id string, v int, created_at int")
    assert sorted(map(tuple, O.upsert(old, new).collect())) == [("a", 1, 10), ("b", None, 20), ("c", 3, 30)]
    none = old.select("asset_id").limit(0)
    assert {r.asset_id for r in O.pending(old, none, candidates=none).collect()} == {"a", "b"}
    assert {r.asset_id for r in O.pending(old, none, candidates=old.select("asset_id").limit(1)).collect()} == {"a"}
    h = spark.createDataFrame([(i, f" q{i % 30} ", i) for i in range(60)] + [(99, "  ", 99)], "event_id int, query string, ts int")
    got = O.history(h).collect()
    assert len(got) == 20 and got[0].ts == 59 and len({r["query"] for r in got}) == 20


def test_cached_embedding(spark):
    rows = assets(spark, 6).withColumn("payload", F.expr("cast(concat('t', substring(asset_id, 2) % 2) as binary)"))
    cache = spark.createDataFrame([], "fingerprint string, embedding array<float>")
    out, new = E.cached_embed(rows, "payload", cache, E.HashingEncoder(8))
    assert out.count() == 6 and new.count() == 2
    out, new = E.cached_embed(rows, "payload", new, E.NoEncoder())
    assert new.count() == 0 and out.count() == 6 and all(abs(np.linalg.norm(r.embedding) - 1) < 1e-3 for r in out.collect())


def test_golden_file(spark, tmp_path):
    doc = {"baseline_version": "1", "model": {"id": "m"}, "tolerances": {"similarity_abs_diff_max": 0.002},
           "text_cases": [{"id": "t", "text": "Café", "token_ids": [1, 2], "text_embedding": [0.6, 0.8]}],
           "image_cases": [{"id": "i", "image": "i.jpg", "image_embedding": [1.0, 0.0]}],
           "similarity_cases": [{"id": "a", "image_case_id": "i", "text_case_id": "t", "similarity": 0.6}, {"id": "b", "image_case_id": "i", "text_case_id": "none", "similarity": 0.1}]}
    (tmp_path / "golden.json").write_text(json.dumps(doc, indent=2))
    g = golden.read(spark, f"file://{tmp_path}/golden.json")
    assert g.first().tolerances.similarity_abs_diff_max == np.float32(0.002) and g.first().model.id == "m" and g.first().generated_at is None
    assert [(r.text, r.token_ids) for r in golden.cases(g, "text").collect()] == [("Café", [1, 2])]
    got = golden.similarity_pairs(g).select("id", "similarity", V.cosine("image_embedding", "text_embedding").alias("own")).collect()
    assert [r.id for r in got] == ["a"] and abs(got[0].own - got[0].similarity) < 0.002


def test_a_crash_between_writing_and_renaming_leaves_the_old_file(spark, tmp_path, monkeypatch):
    from lodestar.sources.store import IndexStore

    store = IndexStore(spark, "file://" + str(tmp_path))
    store._write("manifest.json", {"a": 1})
    store._write("manifest.json", {"a": 2})
    assert store._read("manifest.json") == {"a": 2}

    def fails(*_):
        raise OSError("lost")

    monkeypatch.setattr(store, "_replace", fails)
    try:
        store._write("manifest.json", {"a": 3})
    except OSError:
        pass
    assert store._read("manifest.json") == {"a": 2}
