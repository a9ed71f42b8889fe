import datetime as dt
import os
import sys
import threading
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestar.functions import encoders as E
from lodestar.sources.codec import CorruptIndex
from lodestar.sources.store import ASSET, IndexStore, Manifest
from lodestar.streaming import index_build as B

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't know this file
AT = dt.datetime.fromtimestamp(1710000000)


def manifest(dim=8):
    return Manifest("m", "1", "M", dim, 224, 52, "model", "resource", "2024-03-09", "2024-03-09")


@pytest.fixture
def store(spark, tmp_path):
    return IndexStore(spark, f"file://{tmp_path}/index")


def assets(spark, n, text="text "):
    return spark.range(n).select(F.format_string("a%04d", "id").alias("asset_id"), F.concat(F.lit(text), "id").cast("binary").alias("payload"),
                                 F.lit(AT).alias("created_at"), F.lit(AT).alias("updated_at")).repartition(3)


class Counting(E.HashingEncoder):
    """Notes what it encodes in files, fails for payloads that hold `bad`, dies of those that hold `deadly`, and can be slow."""

    def __init__(self, folder, bad=b"\0", deadly=b"\0", wait=0.0):
        super().__init__(8)
        os.makedirs(folder, exist_ok=True)
        self.folder, self.bad, self.deadly, self.wait, self.key = str(folder), bad, deadly, wait, (str(folder), bad, deadly, wait)

    def load(self):
        with open(f"{self.folder}/load-{os.getpid()}-{time.time_ns()}", "w"):
            pass

    def encode(self, payloads):
        time.sleep(self.wait)
        if any(self.deadly in p for p in payloads):
            os._exit(1)
        if any(self.bad in p for p in payloads):
            raise ValueError("can't be read")
        with open(f"{self.folder}/{os.getpid()}-{time.time_ns()}", "wb") as f:
            f.write(b"\n".join(payloads))
        return super().encode(payloads)


def encoded(folder):
    return sorted(x for f in os.listdir(folder) if not f.startswith("load") for x in open(f"{folder}/{f}", "rb").read().split(b"\n"))


def test_a_build_that_dies_in_its_fifth_slice_goes_on_there(spark, store, tmp_path):
    a = assets(spark, 80)
    seen = []
    with pytest.raises(Exception):  # noqa: B017
        B.build(store, a, Counting(tmp_path / "one", deadly=b"text 45"), manifest(), rows_a_slice=10, progress=lambda c: seen.append((c.stage, c.completed)))
    assert seen == [("building", n) for n in (0, 10, 20, 30, 40)] + [("failed", 40)]
    c = store.load_checkpoint()
    assert (c.stage, c.completed, c.total, c.progress) == ("failed", 40, 80, 0.5) and store.load_candidates(c.candidates).count() == 80 and store.load_manifest() is None
    assert B.build(store, a, Counting(tmp_path / "two"), manifest(), rows_a_slice=10).item_count == 80
    assert encoded(tmp_path / "two") == sorted(b"text %d" % i for i in range(40, 80))
    got = store.load_snapshot()[1]
    assert got.select("asset_id").distinct().count() == 80 and store.load_checkpoint() is None and not store.commits()


def test_a_driver_that_dies_leaves_a_build_to_resume(spark, store, tmp_path):
    def dies(c):
        if c.completed == 20:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        B.build(store, assets(spark, 40), Counting(tmp_path / "one"), manifest(), rows_a_slice=10, progress=dies)
    assert store.load_checkpoint().stage == "building"
    again = IndexStore(spark, store.root)
    more = assets(spark, 50)  # ten of them aren't candidates
    assert B.resume(again, more, Counting(tmp_path / "two"), manifest(), rows_a_slice=10).item_count == 40
    assert encoded(tmp_path / "two") == sorted(b"text %d" % i for i in range(20, 40))
    assert B.resume(again, more, E.NoEncoder(), manifest()).item_count == 40  # nothing to go on with
    with pytest.raises(KeyboardInterrupt):
        B.build(again, more, Counting(tmp_path / "three"), manifest(), rows_a_slice=10, reuse=False, progress=dies)
    assert B.resume(again, more.where("false"), E.NoEncoder(), manifest()) is None and again.load_checkpoint() is None
    with pytest.raises(B.Nothing):
        B.build(again, more.where("false"), E.NoEncoder(), manifest())


def test_what_was_written_without_a_commit_is_not_read(spark, store, monkeypatch):
    one = E.embed(assets(spark, 3), "payload", E.HashingEncoder(8)).select("asset_id", F.lit("f").alias("fingerprint"), "embedding", "created_at", "updated_at")
    with monkeypatch.context() as m:
        m.setattr(store, "_write", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.stage(one, "x")
    assert store.staged().count() == 0
    store.stage(one, "x")
    store.stage(one.limit(2), "x")  # done over
    assert store.staged().count() == 2


def test_failures_are_passed_over_counted_and_tried_again(spark, store, tmp_path):
    with pytest.raises(CorruptIndex, match="3 assets have no entry"):
        B.build(store, assets(spark, 30), Counting(tmp_path / "one", bad=b"text 2"), manifest(),
                spark.createDataFrame([(f"a{i:04d}",) for i in (1, 2, 3, 20, 4, 21, 5)], "asset_id string"))
    c = store.load_checkpoint()
    assert (c.stage, c.completed, c.failed) == ("failed", 4, 3)
    assert {(r.asset_id, r.error) for r in store.failures().collect()} == {(f"a{i:04d}", "can't be read") for i in (2, 20, 21)}
    assert B.build(store, assets(spark, 30), Counting(tmp_path / "two"), manifest()).item_count == 30
    assert len(encoded(tmp_path / "two")) == 26


def test_ten_failures_in_a_row_end_a_build_even_over_slices(spark, store, tmp_path):
    for k, (bad, ends) in enumerate(((b"text 1", True), (b"text 2", False))):  # a0010 to a0019 fail in a row; of twenty-nine, a0020 to a0028 do
        a = assets(spark, 29).where("asset_id <> 'a0001' and asset_id <> 'a0002'")
        with pytest.raises(CorruptIndex, match="10 failures in a row" if ends else "9 assets have no entry"):
            B.build(store, a, Counting(tmp_path / f"{k}", bad=bad), manifest(), fresh=True, rows_a_slice=7)


def test_cancelling(spark, store, tmp_path):
    stop = B.Cancellation(spark)
    got = B.build(store, assets(spark, 40), Counting(tmp_path / "one"), manifest(), rows_a_slice=10, cancellation=stop, progress=lambda c: c.completed == 20 and stop.cancel())
    assert (got.stage, got.completed) == ("building", 20) == (store.load_checkpoint().stage, store.load_checkpoint().completed)
    stop = B.Cancellation(spark)
    threading.Timer(4, stop.cancel).start()
    began = time.time()
    got = B.build(store, assets(spark, 40), Counting(tmp_path / "slow", wait=60), manifest(), rows_a_slice=10, cancellation=stop)
    assert (got.stage, got.completed) == ("building", 20) and time.time() - began < 40
    assert B.resume(store, assets(spark, 40), Counting(tmp_path / "two"), manifest(), rows_a_slice=10).item_count == 40
    assert encoded(tmp_path / "two") == sorted(b"text %d" % i for i in range(20, 40))
    assert spark.range(5).count() == 5  # later jobs aren't touched


def test_only_changes_are_encoded(spark, store, tmp_path):
    assert B.build(store, assets(spark, 10), Counting(tmp_path / "one"), manifest()).item_count == 10
    now = assets(spark, 12).where("asset_id > 'a0003'").withColumn("payload", F.when(F.col("asset_id") == "a0005", F.lit(b"other")).otherwise(F.col("payload")))
    entries = store.load_snapshot()[1]
    changes = {r.asset_id: r.change for r in B.change_set(entries, now).collect()}
    assert [changes[f"a{i:04d}"] for i in range(12)] == ["removed"] * 4 + ["same", "changed", "same", "same", "same", "same", "added", "added"]
    assert B.build(store, now, Counting(tmp_path / "two"), manifest()).item_count == 8
    assert encoded(tmp_path / "two") == [b"other", b"text 10", b"text 11"]
    assert B.build(store, now, Counting(tmp_path / "three"), Manifest(**manifest().__dict__ | {"model_fingerprint": "another"})).item_count == 8
    assert len(encoded(tmp_path / "three")) == 8


def test_adding_and_rebuilding_from_the_catalog(spark, store, tmp_path):
    new = lambda *ids: spark.createDataFrame([(i, None, "f", AT, AT) for i in ids], ASSET)
    payloads = lambda c: c.withColumn("payload", F.col("asset_id").cast("binary"))
    assert B.add_and_rebuild(store, new("x", "y"), payloads, Counting(tmp_path / "one"), manifest()).item_count == 2
    assert B.add_and_rebuild(store, new("z"), payloads, Counting(tmp_path / "two"), manifest()).item_count == 3 and encoded(tmp_path / "two") == [b"z"]
    assert B.rebuild(store, payloads, E.NoEncoder(), manifest()).item_count == 3
    assert B.rebuild(store, payloads, Counting(tmp_path / "three"), manifest(), reuse=False).item_count == 3 and len(encoded(tmp_path / "three")) == 3


def test_an_encoder_is_loaded_once_by_a_worker_and_again_after_a_failure(spark, tmp_path):
    enc = Counting(tmp_path / "one")
    for _ in range(3):
        E.embed(assets(spark, 40), "payload", enc).count()
        E.embed(assets(spark, 40), "payload", enc).collect()
    pids = [f.split("-")[1] for f in os.listdir(tmp_path / "one") if f.startswith("load")]
    assert pids and len(pids) == len(set(pids))
    own, tries = E.Loader(), []

    class Flaky(E.HashingEncoder):
        def load(self):
            tries.append(1)
            if len(tries) == 1:
                raise OSError("not there yet")

    assert own.state == "idle"
    with pytest.raises(OSError):
        own.get(Flaky())
    assert own.state == "failed" and isinstance(own.error, OSError)
    first = own.get(Flaky())
    assert own.state == "ready" and own.get(Flaky()) is first and len(tries) == 2 and own.error is None


def test_slices_do_not_depend_on_how_ids_are_ranged(spark, store, monkeypatch):
    ids = assets(spark, 1000).select("asset_id")
    for parts in (1, 4, 90):
        frame = type(ids)
        with monkeypatch.context() as m:
            m.setattr(frame, "repartitionByRange", lambda self, n, *c, f=frame.repartitionByRange: f(self, parts, *c))
            dealt, slices = B.slices_of(store, ids, 1000, 250)
        assert sum(s.rows for s in slices) == 1000 == dealt.count() and len(slices) == min(parts, 4) and all(a.high < b.low for a, b in zip(slices, slices[1:]))
        assert all(dealt.where(F.col("part").between(s.first, s.last)).agg(F.min("asset_id"), F.max("asset_id"), F.count("*")).first() == (s.low, s.high, s.rows) for s in slices)


def test_letters():
    x = E.LetterEncoder().encode([b"abba z", b"", b"\xff12"])
    assert x[0, :2].tolist() == [2, 2] and x[0, 25] == 1 and x[1].tolist() == [1] + [0] * 25 == x[2].tolist() and np.isfinite(x).all()


def test_states_of_a_build_and_what_a_start_does(spark, store, tmp_path):
    from lodestar.streaming import progress as P

    states, stop = P.ProgressTable(store), B.Cancellation(spark)
    note = states.of_build("first")
    assert P.current_state(store) == P.BuildState("idle") and states.states().count() == 0

    def until_ten(c):
        note(c)
        if c.completed == 10:
            stop.cancel()

    B.build(store, assets(spark, 30), Counting(tmp_path / "one"), manifest(), rows_a_slice=10, cancellation=stop, progress=until_ten)
    assert P.current_state(store) == P.BuildState("building", 10, 30)
    assert [(r.step, r.stage, r.rows, r.total) for r in states.states().orderBy("step").collect()] == [(0, "building", 0, 30), (1, "building", 10, 30), (2, "building", 10, 30)]
    assert P.start(store, assets(spark, 30), Counting(tmp_path / "two"), manifest()) == P.BuildState("ready", items=30) and len(encoded(tmp_path / "two")) == 20
    assert P.start(store, assets(spark, 30), E.NoEncoder(), manifest()).stage == "ready"
    with pytest.raises(Exception, match="no encoder"):
        B.build(store, assets(spark, 30, "new "), E.NoEncoder(), manifest(), reuse=False, progress=note)
    assert P.current_state(store).stage == "failed" == states.last().first().stage
    assert P.start(store, assets(spark, 30, "new "), Counting(tmp_path / "three"), manifest()).stage == "ready"


def test_states_of_a_stream(spark, store, tmp_path):
    from lodestar.streaming import progress as P

    listener, states = P.StreamProgress(P.ProgressTable(store)), P.ProgressTable(store)
    spark.streams.addListener(listener)
    try:
        for n in range(2):
            assets(spark, 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            B.stage_stream(spark, str(tmp_path / "in"), assets(spark, 1).schema, store, E.HashingEncoder(8), str(tmp_path / "state"), 1).awaitTermination()
        until = time.time() + 30
        while time.time() < until and states.last().where("stage = 'ready'").count() < 2:
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    assert sorted((r.stage, r.rows) for r in states.last().collect()) == [("ready", 5), ("ready", 5)] and states.states().where("stage = 'preparing'").count() == 2
    assert store.staged().count() == 5
