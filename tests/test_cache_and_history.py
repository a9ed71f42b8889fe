import datetime as dt
import os
import random
import sys
import time

from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestar.functions import encoders as E
from lodestar.sources.vector_cache import OVERHEAD, VectorCache
from lodestar.streaming import search_history as H

cloudpickle.register_pickle_by_value(sys.modules[__name__])
ONE = 26 * 4 + OVERHEAD


class Noting(E.LetterEncoder):
    def __init__(self, folder):
        super().__init__()
        os.makedirs(folder, exist_ok=True)
        self.folder = self.key = str(folder)

    def encode(self, payloads):
        with open(f"{self.folder}/{os.getpid()}-{time.time_ns()}", "wb") as f:
            f.write(b"\n".join(payloads))
        return super().encode(payloads)


def encoded(folder):
    found = sorted(x for f in os.listdir(folder) for x in open(f"{folder}/{f}", "rb").read().split(b"\n"))
    for f in os.listdir(folder):
        os.remove(f"{folder}/{f}")
    return found


def rows(spark, *texts):
    return spark.createDataFrame([(i, None if t is None else t.encode()) for i, t in enumerate(texts)], "n int, payload binary").repartition(2)


def test_cache_encodes_once_evicts_by_last_use_and_clears(spark, tmp_path):
    enc = Noting(tmp_path / "calls")
    c = VectorCache(spark, f"file://{tmp_path}/cache", budget=4 * ONE, bits=1 << 12)
    assert c.counts() == {"count": 0, "bytes": 0}
    got = {r.n: r for r in c.embed(rows(spark, "aa", "bb", "aa", None, ""), "payload", enc).collect()}
    assert len(got) == 5 and encoded(enc.folder) == [b"", b"aa", b"bb"] and got[0].embedding == got[2].embedding and got[1].embedding[1] == 1
    assert c.counts() == {"count": 3, "bytes": 3 * ONE}
    c.embed(rows(spark, "bb", "cc"), "payload", enc).collect()
    assert encoded(enc.folder) == [b"cc"] and c.counts()["count"] == 4
    again = VectorCache(spark, c.root, c.budget, c.bits)  # another driver
    out = again.embed(rows(spark, "aa", "dd"), "payload", enc)
    assert encoded(enc.folder) == [b"dd"] and again.counts()["count"] == 4 and out.count() == 2
    assert {r.used for r in again.entries().collect()} == {2, 3}  # the empty payload, used last in the first call, went
    again.embed(rows(spark, "aa", "bb", "cc", "dd", ""), "payload", enc).collect()
    assert encoded(enc.folder) == [b""]
    told = spark.createDataFrame([(f"x{i}",) for i in range(200)], "f string").select(again.might_hold(F.col("f")).alias("t")).where("t").count()
    assert told < 20 and again.entries().where(again.might_hold(F.col("fingerprint"))).count() == 4
    again.clear()
    assert again.counts()["count"] == 0
    again.embed(rows(spark, "aa"), "payload", enc).collect()
    other = E.HashingEncoder(8)
    assert len(again.embed(rows(spark, "aa"), "payload", other).first().embedding) == 8 and again.counts() == {"count": 1, "bytes": 32 + OVERHEAD}
    assert again.embed(rows(spark), "payload", other).count() == 0


def at(n):
    return dt.datetime.fromtimestamp(1710000000 + n)


def command(user, n, op, ident=None, query=None):
    return Row(user=user, op=op, id=ident, query=query, results=n, at=at(n))


def test_commands_in_order():
    some = [command("u", i, "add", f"i{i}", f"q{i % 3}") for i in range(5)]
    assert [e[:2] for e in H.applied([], some, 20)] == [("i4", "q1"), ("i3", "q0"), ("i2", "q2")]
    assert [e[0] for e in H.applied([], [*some, command("u", 9, "delete", "i3")], 20)] == ["i4", "i2"]
    assert H.applied([], [*some, command("u", 9, "clear"), command("u", 10, "add", "x", None)], 20) == []
    assert [e[0] for e in H.applied([], some[::-1], 2)] == ["i4", "i3"]


def test_histories_as_state(spark, tmp_path):
    rnd = random.Random(4)
    src, root, keep, want = f"{tmp_path}/in", f"file://{tmp_path}/out", 4, {}
    for batch in range(3):
        some = []
        for n in range(120):
            k = 1000 * batch + n
            op = rnd.choices(["add", "delete", "clear"], [20, 4, 1])[0]
            ident = f"i{k}" if op == "add" else f"i{1000 * batch + rnd.randint(0, n)}"
            some.append(command(rnd.choice("abc"), k, op, ident, f" q{rnd.randint(0, 8)} " if op == "add" and n % 10 else "  "))
        some += [command(None, 1, "add", "x", "x"), command("d", 1, "add", "y", "y") if batch == 0 else command("d", 2, "clear")]
        spark.createDataFrame(some, H.COMMAND).repartition(3).write.mode("append").parquet(src)
        H.keep_histories(spark.readStream.schema(H.COMMAND).parquet(src), root, keep).awaitTermination()
        for u in "abcd":
            own = [Row(**c.asDict() | {"query": (c.query or "").strip()}) for c in some if c.user == u]
            want[u] = H.applied(want.get(u, []), own, keep)
        got = {}
        for r in H.histories(spark, root).orderBy("user", "nth").collect():
            got.setdefault(r.user, []).append((r.id, r.query, r.results, r.at))
        assert got == {u: v for u, v in want.items() if v}
    assert want["d"] == []
