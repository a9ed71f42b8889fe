import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import simhash
from lodestar.llm.shared import connected_components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    n = max(1, len(words) - 2)
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(n)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    for t in (None, "", " \t", "one", "A b", "a b c", "a b c d a b c d", "Ärger ÄRGER x y", "x " * 5000):
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 120))) for _ in range(150)]
    texts += [t + " tail" for t in texts[:60]] + texts[:20] + [None, "", "  "]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)],
                                 "doc_id long, text string, fp string, component_id string")
    got = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == components(fps)


def test_bk_links_find_every_component():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, 40).astype(np.uint64)
    fps = []
    for b in base.tolist():
        for _ in range(30):
            x = b
            for bit in rnd.integers(0, 64, rnd.integers(0, 9)).tolist():
                x ^= 1 << bit
            fps.append(x)
    fps = np.array(sorted(set(fps)), np.uint64)
    a, b = simhash.bk_links(np.zeros(len(fps), np.int64), fps, 3, block=128)
    root = list(range(len(fps)))
    for x, y in zip(a.tolist(), b.tolist()):
        assert (int(fps[x]) ^ int(fps[y])).bit_count() <= 3
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        assert x != y  # a forest
        root[max(x, y)] = min(x, y)
    flat = []
    for i in range(len(fps)):
        while root[i] != i:
            i = root[i]
        flat.append(i)
    assert flat == components([int(x) for x in fps])


def test_empty_and_hot(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(docs).count() == 0
    same = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"))
    assert {r.component_id for r in simhash.simhash_components(same).collect()} == {0}


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (95, 100), (200, 201)] + [(300, i) for i in range(301, 340)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[100] == got[95] == 90 and got[201] == 200 and got[320] == 300
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
