import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import suffix_dedup as S


def brute(rows, size):
    """rows: (id, bytes). What suffix_dedup should return, by a dict of all substrings."""
    least = {}
    for i, t in rows:
        for k in range(len(t) - size + 1):
            x = t[k:k + size]
            least[x] = min(least.get(x, i), i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - size + 1):
            if least[t[k:k + size]] < i:
                gone[k:k + size] = True
        gone = gone[:-1] if len(t) else gone[:0]
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gämma", "δelta", "eps", "zêta", "a", "of", "the"]
    para = lambda k: " ".join(rnd.choices(words, k=k))
    common = [para(25) for _ in range(5)]
    texts = []
    for _ in range(n):
        t = [para(rnd.randint(0, 40)) for _ in range(3)]
        if rnd.random() < 0.6:
            t.insert(rnd.randint(0, 3), rnd.choice(common)[rnd.randint(0, 30):])
        texts.append("\n".join(t))
    texts += texts[:6] + ["", None, "x" * 400, "y" + "x" * 200, "ab" * 150, "zzab" + "ab" * 60, common[0], "short"]
    ids = rnd.sample(range(10000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("size,most,hot", [(50, 4_000_000, 50_000), (50, 700, 50_000), (26, 2000, 50_000), (50, 700, 2), (50, 4_000_000, 0)])
def test_against_brute_force(spark, monkeypatch, size, most, hot):
    rows = corpus(size + most)
    real = S.blocks
    monkeypatch.setattr(S, "blocks", lambda *a: real(*a, most=most))
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, block string, lens int").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.suffix_dedup(docs, size=size, hot=hot).collect())
    want = brute([(i, (t or "").encode()) for i, t in rows], size)
    assert got == want and any(x[2] for x in want)


def test_repeated_ids_nulls_and_empty(spark):
    t = "the quick brown fox jumps over the lazy dog again and again " * 2
    docs = spark.createDataFrame([(5, t, "a"), (5, t, "b"), (None, t, "c"), (7, None, "d")], "doc_id long, text string, lang string")
    got = {(r.doc_id, r.extra): r for r in S.suffix_dedup(docs, extra=F.col("lang"), kept_text=True).collect()}
    assert got[5, "a"].n_removed == got[5, "b"].n_removed == 0 and got[5, "a"].text == t
    assert got[None, "c"].n_removed == len(t) and got[None, "c"].text == "" and got[7, "d"].n_bytes == 0
    assert S.suffix_dedup(docs.limit(0)).count() == 0


def test_hot_passage(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(passage), F.sha2(
        (-F.col("id")).cast("string"), 256)).alias("text"))
    rows = [(r.doc_id, r.text.encode()) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.suffix_dedup(docs).collect())
    assert got == brute(rows, 50)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcÿ", min_size=12, max_size=40), min_size=1, max_size=8, unique=True), st.integers(4, 10))
def test_suffix_order(strings, size):
    raw = [s.encode() for s in strings]
    raw = [r for r in raw if len(r) >= size]
    t = np.frombuffer(b"\xff".join(raw) + b"\xff" * (size + 40), np.uint8) + np.uint8(1)
    lens = np.array([len(r) for r in raw])
    start = np.r_[0, np.cumsum(lens + 1)[:-1]]
    stop = start + lens - size + 1
    sa = S.suffix_order(t, start, stop, size + 6)
    asked = np.concatenate([np.arange(a, b) for a, b in zip(start, stop)])
    sa = sa[np.isin(sa, asked)]
    assert sorted(sa.tolist()) == sorted(asked.tolist())
    keys = [bytes(t[k:k + size]) for k in sa.tolist()]
    assert keys == sorted(keys)


def test_texts_stay_in_their_blocks(spark):
    docs = spark.createDataFrame(corpus(5), "doc_id long, text string")
    plan = S.suffix_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(moved) == 1, plan  # what the shards found, not the blocks
