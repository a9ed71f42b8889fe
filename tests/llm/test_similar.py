import random
import time

import corpus_pipeline
from lodestar.llm import simhash


def shingle_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if s == t or 5 * len(s & t) >= 4 * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def corpus():
    """Near copies planted at similarities 0.8 to 0.95 and below, a hot group of copies of copies, short and blank texts."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    texts, planted = [], []
    for _ in range(60):
        w = rnd.choices(words, k=rnd.choice([60, 200, 600]))
        texts.append(" ".join(w))
        for _ in range(3):
            v = list(w)
            for at in rnd.sample(range(len(v)), rnd.randint(1, max(1, len(v) // 35))):
                v[at] = rnd.choice(words)
            a, b = shingle_set(texts[-1]), shingle_set(" ".join(v))
            planted.append(len(a & b) / len(a | b))
            texts.append(" ".join(v))
    base = rnd.choices(words, k=120)
    for _ in range(120):
        v = list(base)
        for at in rnd.sample(range(120), rnd.randint(0, 8)):
            v[at] = rnd.choice(words)
        texts.append(" ".join(v))
    return texts + [None, "", "  ", "a b c", "A  B c", "a b d"], planted


def test_against_brute_force(spark):
    texts, planted = corpus()
    want = brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sum(0.8 <= s <= 0.95 for s in planted) > 50
    for block in (4000, 25):
        got = {r.doc_id: r.component_id for r in simhash.similar_components(docs, block=block).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == set(want)
    # three differing bits of three-word fingerprints leave most of the planted copies
    assert len({r.component_id for r in simhash.simhash_components(docs).collect()}) > len(set(want))


def test_ids(spark):
    long = " ".join(f"x{i}" for i in range(40))
    rows = [(None, "clean and distinct text of its own"), (1, long), (2, long + " y"), (2, "other words"), (3, long), (None, long), (1, long), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    kept = sorted((r.doc_id or 0, (r.text or "")[:3]) for r in simhash.keep_one(docs).collect())
    assert kept == [(0, ""), (0, "cle"), (1, "x0 "), (2, "oth")]
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_unlike_texts_of_one_id_stay_apart(spark):
    """Nodes of the graph are fingerprints: id 1 has two texts, which link nothing."""
    a, b = "one two three four five six", "red green blue black white gray"
    docs = spark.createDataFrame([(1, a), (1, b), (5, b), (7, b), (9, a)], "doc_id long, text string")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect())
    assert {r[2] for r in got} == {1} and len({r[1] for r in got}) == 2
    docs = docs.where("doc_id <> 1").union(spark.createDataFrame([(5, a)], docs.schema))
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_components(docs).collect()}
    assert len(got) == 4 and set(got.values()) == {5}


def test_hot_keys_are_dealt_into_parts(spark):
    """Fingerprints that share most bits: every key holds many of them."""
    import numpy as np

    rnd = np.random.default_rng(3)
    fp = {int(0x1234567890ABCDEF) ^ sum(1 << int(k) for k in rnd.choice(64, rnd.integers(0, 9), replace=False)) for _ in range(300)}
    fp = sorted(x - (1 << 64) if x >> 63 else x for x in fp)
    df = spark.createDataFrame([(x,) for x in fp], "fp long")
    found = [(r.src, r.dst) for r in simhash.links(df, part=20).collect()]
    near = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3
    assert found and all(near(a, b) for a, b in found)

    def groups(edges):
        root = {x: x for x in fp}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            u, v = sorted((find(a), find(b)))
            root[v] = u
        return [find(x) for x in fp]

    assert groups(found) == groups([(a, b) for a in fp for b in fp if a < b and near(a, b)])


def test_a_large_group_of_near_copies_is_linked_by_few_comparisons(monkeypatch):
    """2000 near copies: nearly every pair is a hit, but a spanning forest needs one comparison each."""
    rnd = random.Random(2)
    base = rnd.choices([f"w{i}" for i in range(500)], k=200)
    rows = []
    for k in range(2000):
        v = list(base)
        v[rnd.randrange(200)] = f"x{k}"
        h = simhash.shingles(" ".join(v))
        rows.append((simhash.set_digest(h), 0, h))
    began = time.process_time()
    assert len(simhash.similar_links(rows, 0.8, True)) == 1999 and time.process_time() - began < 30
