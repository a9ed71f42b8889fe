import random

from lodestar.llm import compression_quality as Q


def corpus(n, seed=0):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices(["th", "on", "er", "an", "re", "in", "st"], k=rnd.randint(1, 4))) for _ in range(2000)]
    out = []
    for i in range(n):
        t = rnd.choices(words, k=rnd.randint(30, 300))
        out.append((i, " ".join(t) if i % 3 else "!! ".join(w.upper() for w in t), int(i % 3 > 0)))
    return out


def test_learns(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.compression_quality(docs, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(got) == 602 and 120 < len(held) < 280 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values()) and got[9000].score == got[9001].score


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for rows in ([], [(1, 0), (2, 1)], [(None, 1), (1, None)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        assert [(r.score, r.predicted) for r in Q.compression_quality(docs, labels).collect()] == [(0.5, 1)]
    assert Q.compression_quality(docs.limit(0), labels).count() == 0


def test_pieces_are_spread():
    p = Q.pieces([bytes([i]) * 5000 for i in range(100)], 50_000)
    assert sum(map(len, p)) <= 60_000 and len({x[0] for x in p}) > 20
