import random

import numpy as np

from lodestar.llm import toxicity

BAD = ["idiot", "moron", "scum"]


def corpus(n, seed=0):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("the", "on", "er", "an", "re") for b in ("tion", "ing", "nd", "th", "st", "ou")]
    out = []
    for i in range(n):
        t = rnd.choices(words, k=rnd.randint(5, 300))
        y = int(i % 3 == 0)
        for _ in range(2 * y):
            t.insert(rnd.randint(0, len(t)), rnd.choice(BAD))
        out.append((" ".join(t), y))
    return out


def test_gradients():
    rnd = np.random.default_rng(0)
    net = toxicity.Network({"a": 1, "b": 2})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["E"][1:] = rnd.normal(size=(2, toxicity.WORD_DIM))
    x = net.inputs(["a", "b", "xyz"])
    ids, n = np.array([[0, 1, 2, 1] + [0] * 60, [2, 0] + [0] * 62]), np.array([4, 2])
    loss = lambda: float(net.forward(net.project(net.inputs(["a", "b", "xyz"])), ids, n) @ np.array([1.0, -2.0]))
    px = net.project(x)
    _, kept = net.forward(px, ids, n, keep=True)
    grad, dx = net.gradients(px, x, ids, n, np.array([1.0, -2.0]), kept)
    grad["E"] = np.zeros_like(net.p["E"])
    grad["E"][[1, 2]] = dx[:2, :toxicity.WORD_DIM]
    for k, at in (("v", 3), ("a", 5), ("c", 0), ("U", (0, 2, 5)), ("U", (1, 1, 20)), ("W", (0, 3, 9)), ("W", (1, 0, 2)), ("b", (1, 0, 17)), ("E", (1, 2))):
        was, eps = net.p[k][at], 1e-3
        net.p[k][at] = was + eps
        up = loss()
        net.p[k][at] = was - eps
        down = loss()
        net.p[k][at] = was
        assert abs((up - down) / (2 * eps) - grad[k][at]) < 1e-2 * max(1, abs(grad[k][at])), k


def test_windows_cover_and_overlap():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        s = list(toxicity.window_starts(n))
        assert s[0] == 0 and s[-1] + toxicity.WINDOW >= n and all(b - a < toxicity.WINDOW for a, b in zip(s, s[1:]))


def test_batches_score_as_alone():
    net = toxicity.Network({"aa": 1})
    texts = ["aa bb " * 100, "", "cc", "aa " * 64]
    alone = [toxicity.Scorer(net)([t])[0] for t in texts]
    assert np.allclose(alone, toxicity.Scorer(net, most=2)(texts), atol=1e-5)


def test_learns(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(corpus(400))]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(900, None, 0.1), (901, "", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(r.predicted, y) for i, _, y in rows if (r := got[i]).held_out]
    assert len(got) == 402 and 40 < len(held) < 140
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values()) and got[900].predicted == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, labels).collect()] == [0.0]
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_misspelt_words_are_caught_by_their_characters():
    """Words that training has never seen are read by their characters alone."""
    rnd = random.Random(8)
    plain = ["".join(rnd.choices(["ba", "lo", "mi", "tu", "ren", "sal", "vo"], k=rnd.randint(2, 4))) for _ in range(400)]
    bad = ["idiotic", "worthless", "disgusting", "pathetic", "scumbag", "stupidity"]
    text = lambda extra: " ".join(rnd.sample(rnd.choices(plain, k=40) + extra, 40 + len(extra)))
    texts = [text([]) for _ in range(300)] + [text(rnd.choices(bad, k=3)) for _ in range(150)]
    net = toxicity.train(texts, [0] * 300 + [1] * 150)
    odd = [w[:3] + w[3] + w[3:] for w in bad] + [w[:-1] + "kk" for w in bad]  # a letter doubled, another ending
    assert not set(odd) & set(net.vocab)
    clean, misspelt = toxicity.Scorer(net)([text([]) for _ in range(100)]), toxicity.Scorer(net)([text(rnd.choices(odd, k=3)) for _ in range(100)])
    assert (misspelt[:, None] > clean[None]).mean() > 0.9, (misspelt[:, None] > clean[None]).mean()
    assert (misspelt >= 0.5).mean() > 0.8 and (clean < 0.5).mean() > 0.8, (misspelt, clean)
