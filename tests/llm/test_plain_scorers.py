"""Slow scorers written from the description, with the same dictionaries or parameters: every score must agree."""

import math
import random

import numpy as np
import zstandard

from lodestar.llm import compression_quality as Q
from lodestar.llm import toxicity as X


def plain_quality(model, text):
    raw = text.encode("utf-8", "surrogatepass")
    sizes = []
    for d in (model.good, model.bad):
        total = 0
        for at in range(0, len(raw), 1024):
            held = zstandard.ZstdCompressionDict(d)
            total += len(zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=False, write_dict_id=False).compress(raw[at:at + 1024]))
        sizes.append(total)
    good, bad = sizes
    w = model.weights
    z = w[0] + w[1] * 100 * (bad - good) / max(len(raw), 1) + w[2] * 10 * (bad - good) / max(min(good, bad), 1)
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_quality_scores_equal_the_plain_ones():
    rnd = random.Random(2)
    words = ["".join(rnd.choices(["th", "on", "er", "an", "ré", "in", "漢"], k=rnd.randint(1, 4))) for _ in range(500)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(20, 300))) for _ in range(300)]
    texts = [t if i % 3 else t.upper() + "!!" * (i % 7) for i, t in enumerate(texts)]
    model = Q.fit(texts, [int(i % 3 > 0) for i in range(300)], dictionary=20_000)
    odd = ["", " ", "x", "y" * 1024, "y" * 1025, "z " * 30_000, "\0\ud800", texts[0], texts[0]]  # very long, repeated, ends of pieces
    got = model.scores([t.encode("utf-8", "surrogatepass") for t in texts[:40] + odd])
    assert np.allclose(got, [plain_quality(model, t) for t in texts[:40] + odd], atol=1e-9) and got[0] != got[1]


def sigmoid(x):
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def plain_window(net, words):
    """The logit of one window: two recurrent passes word by word, attention, one weighted sum."""
    p, h = {k: v.astype(float) for k, v in net.p.items()}, X.HIDDEN
    inputs = []
    for w in words:
        b = f"^{w}$".encode()
        triples = [(b[i] * 961 + b[i + 1] * 31 + b[i + 2]) % X.GRAMS for i in range(len(b) - 2)]
        chars = sum(p["C"][g] for g in triples) / len(triples) if triples else np.zeros(X.CHAR_DIM)
        inputs.append([*p["E"][net.vocab.get(w, 0)], *chars])
    states = [[None] * len(words), [None] * len(words)]
    for k in (0, 1):
        s = [0.0] * h
        for t in range(len(words)) if k == 0 else reversed(range(len(words))):
            px = [sum(x * p["W"][k][i][j] for i, x in enumerate(inputs[t])) + p["b"][k][0][j] for j in range(3 * h)]
            zr = [sigmoid(px[j] + sum(s[i] * p["U"][k][i][j] for i in range(h))) for j in range(2 * h)]
            z, r = zr[:h], zr[h:]
            cand = [math.tanh(px[2 * h + j] + sum(r[i] * s[i] * p["U"][k][i][2 * h + j] for i in range(h))) for j in range(h)]
            s = [old + z[j] * (cand[j] - old) for j, old in enumerate(s)]
            states[k][t] = s
    if not words:
        return p["c"][0]
    both = [np.array([*states[0][t], *states[1][t]]) for t in range(len(words))]
    score = [float(b @ p["a"]) for b in both]
    weight = [math.exp(v - max(score)) for v in score]
    pooled = sum(w * b for w, b in zip(weight, both)) / sum(weight)
    return float(pooled @ p["v"] + p["c"][0])


def plain_toxicity(net, text):
    words = [X.normal(w) for w in text.split()]
    logits = [plain_window(net, words[at:at + X.WINDOW]) for at in range(0, max(1, len(words) - X.WINDOW + X.STRIDE), X.STRIDE)]
    return sigmoid(max(-30, min(30, max(logits))))


def test_toxicity_scores_equal_the_plain_ones():
    rnd = random.Random(3)
    words = ["the", "Nation,", "ing!", "thé", "漢字", "idiot", "moron", "it's", "--", "STou"]
    texts = [" ".join(rnd.choices(words, k=n)) for n in (1, 2, 5, 63, 64, 65, 111, 112, 113, 160, 161, 300)]
    net = X.train([" ".join(rnd.choices(words[:5] + words[5:7] * (i % 2), k=20)) for i in range(200)], [i % 2 for i in range(200)], least=30)
    texts += ["", " \n", texts[3], texts[3]]
    got = X.Scorer(net)(texts)
    want = [plain_toxicity(net, t) for t in texts]
    assert np.allclose(got, want, atol=2e-5), np.abs(np.array(want) - got).max()
    assert max(want) - min(want) > 0.05
