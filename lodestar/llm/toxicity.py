"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is a word vector (for words of the training vocabulary, zero else) beside the mean of the vectors of its
hashed character triples. Two gated recurrent layers read a window of words in both directions, attention weighs their
states, and a logistic unit scores the pooled state. A text is covered by overlapping windows, all of which are scored;
the text's score is the highest. Training sees whole labelled texts in the same way: in each step the windows of a batch
of texts are scored and the loss is taken at each text's highest window.

The network is fitted on a bounded sample of labelled rows (`per_class` of each label, the smallest by a hash of their
id) and has a bounded size (`vocabulary` words), so it is broadcast. Every row of the input is scored where it is read.
Every fourth step of training reads all words by their characters alone, so that misspelt words are recognised, too. Training weighs both labels the same; afterwards the logit is moved by a share of the log odds of label 1
among all labelled rows that training may see. The share is the one with the best F1 on a part of the training sample that
the network was not fitted on (every 6th row of either label, by a hash of the id); a half where that part is too small.

Defined results: a null or blank text scores the network's output for a window without words; a table without labels of
both kinds scores 0 everywhere; repeated rows are scored each; of texts whose windows tie, either counts the same; very
long texts are scored in all their windows; an id that is no number is null; an empty table gives no rows; other columns
are not read."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fitted, labelled, labelled_sample

HIDDEN, WORD_DIM, CHAR_DIM, GRAMS = 8, 8, 6, 4096
WINDOW, STRIDE = 64, 48
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def normal(word: str) -> str:
    """Lower case, without punctuation at either end."""
    return word.lower() if word.isalnum() else _EDGES.sub("", word).lower()


def grams(word: str) -> list[int]:
    b = f"^{word}$".encode("utf-8", "surrogatepass")
    return [(b[i] * 961 + b[i + 1] * 31 + b[i + 2]) % GRAMS for i in range(len(b) - 2)]


def window_starts(n: int) -> range:
    """The first word of each window over n words: every word is in a window, neighbours overlap."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


class Network:
    """Parameters in a dict of float32 arrays; vocab maps a normalised word to its row of E, row 0 being all other words."""

    def __init__(self, vocab: dict[str, int], seed: int = 0):
        rnd = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.vocab = vocab
        self.grams = grams  # while training, with a cache
        self.p = {
            "E": np.zeros((len(vocab) + 1, WORD_DIM)), "C": rnd.normal(0, 0.1, (GRAMS, CHAR_DIM)),
            "W": rnd.normal(0, d**-0.5, (2, d, 3 * h)), "U": rnd.normal(0, h**-0.5, (2, h, 3 * h)), "b": np.zeros((2, 1, 3 * h)),
            "a": rnd.normal(0, 0.1, 2 * h), "v": rnd.normal(0, 0.3, 2 * h), "c": np.full(1, -1.0),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, words: list[str], known: np.ndarray | None = None) -> np.ndarray:
        """(len(words), WORD_DIM + CHAR_DIM): the input vectors of normalised words. known: their rows of E."""
        g = [self.grams(w) for w in words]
        n = np.fromiter(map(len, g), np.int64, len(g))
        mean = np.zeros((len(words), CHAR_DIM), np.float32)
        some = np.flatnonzero(n)
        if len(some):
            flat = np.fromiter((x for y in g for x in y), np.int64, n.sum())
            at = np.r_[0, np.cumsum(n[some])[:-1]]
            mean[some] = np.add.reduceat(self.p["C"][flat], at, axis=0) / n[some, None]
        return np.concatenate([self.p["E"][[self.vocab.get(w, 0) for w in words] if known is None else known], mean], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """(2, n, 3 HIDDEN): input vectors times the input weights of both directions."""
        return np.matmul(x[None], self.p["W"]) + self.p["b"]

    def forward(self, px: np.ndarray, ids: np.ndarray, n: np.ndarray, keep: bool = False):
        """Logits of windows. px: projected inputs of distinct words, ids: (windows, WINDOW) rows of px, n: words in each,
        in falling order (so the live windows of a step are a prefix)."""
        h, B = HIDDEN, len(n)
        T = max(1, int(n[0])) if B else 1
        live = [int(np.searchsorted(-n, -t)) for t in range(T)]  # windows with more than t words
        state = np.zeros((2, T, B, h), np.float32)
        tape = [[None] * T, [None] * T]
        for k in (0, 1):
            U, s = self.p["U"][k], np.zeros((B, h), np.float32)
            Uzr, Uc = np.ascontiguousarray(U[:, :2 * h]), np.ascontiguousarray(U[:, 2 * h:])
            pk = px[k]
            for t in range(T) if k == 0 else range(T - 1, -1, -1):
                m = live[t]
                g = pk[ids[:m, t]]
                old = s[:m]
                zr = old @ Uzr
                zr += g[:, :2 * h]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z, r = zr[:, :h], zr[:, h:]
                cand = np.tanh(g[:, 2 * h:] + (r * old) @ Uc)
                new = old + z * (cand - old)
                if keep:
                    tape[k][t] = (m, old.copy(), zr, cand)
                s[:m] = new
                state[k, t, :m] = new
        both = np.concatenate([state[0], state[1]], axis=2)  # T, B, 2h
        score = both @ self.p["a"]
        score[np.arange(T)[:, None] >= n[None]] = -1e9
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        weight[:, n == 0] = 0
        pooled = np.einsum("tb,tbh->bh", weight, both)
        logit = pooled @ self.p["v"] + self.p["c"][0]
        return (logit, (both, weight, pooled, tape, T)) if keep else logit

    def gradients(self, px, words_x, ids, n, dlogit, kept):
        """Of the loss with derivative dlogit by the logits: for the parameters but E and C, and for words_x."""
        h = HIDDEN
        both, weight, pooled, tape, T = kept
        grad = {"v": dlogit @ pooled, "c": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * self.p["v"]
        dw = np.einsum("bh,tbh->tb", dpool, both)
        ds = weight * (dw - (weight * dw).sum(0))
        grad["a"] = np.einsum("tb,tbh->h", ds, both)
        dboth = weight[:, :, None] * dpool[None] + ds[:, :, None] * self.p["a"]
        dpx = np.zeros_like(px)
        grad["U"] = np.zeros_like(self.p["U"])
        for k in (0, 1):
            U = self.p["U"][k]
            carry = np.zeros((len(n), h), np.float32)
            for t in range(T - 1, -1, -1) if k == 0 else range(T):
                m, old, zr, cand = tape[k][t]
                z, r = zr[:, :h], zr[:, h:]
                d = carry[:m] + dboth[t, :m, k * h:(k + 1) * h]
                dc = d * z * (1 - cand * cand)
                dz = d * (cand - old) * z * (1 - z)
                dro = dc @ U[:, 2 * h:].T
                dr = dro * old * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                grad["U"][k, :, :2 * h] += old.T @ dzr
                grad["U"][k, :, 2 * h:] += (r * old).T @ dc
                carry[:m] = d * (1 - z) + dro * r + dzr @ U[:, :2 * h].T
                np.add.at(dpx[k], ids[:m, t], np.concatenate([dzr, dc], axis=1))
        grad["b"] = dpx.sum(1)[:, None]
        grad["W"] = np.stack([words_x.T @ dpx[k] for k in (0, 1)])
        return grad, sum(dpx[k] @ self.p["W"][k].T for k in (0, 1))


def windows_of(word_ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, n, text) of all windows of texts given as arrays of word rows, longest windows first."""
    at = [(i, s, min(WINDOW, len(w) - s)) for i, w in enumerate(word_ids) for s in window_starts(len(w))]
    text, start, n = np.array(at, np.int64).reshape(-1, 3).T
    base = np.r_[0, np.cumsum([len(w) for w in word_ids])[:-1]].astype(np.int64) if len(word_ids) else np.zeros(0, np.int64)
    flat = np.concatenate([*word_ids, np.zeros(WINDOW, np.int64)])
    order = np.argsort(-n, kind="stable")
    text, start, n = text[order], start[order], n[order]
    ids = flat[np.minimum((base[text] + start)[:, None] + np.arange(WINDOW), len(flat) - 1)]
    return ids, n, text


def best(net: Network, px: np.ndarray, word_ids: list[np.ndarray], block: int = 4096) -> tuple[np.ndarray, tuple]:
    """The highest logit of each text, and all windows with their logits."""
    ids, n, text = windows_of(word_ids)
    logit = np.concatenate([net.forward(px, ids[i:i + block], n[i:i + block]) for i in range(0, len(n), block)]) if len(n) else np.zeros(0)
    top = np.full(len(word_ids), -np.inf, np.float32)
    np.maximum.at(top, text, logit)
    return top, (ids, n, text, logit)


def train(texts: list[str], labels: list[int], vocabulary: int = 20000, steps: int = 480, batch: int = 48, rate: float = 0.01,
          sure: float = 2.5, least: int = 250, seed: int = 0) -> Network:
    """Adam on the mean logistic loss of each text's highest window; classes weigh the same.

    The vocabulary holds words of at least 3 texts whose log odds of being in a text of label 1 (smoothed) are at least
    `sure` standard errors from 0, so that a small sample isn't learnt by heart. Word vectors start at zero but for their
    first entry, those log odds, which spares early steps. Few texts get few steps: 12 rounds over the smaller class."""
    docs = [[normal(w) for w in t.split()] for t in texts]
    y = np.array(labels)
    seen = [Counter(w for d, v in zip(docs, y) if v == k for w in set(d)) for k in (0, 1)]
    size = [max(1, int((y == k).sum())) for k in (0, 1)]
    odds = {w: np.log((seen[1][w] + 0.5) / (size[1] + 1)) - np.log((seen[0][w] + 0.5) / (size[0] + 1))
            for w in {*seen[0], *seen[1]} if seen[0][w] + seen[1][w] >= 3}
    error = lambda w: sum(1 / (seen[k][w] + 0.5) for k in (0, 1)) ** 0.5
    words = sorted((w for w in odds if abs(odds[w]) >= sure * error(w)), key=lambda w: (-abs(odds[w]), w))[:vocabulary]
    steps = min(steps, max(least, 12 * 2 * min(size) // batch))
    net = Network({w: i + 1 for i, w in enumerate(words)}, seed)
    net.grams = lru_cache(maxsize=200_000)(grams)
    net.p["E"][1:, 0] = np.clip([odds[w] for w in words], -2, 4)
    rnd = np.random.default_rng(seed)
    m, s2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    by = [np.flatnonzero(y == k) for k in (0, 1)]
    queue = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for step in range(1, steps + 1):
        pick = []
        for k in (0, 1):
            if len(queue[k]) < batch // 2:
                queue[k] = np.concatenate([queue[k], *(rnd.permutation(by[k]) for _ in range(1 + batch // 2 // len(by[k])))])
            pick.append(queue[k][:batch // 2])
            queue[k] = queue[k][batch // 2:]
        pick = np.concatenate(pick)
        index: dict[str, int] = {}
        word_ids = [np.array([index.setdefault(w, len(index)) for w in docs[i]], np.int64) for i in pick]
        own = list(index) or [""]
        known = np.array([net.vocab.get(w, 0) for w in own])
        if step % 4 == 0:
            known[:] = 0
        x = net.inputs(own, known)
        px = net.project(x)
        top, (ids, n, text, logit) = best(net, px, word_ids)
        chosen = np.sort(np.unique(np.where(logit == top[text], text, -1), return_index=True)[1][-len(pick):])
        ids, n, text = ids[chosen], n[chosen], text[chosen]
        logit, kept = net.forward(px, ids, n, keep=True)
        prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        grad, dx = net.gradients(px, x, ids, n, ((prob - y[pick][text]) / len(pick)).astype(np.float32), kept)
        grad["E"] = np.zeros_like(net.p["E"])
        np.add.at(grad["E"], known, dx[:, :WORD_DIM])
        grad["E"][0] = 0
        g = [net.grams(w) for w in own]
        count = np.fromiter(map(len, g), np.int64, len(g))
        grad["C"] = np.zeros_like(net.p["C"])
        np.add.at(grad["C"], np.fromiter((i for v in g for i in v), np.int64, count.sum()),
                  np.repeat(dx[:, WORD_DIM:] / np.maximum(count, 1)[:, None], count, axis=0))
        for k in net.p:
            m[k] += 0.1 * (grad[k] - m[k])
            s2[k] += 0.01 * (grad[k] ** 2 - s2[k])
            net.p[k] -= (rate * (1 - step / (steps + 1)) ** 0.5 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            if k in ("E", "C"):
                net.p[k] *= 1 - 1e-4
    net.grams = grams
    return net


class Scorer:
    """Scores texts in a task; keeps the projected inputs of `most` distinct words, or of one call's words if they are more."""

    def __init__(self, net: Network, most: int = 200_000):
        self.net, self.most = net, most
        self.rows: dict[str, int] = {}
        self.px = np.zeros((2, most, 3 * HIDDEN), np.float32)

    def __call__(self, texts: list[str]) -> np.ndarray:
        split = [t.split() for t in texts]
        fresh = set()
        for w in split:
            fresh.update(w)
        if len(self.rows) + len(fresh) > self.most:
            self.rows.clear()
        fresh = [w for w in fresh if w not in self.rows]
        if fresh:
            first = len(self.rows)
            if first + len(fresh) > self.px.shape[1]:  # rows is empty then
                self.px = np.zeros((2, len(fresh), 3 * HIDDEN), np.float32)
            for i in range(0, len(fresh), 20000):
                some = fresh[i:i + 20000]
                self.px[:, first + i:first + i + len(some)] = self.net.project(self.net.inputs([normal(w) for w in some]))
            self.rows.update(zip(fresh, range(first, first + len(fresh))))
        get = self.rows.__getitem__
        top, _ = best(self.net, self.px, [np.fromiter(map(get, w), np.int64, len(w)) for w in split])
        return 1 / (1 + np.exp(-np.clip(top.astype(np.float64), -30, 30)))


#: Rows that training must not see.
HELD_OUT = "crc32(cast({id} as string)) % 5 = 0"


def tuned(texts: list[str], labels: list[int], odds: float, seed: int = 0, every: int = 6) -> Network:
    """A network for texts among which label 1 has log odds `odds`; see the module on the part that it isn't fitted on."""
    order = sorted(range(len(texts)), key=lambda i: xxhash.xxh64_intdigest(texts[i].encode("utf-8", "surrogatepass"), 5))
    y, aside = np.array(labels), np.zeros(len(texts), bool)
    for k in (0, 1):
        own = [i for i in order if labels[i] == k]
        if (y == 1).sum() >= 60:
            aside[own[::every]] = True
    net = train([t for t, v in zip(texts, aside) if not v], y[~aside].tolist(), seed=seed)
    share = 0.5
    if aside.any():
        p = Scorer(net)([t for t, v in zip(texts, aside) if v])
        logit, own = np.log(p / (1 - p)), y[aside]
        weight = np.where(own == 1, np.exp(odds) / (own == 1).sum(), 1 / (own == 0).sum())  # labels as often as they are

        def f1(share: float) -> float:
            said = logit + share * odds >= 0
            hit = weight[said & (own == 1)].sum()
            return 2 * hit / max(1e-12, weight[said].sum() + weight[own == 1].sum())

        share = max((0.5, 0.25, 0.75, 0.0, 1.0), key=f1)
    net.p["c"] += np.float32(share * odds)
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = 2000,
        held_out: str = HELD_OUT, seed: int = 0) -> Network | None:
    sample = labelled_sample(docs, labels, "toxic", held_out, per_class, id_col, text_col)
    n = {r["y"]: r["count"] for r in labelled(labels, "toxic", held_out, id_col).groupBy("y").count().collect()}
    odds = float(np.log(n.get(1, 1) / n.get(0, 1)))
    return fitted(sample, lambda texts, y: tuned(texts, y, odds, seed))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = 2000,
             held_out: str = HELD_OUT, seed: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per input row."""
    net = fit(docs, labels, id_col, text_col, per_class, held_out, seed)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value) if shared.value else lambda texts: np.zeros(len(texts))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            out = [score(texts[i:i + 500]) for i in range(0, len(texts), 500)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([np.zeros(0), *out]))], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double")
    return scored.select("doc_id", F.expr(held_out.format(id="doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns; texts stay in their tasks."""
    net = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value) if shared.value else lambda texts: np.zeros(len(texts))
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield part.filter(pa.array(score([t or "" for t in part.column(at).to_pylist()]) < threshold))

    return docs.mapInArrow(run, docs.schema)
