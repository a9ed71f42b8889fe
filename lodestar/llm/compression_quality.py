"""Text quality by compression: zstandard dictionaries of good and of bad labelled texts.

A text is compressed with either dictionary, in pieces of 1024 bytes, so that a piece leans on the dictionary and not on
the text before it. The difference of the two sizes, by the text's length and by the smaller compressed size, goes through
a logistic function to a score from 0 to 1. The dictionaries are built from a bounded sample of labelled rows (`per_class`
ids of each label, the smallest by a hash of the id; `trained` bytes of pieces of their texts, evenly spaced). The logistic
function is fitted to sizes that dictionaries don't flatter: either half of the sample is measured by dictionaries of the
other. The model has a fixed size and is broadcast; every row is scored where it is read.

Defined results: a null or empty text has no difference and scores the fitted intercept; without labels of both kinds
(or too few for a dictionary) every score is 0.5; repeated rows are scored each; very long texts are compressed whole, piece
by piece; sizes that tie have no difference; an id that is no number is null; an empty table gives no rows; other columns
are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fitted, labelled_sample

#: Rows that fitting must not see.
HELD_OUT = "crc32(cast({id} as string)) % 3 = 1"


PIECE = 1024


class Model:
    """Two dictionaries (bytes) and the weights of the logistic function."""

    def __init__(self, good: bytes, bad: bytes, level: int = 3):
        self.good, self.bad, self.level = good, bad, level
        self.weights = np.zeros(3)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """(texts, 3): 1, the difference of compressed sizes by length and by the smaller compressed size (scaled)."""
        sizes = []
        for d in (self.good, self.bad):
            held = zstandard.ZstdCompressionDict(d)
            held.precompute_compress(level=self.level)
            c = zstandard.ZstdCompressor(level=self.level, write_content_size=False, dict_data=held, write_dict_id=False)
            sizes.append(np.array([sum(len(c.compress(t[i:i + PIECE])) for i in range(0, len(t), PIECE)) for t in texts], float))
        good, bad = sizes
        n = np.fromiter(map(len, texts), float, len(texts))
        return np.stack([np.ones(len(texts)), 100 * (bad - good) / np.maximum(n, 1), 10 * (bad - good) / np.maximum(np.minimum(good, bad), 1)], axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, held back by a small ridge (not on the first column)."""
    w = np.zeros(x.shape[1])
    hold = np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - hold * w)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return w


def pieces(texts: list[bytes], most: int, size: int = 2000) -> list[bytes]:
    """Pieces of the texts, evenly spaced if all of them were more than `most` bytes."""
    every = [t[i:i + size] for t in texts for i in range(0, len(t), size)]
    step = max(1.0, sum(map(len, every)) / most)
    return [every[int(i * step)] for i in range(int(len(every) / step))]


def dictionaries(texts: list[bytes], y: np.ndarray, dictionary: int, trained: int) -> Model | None:
    """Of the good and of the bad texts; None if there is too little text."""
    made = []
    for k in (1, 0):
        some = pieces([t for t, v in zip(texts, y) if v == k and t], trained)
        size = min(dictionary, sum(map(len, some)) // 8)
        while size >= 512:
            try:
                made.append(zstandard.train_dictionary(size, some).as_bytes())
                break
            except zstandard.ZstdError:  # the texts don't fill a dictionary of this size
                size //= 2
        else:
            return None
    return Model(*made)


def fit(texts: list[str], labels: list[int], dictionary: int = 300_000, trained: int = 8_000_000) -> Model | None:
    """Dictionaries of all texts; weights from two halves, each measured by the dictionaries of the other."""
    raw, y = [t.encode("utf-8", "surrogatepass") for t in texts], np.array(labels)
    half = np.zeros(len(y), int)
    for k in (0, 1):
        half[y == k] = np.arange((y == k).sum()) % 2
    x = np.zeros((len(y), 3))
    for h in (0, 1):
        part = dictionaries([t for t, v in zip(raw, half) if v != h], y[half != h], dictionary, trained)
        if part is None:
            return None
        x[half == h] = part.features([t for t, v in zip(raw, half) if v == h])
    model = dictionaries(raw, y, dictionary, trained)
    if model is not None:
        model.weights = logistic(x, y)
    return model


def compression_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
                        per_class: int = 3000, held_out: str = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per input row; score: how likely label 1 is."""
    model = fitted(labelled_sample(docs, labels, label, held_out, per_class, id_col, text_col), fit)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            score = m.scores(texts) if m is not None else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, score double")
    return scored.select("doc_id", F.expr(held_out.format(id="doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
