import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestar.llm import best_fit as bf
from lodestar.llm import queries
from lodestar.llm.word_cache import spaced_encoder

PATH = queries.vocabulary("word_bpe_49k.json")


def plain(texts):
    tk = Tokenizer.from_file(PATH)
    return [e.ids for e in tk.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, ids, window):
    """rows against ids, tuple (doc_id, ids) of each document; the number of sequences."""
    want = sorted((d, k, s, min(window, len(x) - s), zlib.crc32(np.array(x[s:s + window], "<u4").tobytes()))
                  for d, x in ids for k, s in enumerate(range(0, len(x), window)))
    assert sorted(tuple(r)[:5] for r in rows) == want
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for p in by_seq.values():
        at = 0
        for off, n in sorted(p):
            assert off == at
            at += n
        assert at <= window
    return len(by_seq)


def fewest(ids, window):
    """By best fit of all rests at once, without rounds."""
    rests = sorted((len(x) % window for _, x in ids if len(x) % window), reverse=True)
    gaps = []
    for n in rests:
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(window - n)
    return len(gaps) + sum(len(x) // window for _, x in ids)


def test_encoder_parity():
    rnd = random.Random(1)
    some = ["a", "B", "c.", "'s", " ", "  ", "\n", "é", "é", "́", "İ", "İ.", "Σ", "漢", "1", "½", "　", "\x1c", "🙂", "don't", "<|endoftext|>", "<|startoftext|>", "=", "̸", "#", "ﬁ"]
    texts = ["", " ", "x" * 5000, *("".join(rnd.choices(some, k=rnd.randint(0, 20))) for _ in range(4000))]
    assert [x.tolist() for x in spaced_encoder(PATH)(texts)] == plain(texts)
    few = spaced_encoder.__wrapped__(PATH)
    few.most = 50
    assert [x.tolist() for x in few(texts)] == [x.tolist() for x in few(texts)] == plain(texts)


def test_best_fit_takes_the_fullest_bin_that_can_take_it():
    bins, offsets, fill = bf.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8] and fill.tolist() == [10, 10]
    rnd = np.random.default_rng(2)
    lengths = np.sort(rnd.integers(1, 100, 500))[::-1]
    bins, offsets, fill = bf.best_fit(lengths, 100)
    assert fill.max() <= 100 and np.array_equal(np.bincount(bins, lengths), fill) and len(fill) == fewest([(0, [0] * n) for n in lengths], 100)


@pytest.mark.parametrize("window, items, fan", [(16, 20, 2), (64, 40, 8), (2048, 1 << 15, 8)])
def test_pieces(spark, window, items, fan):
    rnd = random.Random(window)
    texts = ["word " * rnd.randint(0, 90) for _ in range(400)] + ["alpha, beta. Gamma\n" * 30] * 60 + [None, "", "x", "<|endoftext|> hi"] + ["long text, " * 4000]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(3, "repeated", 1, 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, item int").repartition(7)
    ids = [(r[0], x + [0]) for r, x in zip(rows, plain([r[1] for r in rows]))]
    got = bf.pack(docs, PATH, window, items=items, fan=fan).collect()
    assert check(got, ids, window) <= 1.02 * fewest(ids, window) + 1


def test_rounds_merge_what_tasks_left(spark):
    docs = spark.createDataFrame([(i, "a " * 9) for i in range(64)], "doc_id long, text string").repartition(8)  # 10 ids each
    assert check(bf.pack(docs, PATH, 80, items=8, fan=2).collect(), [(i, x + [0]) for i, x in enumerate(plain(["a " * 9] * 64))], 80) == 8
    lone = spark.createDataFrame([(i, "a " * 9) for i in range(8)], "doc_id long, text string").repartition(8)
    assert check(bf.pack(lone, PATH, 80, items=1, fan=2).collect(), [(i, x + [0]) for i, x in enumerate(plain(["a " * 9] * 8))], 80) <= 8


def test_ids_of_pieces_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "some words"), ("7", "b " * 100)], "doc_id string, text string")
    got = bf.pack(docs, PATH, 64, ids=True).collect()
    assert sorted((str(r.doc_id), r.piece, r.ids) for r in got) == sorted(
        (d, k, x[s:s + 64]) for d, x in (("None", plain(["some words"])[0] + [0]), ("7", plain(["b " * 100])[0] + [0])) for k, s in enumerate(range(0, len(x), 64)))
    assert bf.pack(docs.limit(0), PATH).count() == 0
