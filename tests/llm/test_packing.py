import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestar.llm import packing, queries
from lodestar.llm.word_cache import encoder

PATH = queries.vocabulary("byte_bpe_50k.json")


def plain(texts):
    tk = Tokenizer.from_file(PATH)
    return [e.ids for e in tk.encode_batch(texts, add_special_tokens=False)]


def test_encoder_parity():
    texts = ["", " ", "  ", "a  b", "a\n b", " a b ", "x \ny", "tab\t z", "<|endoftext|> hi <|endoftext|>", "é  ü  k", "a b c", "x<|endoftext|>y", "a.\nIs\n\nb. c\nd",
             "\nq\nr.", "x.\r\ny z", "a'.\nb", "it's. don't, 's.\n's", "q)\n),x\n", "x²., ½, Ⅷ.", "a\n.", "\n", "\n\n", "a$$$ b$ $",
             "don't we'll 'S", "1 23 4.5", "\x1c a", "a \x1cb", "🙂 🙂🙂", "word " * 3000, "a　b c", "end\n", "end \n", "q\r\n w"]
    assert [x.tolist() for x in encoder(PATH)(texts)] == plain(texts)
    assert [x.tolist() for x in encoder(PATH)(texts)] == plain(texts)
    assert plain(["<|endoftext|> hi"])[0][0] == 50256


def test_cache_forgets_and_relearns():
    few = encoder.__wrapped__(PATH)
    few.most = 100
    texts = [" ".join(f"word{i % 37}x{k}, and" for i in range(60)) for k in range(12)]
    for _ in range(2):
        for t in texts:
            assert few([t])[0].tolist() == plain([t])[0]
    assert len(few.cache) + len(few.old) < 500


def check(rows, texts, window):
    ids = {i: x + [1] for i, x in enumerate(plain([t or "" for t in texts]))}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for d, p in by_doc.items():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
        assert at == len(ids[d])
    padding = 0
    for p in by_seq.values():
        at = 0
        for off, n in sorted(p):
            assert off == at
            at += n
        assert at <= window
        if at & (at - 1):
            padding += window - at
    return padding


@pytest.mark.parametrize("window", [16, 2048])
def test_pieces(spark, window):
    texts = ["word " * n for n in range(0, 300, 7)] + ["alpha beta. Gamma\n" * 40] * 30 + [None, "", "x", "<|endoftext|> hi"] + ["long text, " * 4000]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, length int, rank int").repartition(3)
    assert check(packing.pack(docs, PATH, window).collect(), texts, window) == 0


def test_no_broadcast_and_empty(spark):
    texts = ["word " * n for n in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert check(packing.pack(docs, PATH, 64, broadcast_rows=0).collect(), texts, 64) == 0
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_solution_uses_combinations():
    hist = {1000: 50, 1048: 60, 512: 40, 7: 3}
    used = defaultdict(int)
    for a, k, b, times in packing.solve(hist, 2048):
        assert k * a + b == 2048
        used[a] += k * times
        if b:
            used[b] += times
    assert all(used[n] <= hist[n] for n in used) and used[1000] == 50 and used[512] == 40
