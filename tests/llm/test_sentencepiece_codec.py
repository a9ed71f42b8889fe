import struct
import zlib

import numpy as np
import pytest

from lodestar.llm import queries
from lodestar.llm import sentencepiece_codec as S

PATH = queries.vocabulary("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b", "Hello world", "Größe: 12,5 €\nnächste Zeile\t!", "日本語 テキスト 🙂", "▁x y▁", "   lead and   runs  ",
         "x" * 300, "\x00\x01 ctl", "café café", "ﬁ ½ ①", "<s> </s> <unk> <0x0A>", "word " * 500 + "end", " nbsp x", "a\r\nb"]


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3 & 255 | 0]) if number < 16 else varint(number << 3)
            out += varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def varint(x):
    out = b""
    while x > 127:
        out += bytes([x & 127 | 128])
        x >>= 7
    return out + bytes([x])


@pytest.fixture(scope="session")
def unigram(tmp_path_factory):
    """A small unigram model with byte fallback, written by hand."""
    words = ["▁", "▁the", "▁cat", "▁c", "at", "a", "t", "s", "h", "e", "c", "sat", "▁sat", "n", "o", "on", "▁on", "▁m", "m", "mat"]
    pieces = [message((1, b"<unk>"), (2, 0.0), (3, 2)), message((1, b"<s>"), (2, 0.0), (3, 3)), message((1, b"</s>"), (2, 0.0), (3, 3))]
    pieces += [message((1, f"<0x{b:02X}>".encode()), (2, 0.0), (3, 6)) for b in range(256)]
    pieces += [message((1, w.encode()), (2, -1.0 - 0.37 * i)) for i, w in enumerate(words)]
    raw = b"".join(message((1, p)) for p in pieces)
    raw += message((2, message((3, 1), (35, 1), (40, 0), (41, 1), (42, 2))), (3, message((1, b"identity"), (2, b""), (3, 1), (4, 1), (5, 1))))
    path = tmp_path_factory.mktemp("sp") / "unigram.model"
    path.write_bytes(raw)
    return str(path)


def test_parity_with_sentencepiece():
    c = S.codec(PATH)
    for _ in range(2):  # the second time from the cache
        assert [x.tolist() for x in c.encode(TEXTS)] == c.processor.encode(TEXTS)
    for t, ids in zip(TEXTS, c.encode(TEXTS)):
        assert c.decode(ids) == c.processor.decode(ids.tolist()), t
        assert c.decode(ids) == t or "▁" in t or "<" in t, t
    plain = [t for t in TEXTS if t and not c.runs.search(t)]
    assert [e.ids for e in c.tokenizer.encode_batch(plain, add_special_tokens=False)] == c.processor.encode(plain)
    assert c.tokenizer.decode(c.processor.encode("Größe 12\n日本"), skip_special_tokens=False) == "Größe 12\n日本"


def test_unigram(unigram):
    c = S.codec(unigram)
    assert c.model.kind == S.UNIGRAM and c.model.byte_fallback and c.model.remove_extra
    texts = ["the cat sat on the mat", "  the   cats ", "catsé on", "", "mat", "zq the"]
    assert [x.tolist() for x in c.encode(texts)] == c.processor.encode(texts)
    assert c.decode(c.encode(["the cat"])[0]) == "the cat"


def test_difference_fails_loudly():
    c = S.Codec(PATH)
    right = c.cached.tokenizer
    c.encode(["Hello"])

    class Wrong:
        def encode_batch_fast(self, texts, add_special_tokens):
            return right.encode_batch_fast([t.replace("e", "a") for t in texts], add_special_tokens=add_special_tokens)

    c.cached.tokenizer = Wrong()
    with pytest.raises(ValueError):
        c.encode(["later words come here"])


def test_two_threads():
    assert [x.tolist() for x in S.Codec(PATH, 2).encode(TEXTS)] == S.codec(PATH).processor.encode(TEXTS)


def test_tables(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate([None, *TEXTS])] * 2, "doc_id long, text string, ids string, n_tokens int")
    c = S.codec(PATH)
    want = dict(enumerate([[], *c.processor.encode(TEXTS)]))
    assert {r.doc_id: r.ids for r in S.encoded(docs, PATH).collect()} == want
    for r in S.measured(docs, PATH).collect():
        assert r.own == S.codec(PATH).own([None, *TEXTS][r.doc_id] or "")
        assert r.n_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id], "<u4").tobytes())
    assert S.measured(docs.limit(0), PATH).count() == 0
