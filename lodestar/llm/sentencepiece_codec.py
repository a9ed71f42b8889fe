"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read field by field. From it are rebuilt the normaliser (the compiled character map, the removal
of extra spaces, the dummy prefix, the metaspace marker), the model (unigram with its scores, or BPE with merges in the
order of the scores of what they make; byte fallback for both) and the decoder. Batches are encoded by the library in as
many threads as a task has cores (spark.task.cpus).

Parity with the sentencepiece library is verified throughout: of texts that are split into words, every distinct word, once
in a worker (its ids do not depend on its neighbours); of models whose texts cannot be split, every text. A difference fails loudly.
Runs of metaspace markers with equal scores, which the two libraries may merge in another order, are left to sentencepiece
itself; `own` tells the texts that the tokenizers library encoded.

Defined results: a null text is empty and has no ids; very long texts are encoded whole, never cut; ties between merges go
to the piece with the smaller id; repeated rows come out each; an empty table gives no rows; a null id stays null."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_cache import WordCache, blocks_of, threads_each

MARK = "▁"
#: Fixed values of the model format: kinds of pieces and kinds of models.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers, or the bytes of what is not an integer."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            c = raw[i]
            i += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while i < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, raw[i:i + n]
            i += n


class Model:
    """What a model file says: pieces [(text, score, kind)], kind of model, byte_fallback, unk_id and the normaliser's rules."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.suffix = UNIGRAM, False, False
        self.charsmap, self.dummy_prefix, self.remove_extra, self.escape = b"", True, True, True
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                f = dict(_fields(value))
                self.kind, self.byte_fallback, self.suffix = f.get(3, UNIGRAM), bool(f.get(35, 0)), bool(f.get(24, 0))
            elif number == 3:
                f = dict(_fields(value))
                self.charsmap = f.get(2, b"")
                self.dummy_prefix, self.remove_extra, self.escape = (bool(f.get(k, 1)) for k in (3, 4, 5))
        self.unk_id = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        if self.kind not in (UNIGRAM, BPE) or self.suffix or not self.escape:
            raise ValueError("only unigram and BPE models with a metaspace marker before words")

    def joins_words(self) -> bool:
        """A piece holds a marker after another character, so texts can't be split before markers."""
        return any(MARK in p.lstrip(MARK) for p, _, _ in self.pieces)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, in the order of the scores of what they make."""
        rank = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        out = []
        for p, (score, i) in {p: (self.pieces[i][1], i) for p, i in rank.items()}.items():
            out += [(-score, i, k, p) for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
        return [(p[:k], p[k:]) for _, _, k, p in sorted(out)]

    def tokenizer(self):
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            core = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unk_id][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unk_id, self.byte_fallback)
        tk = Tokenizer(core)
        steps = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.remove_extra:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Prepend(MARK)] * self.dummy_prefix + [normalizers.Replace(" ", MARK)]
        tk.normalizer = normalizers.Sequence(steps)
        if not self.joins_words():
            tk.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
        user = [AddedToken(p, normalized=False) for p, _, kind in self.pieces if kind == USER]
        if user:
            tk.add_tokens(user)
        tk.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + [decoders.Strip(" ", 1, 0)] * self.dummy_prefix)
        return tk


class Codec:
    """Encodes and decodes; processor is the sentencepiece library's own, for verification and for runs of markers."""

    def __init__(self, path: str, cpus: int = 1):
        threads_each(cpus)
        self.cpus = cpus
        import sentencepiece

        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokenizer = self.model.tokenizer()
        pieces = self.model.pieces
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN
                      else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        width = np.array([1 if kind == BYTE else len(p.encode()) for p, _, kind in pieces], np.int64)
        plain = self.model.dummy_prefix and not self.model.remove_extra and not self.model.charsmap and not self.model.joins_words()
        users = any(kind == USER for _, _, kind in pieces)
        runs = re.compile(f"(?:^|[ {MARK}])[ {MARK}]|^[ {MARK}]|[ {MARK}]$|{MARK}")
        self.runs = runs if self.model.kind == BPE else re.compile(r"(?!)")
        splits = plain and not users and len(pieces) <= 65536
        self.cached = WordCache(self.tokenizer, width, len(MARK.encode()), runs.search, False, learnt=self._same) if splits else None

    def own(self, text: str) -> bool:
        """The tokenizers library encodes this text."""
        return not self.runs.search(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = [i for i, t in enumerate(texts) if not self.own(t)]
        out = {i: np.array(x, np.int64) for i, x in zip(odd, self.processor.encode([texts[i] for i in odd], num_threads=self.cpus))}
        rest = [i for i in range(len(texts)) if i not in out]
        some = [texts[i] for i in rest]
        if self.cached is not None:
            done = self.cached(some)
        else:
            done = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self._same(some, [x.astype(np.uint16).tobytes() for x in done] if len(self.bytes) <= 65536 else None, done)
        out.update(zip(rest, done))
        return [out[i] for i in range(len(texts))]

    def _same(self, texts: list[str], found: list[bytes] | None, ids: list[np.ndarray] | None = None) -> None:
        """Raises ValueError where ids (as 16-bit bytes, or arrays) differ from the sentencepiece library's."""
        theirs = self.processor.encode(texts, num_threads=self.cpus)
        if found is None:
            wrong = next((t for t, a, b in zip(texts, ids, theirs) if a.tolist() != b), None)
        else:
            lens = list(map(len, theirs))
            flat = np.fromiter(chain.from_iterable(theirs), np.uint16, sum(lens)).tobytes()
            if flat == b"".join(found) and [2 * n for n in lens] == list(map(len, found)):
                return
            wrong = next((t for t, a, b in zip(texts, found, theirs) if np.frombuffer(a, np.uint16).tolist() != b), None)
        if wrong is not None:
            raise ValueError(f"ids differ from sentencepiece's for {wrong[:80]!r}")

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        if self.model.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, cpus: int = 1) -> Codec:
    return Codec(path, cpus)


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids: array<int>), a row per input row."""
    return _run(docs, model, id_col, text_col, "doc_id long, ids array<int>", lambda c, texts, ids: [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))])


def measured(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_fallback: byte pieces, ids_crc32: of the ids as little-endian unsigned 32-bit, round_trip: the
    decoded ids are the text, own: see above), a row per input row."""

    def cols(c: Codec, texts: list[str], ids: list[np.ndarray]) -> list[pa.Array]:
        is_byte = np.array([kind == BYTE for _, _, kind in c.model.pieces])
        return [pa.array(list(map(len, ids)), pa.int64()), pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([c.decode(x) == t for x, t in zip(ids, texts)]),
                pa.array(list(map(c.own, texts)))]

    return _run(docs, model, id_col, text_col, "doc_id long, n_tokens long, n_fallback long, ids_crc32 long, round_trip boolean, own boolean", cols)


def _run(docs: DataFrame, model: str, id_col: str, text_col: str, schema: str, cols) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    cpus = int(docs.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, cpus)
        for b in batches:
            at = 0
            for some in blocks_of([t or "" for t in b.column(1).to_pylist()]):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), *cols(c, some, c.encode(some))], names)
                at += len(some)

    return docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
