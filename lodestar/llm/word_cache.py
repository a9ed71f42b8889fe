"""Encoding by the tokenizers library with a cache of words.

Where no token covers a non-blank character and the space after it, and nothing before such a place looks past it, a text
may be split before each space: its ids are the ids of its parts. Parts not seen before are joined, encoded in one call
and told apart by the widths of their tokens. For byte-level tokenizers a part is split further, before a line end and
before the marks that end a word, so that fewer distinct parts are left to encode. Texts in which white space runs make
the split unsafe, or which hold special tokens, are encoded whole."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space but the space and the line end.
_BLANK = "[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BLANKS, _BEFORE_SPACE = re.compile(_BLANK + "[ \n]"), re.compile(r"\s ")
#: Marks that a byte-level tokenizer keeps apart from the letters or digits before them.
_TAIL = ".,;:!?$#&*%)"


class WordCache:
    """Texts to arrays of unsigned 16-bit ids. tokenizer: of the tokenizers library; width: bytes of text for each id;
    space: bytes of a space; unsafe(text): it must be encoded whole (for byte_level, runs of white space
    are seen to); byte_level: a text's first part has no space before
    it, and parts may be split at line ends and before final marks. About `most` parts are kept, those used last; learnt(words,
    ids) is told each part that is encoded."""

    def __init__(self, tokenizer, width: np.ndarray, space: int, unsafe, byte_level: bool, most: int = 1_000_000, learnt=None):
        self.tokenizer, self.width, self.space, self.unsafe, self.byte_level, self.most, self.learnt = tokenizer, width, space, unsafe, byte_level, most, learnt
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the generation before
        self.marks: dict[str, bytes] = {}
        self.lead = " " if byte_level else ""

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        """Puts the ids of parts into the cache."""
        if not self.byte_level:
            self._encode([p for p in parts if p and not p[-1].isspace()], " ")
            self._alone([p for p in parts if not p or p[-1].isspace()])
            return
        words, lines, alone, marked = [], [], [], []
        for p in parts:
            last = p[-1:]
            if last.isalnum() or not (last in _TAIL or last.isspace()):
                (lines if p[0] == "\n" else words).append(p)
            elif last and last in _TAIL and (stem := p.rstrip(_TAIL))[-1:].isalnum():
                marked.append((p, stem, p[len(stem):]))
            elif last and not last.isspace():
                (lines if p[0] == "\n" else words).append(p)
            else:
                alone.append(p)
        known = {*words, *lines}
        for stem in {m[1] for m in marked if m[1] not in self.cache}.difference(known):
            (lines if stem[0] == "\n" else words).append(stem)
        self._encode(words, " ")
        self._encode(lines, "\n")
        self._alone(alone)
        new = list({m[2] for m in marked}.difference(self.marks))
        self.marks.update(zip(new, (x.tobytes() for x in self.whole(new))))
        self.cache.update([(p, self.cache[stem] + self.marks[tail]) for p, stem, tail in marked])

    def _encode(self, parts: list[str], begin: str) -> None:
        """Parts that each have `begin` before or at their start, and nowhere else, encoded many at once."""
        groups = [parts[at:at + 2048] for at in range(0, len(parts), 2048)]
        joined = [" " + " ".join(g) if begin == " " else "".join(g) for g in groups]
        given = joined if self.byte_level else [t[1:] for t in joined]
        for some, text, ids in zip(groups, joined, self.whole(given)):
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            ends = np.append(np.flatnonzero(raw == ord(begin))[1:], len(raw))
            if begin == " ":
                ends += np.arange(1, len(ends) + 1) * (self.space - 1)
            places = np.cumsum(self.width[ids])
            cuts = np.searchsorted(places, ends)
            if len(places) and len(ends) == len(some) and places[-1] == ends[-1] and (places[cuts] == ends).all():
                held, stops = ids.tobytes(), (2 * cuts + 2).tolist()
                found = [held[a:b] for a, b in zip([0, *stops], stops)]
                self.cache.update(zip(some, found))
                if self.learnt:
                    self.learnt(some, found)
            else:
                self._alone(some)

    def _alone(self, parts: list[str]) -> None:
        found = [x.tobytes() for x in self.whole([p if p[:1] == "\n" else self.lead + p for p in parts])]
        self.cache.update(zip(parts, found))
        if self.learnt:
            self.learnt(parts, found)

    def _split(self, text: str) -> str | None:
        """The text with a space before each part; None: it must be encoded whole."""
        if not text or self.unsafe(text):
            return None
        if not self.byte_level:
            return text
        if "  " in text or "\n " in text or " \n" in text:
            return None
        if _BLANKS.search(text):  # other white space before a space or a line end
            return None if _BEFORE_SPACE.search(text) else text
        return text if "\n\n" in text else text.replace("\n", " \n")

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        """Of distinct parts, learnt where they are new."""
        if 2 * len(self.cache) > self.most:
            self.old, self.cache = self.cache, {}
        cache, old = self.cache, self.old
        new = [p for p in parts if p not in cache]
        if old and new:
            cache.update([(p, old[p]) for p in new if p in old])
            new = [p for p in new if p not in cache]
        self._learn(new)
        return list(map(cache.__getitem__, parts))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        ready = {i: s for i, t in enumerate(texts) if (s := self._split(t)) is not None}
        rest = [i for i in range(len(texts)) if i not in ready]
        if ready:
            lists = pc.split_pattern(pa.array(ready.values(), pa.large_string()), " ")
            begin = lists.offsets.to_numpy()
            coded = lists.values.slice(begin[0], begin[-1] - begin[0]).dictionary_encode()
            distinct = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string()))
            parts = pc.binary_join(distinct, " ")[0].as_py().split(" ")  # no part holds a space
            word, begin = coded.indices.to_numpy(), begin - begin[0]
            ids = self._ids_of(parts)
            if self.byte_level:  # a text's first part has no space before it
                word = word.copy()
                heads = [parts[k] for k in word[begin[:-1]].tolist()]
                word[begin[:-1]] = np.arange(len(parts), len(parts) + len(heads))
                ids += [x.tobytes() for x in self.whole(heads)]
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
            flat, at = np.frombuffer(b"".join(ids), np.uint16), np.cumsum(size) - size
            n = size[word]
            ends = np.cumsum(n)
            stop = np.r_[0, ends][begin[1:]]
            every = flat[np.repeat(at[word] - (ends - n), n) + np.arange(n.sum())]
            for i, x in zip(ready, np.split(every, stop[:-1])):
                out[i] = x
        for i, ids in zip(rest, self.whole([texts[i] for i in rest])):
            out[i] = ids
        return out


class SpacedWords(WordCache):
    """For a tokenizer that drops white space, lower-cases and never joins letters or digits with marks: the ids of a text are
    those of its words, and a word that ends in marks is its stem and them. New words are encoded together, kept apart by
    one of the tokenizer's own special tokens; texts that hold it are encoded whole."""

    def __init__(self, tokenizer, between: str, unsafe, most: int = 1_000_000):
        super().__init__(tokenizer, np.zeros(0), 0, unsafe, False, most)
        self.between, self.cut = between, tokenizer.token_to_id(between)

    def _split(self, text: str) -> str | None:
        return None if not text or self.unsafe(text) else text.replace("\n", " ")

    def _learn(self, parts: list[str]) -> None:
        marked = [(p, stem, p[len(stem):]) for p in parts if p[-1:] in _TAIL and (stem := p.rstrip(_TAIL))[-1:].lower()[-1:].isalnum()]
        tails, split = {m[2] for m in marked}.difference(self.marks), {m[0] for m in marked}
        self.marks.update(self._apart(list(tails)))
        alone = {p for p in parts if p not in split} | {m[1] for m in marked if m[1] not in self.cache}
        self.cache.update(self._apart(list(alone)))
        self.cache.update([(p, self.cache[stem] + self.marks[tail]) for p, stem, tail in marked])

    def _apart(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        groups = [parts[at:at + 512] for at in range(0, len(parts), 512)]
        for some, ids in zip(groups, self.whole([self.between.join(g) for g in groups])):
            held, ends = ids.tobytes(), [*(2 * np.flatnonzero(ids == self.cut)).tolist(), 2 * len(ids)]
            yield from zip(some, (held[a:b] for a, b in zip([0, *(x + 2 for x in ends)], ends)), strict=True)


def blocks_of(texts: list[str], chars: int = 4_000_000) -> Iterator[list[str]]:
    """The texts in blocks of about so many characters, in which distinct words are counted once."""
    block, held = [], 0
    for t in texts:
        if block and held + len(t) > chars:
            yield block
            block, held = [], 0
        block.append(t)
        held += len(t)
    if block:
        yield block


def threads_each(cpus: int = 1) -> None:
    """As many threads as a task has cores (spark.task.cpus); the tokenizers library would take all of the machine's."""
    os.environ["RAYON_NUM_THREADS"] = str(cpus)
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if cpus > 1 else "false"


@lru_cache(maxsize=4)
def encoder(path: str) -> WordCache:
    """For a byte-level BPE file of the tokenizers library. Special tokens in a text are taken for what they are."""
    threads_each()
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    vocab = tk.get_vocab(with_added_tokens=True)
    if max(vocab.values()) > 65535:
        raise ValueError("ids of 16 bits only")
    width = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        width[i] = len(token)  # a byte of text is one character of a byte-level token
    special = [t.content for t in tk.get_added_tokens_decoder().values()]
    return WordCache(tk, width, 1, lambda text: any(t in text for t in special), True)


@lru_cache(maxsize=4)
def spaced_encoder(path: str) -> SpacedWords:
    """For a BPE file of the tokenizers library that drops white space. Special tokens in a text are taken for what they are."""
    threads_each()
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    if max(tk.get_vocab(with_added_tokens=True).values()) > 65535:
        raise ValueError("ids of 16 bits only")
    special = [t.content for t in tk.get_added_tokens_decoder().values()]
    return SpacedWords(tk, special[0], lambda text: any(t in text for t in special))
