"""Removal of passages that an earlier document holds, by suffix arrays built in two stages.

A byte goes if it lies in a string of `size` (50) bytes that also starts in a document with a smaller id. Equal strings
must meet in one task, but sending every suffix with its 50 bytes would move the corpus fifty times over. So:

1. Texts are gathered into blocks of about 4 MB, written once into a table bucketed by block, so that what shards answer
   moves to the blocks and the texts stay where they are.
2. The anchor of a string is the smallest hash of its 16-byte pieces: equal strings have equal anchors, and neighbouring
   strings of a text mostly share theirs, so a text falls into stretches of strings with one anchor (18 on average).
   Each block sends its distinct anchors to shards, which return those that another block or another document has.
3. Blocks send the stretches with shared anchors, equal ones once, with the smallest and largest id of their documents.
   An anchor with more than `hot` stretches in all (a common line in ever other surroundings) would not fit into a task:
   its strings go one by one, each dealt by a hash of all its bytes.
4. A shard sorts the suffixes of its stretches: it directly sorts only suffixes smaller than their successors, induces the
   others by a scan of the buckets of first bytes, and compares neighbours. Suffixes with 50 bytes in common form runs in
   that order, and the smallest id of each run goes back to the blocks that asked.
5. Blocks mark what begins in a smaller document and cut it out.

Every copy of a hot passage costs its own block some work and each block one request, however many documents hold it.

Defined results: a null text is empty; a null id counts as larger than all others; rows with equal ids don't remove from
each other; very long texts are read whole, alone in their block; an empty table gives no rows; other columns, whatever
their names, are not read. A cut may split a character; `kept_text` drops such remains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bucketed, partitions, written

PIECE = 16
ANCHOR_BITS = 48  # anchors that meet by chance cost a request, not a wrong result
LAST = np.iinfo(np.int64).max
BLOCK = "block long, ids array<long>, lens array<int>, text binary"


# ---- blocks

def blocks(docs: DataFrame, id_col: str, text_col: str, extra: Column | None, most: int = 4_000_000, most_docs: int = 20_000) -> DataFrame:
    """One row for about `most` bytes of texts: block (unique), the ids, the lengths in bytes, the texts end to end,
    compressed, and what `extra` says of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        number = TaskContext.get().partitionId() << 32
        ids, texts, more, held = [], [], [], 0

        def row():
            values = pa.concat_arrays(more)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([list(map(len, texts))], pa.list_(pa.int32())),
                 pa.array([packer.compress(b"".join(texts))], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)],
                ["block", "ids", "lens", "text", "extra"])

        for b in batches:
            begin = 0
            for k, (i, t) in enumerate(zip(b.column("id").to_pylist(), b.column("text").to_pylist())):
                t = t or b""
                if texts and (held + len(t) > most or len(texts) >= most_docs):
                    more.append(b.column("extra").slice(begin, k - begin))
                    yield row()
                    number, ids, texts, more, held, begin = number + 1, [], [], [], 0, k
                ids.append(i)
                texts.append(t)
                held += len(t)
            more.append(b.column("extra").slice(begin))
        if texts:
            yield row()

    given = docs.select(F.coalesce(F.col(id_col).try_cast("long"), F.lit(int(LAST))).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"),
                        (F.lit(False) if extra is None else extra).alias("extra"))
    kind = T._parse_datatype_string(BLOCK).add("extra", T.ArrayType(given.schema["extra"].dataType))
    return given.mapInArrow(run, kind)


# ---- anchors

def _packed(numbers: np.ndarray) -> bytes:
    """Integers, best in rising order: the bytes of their differences, those of equal weight together, compressed."""
    steps = np.diff(numbers.astype(np.int64), prepend=np.int64(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def _words(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a little-endian number (a view; len(buf) - 7 places)."""
    return np.ndarray((max(0, len(buf) - 7),), "<u8", buf.data, strides=(1,)) if len(buf) > 7 else np.zeros(0, np.uint64)


def stretches(text: np.ndarray, lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, strings, document): stretches of strings of `size` bytes with one anchor; no string spans documents."""
    w = size - PIECE + 1
    n = len(text) - size + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty.astype(np.uint64), empty, empty, empty
    v = _words(text)
    h = v[:len(v) - 8] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += v[8:]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h >>= np.uint64(64 - ANCHOR_BITS)
    low, span = h, 1
    while 2 * span <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[:len(low) - (w - span)], low[w - span:])
    low = low[:n]
    ends = np.cumsum(lens)
    first = np.zeros(n, bool)
    begins = (ends - lens)[(lens >= size)]
    good = np.zeros(len(text) + 1, np.int8)
    np.add.at(good, begins, 1)
    np.add.at(good, (ends - size + 1)[lens >= size], -1)
    good = np.cumsum(good, dtype=np.int8)[:n].astype(bool)
    first[0] = True
    first[1:] = low[1:] != low[:-1]
    first[begins] = True
    first[1:] |= good[1:] & ~good[:-1]
    first &= good
    start = np.flatnonzero(first)
    if not len(start):
        return empty.astype(np.uint64), empty, empty, empty
    stop = np.flatnonzero(good & ~np.r_[good[1:], False]) + 1  # ends of the good ranges
    nxt = np.r_[start[1:], n]
    cut = stop[np.minimum(np.searchsorted(stop, start, "right"), len(stop) - 1)]
    count = np.minimum(nxt, cut) - start
    return low[start], start, count, np.searchsorted(ends, start, "right")


def _block_arrays(b: pa.RecordBatch, i: int):
    text = np.frombuffer(zstandard.ZstdDecompressor().decompress(b.column("text")[i].as_buffer()), np.uint8)
    return text, np.array(b.column("lens")[i].values, np.int64), np.array(b.column("ids")[i].values, np.int64)


def shared_anchors(table: DataFrame, size: int, shards: int, hot: int) -> DataFrame:
    """(block, anchors: binary, hot: binary): for each block those of its anchors that two documents have, in pieces, and
    those of them with more than `hot` stretches."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, lens, ids = _block_arrays(b, i)
                anchor, _, _, doc = stretches(text, lens, size)
                order = np.argsort(anchor, kind="stable")
                anchor, who = anchor[order], ids[doc[order]]
                if not len(anchor):
                    continue
                head = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
                several = np.minimum.reduceat(who, head) != np.maximum.reduceat(who, head)
                times = np.diff(np.r_[head, len(anchor)])
                anchor = anchor[head]
                to = (anchor % np.uint64(shards)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                to, anchor, several, times = to[order], anchor[order], several[order], times[order]
                cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                parts = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(to)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[cuts], pa.int32()), pa.array(np.full(len(cuts), b.column("block")[i].as_py())),
                     pa.array([_packed(anchor[x:y]) for x, y in parts], pa.binary()), pa.array([np.packbits(several[x:y]).tobytes() for x, y in parts], pa.binary()),
                     pa.array([_packed(times[x:y]) for x, y in parts], pa.binary())],
                    ["shard", "block", "anchors", "several", "times"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_shard(batches):
            a = list(map(_unpacked, rows["anchors"]))
            many = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(x)) for s, x in zip(rows["several"], a)])
            times = np.concatenate(list(map(_unpacked, rows["times"])))
            size_of = np.fromiter(map(len, a), np.int64, len(a))
            flat, row = np.concatenate(a), np.repeat(np.arange(len(a)), size_of)
            order = np.argsort(flat, kind="stable")
            v = flat[order]
            group = np.cumsum(np.r_[True, v[1:] != v[:-1]]) - 1
            hit, much = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
            hit[order] = ((np.bincount(group) > 1) | (np.bincount(group, many[order]) > 0))[group]
            much[order] = (np.bincount(group, times[order]) > hot)[group]
            flat, row, much = flat[hit], row[hit], much[hit]
            cuts = np.searchsorted(row, np.arange(len(a) + 1)).tolist()
            keep = [i for i in range(len(a)) if cuts[i + 1] > cuts[i]]
            if keep:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows["block"][i] for i in keep], pa.int64()), pa.array([flat[cuts[i]:cuts[i + 1]].tobytes() for i in keep], pa.binary()),
                     pa.array([flat[cuts[i]:cuts[i + 1]][much[cuts[i]:cuts[i + 1]]].tobytes() for i in keep], pa.binary())], ["block", "anchors", "hot"])

    asked = table.select("block", "ids", "lens", "text").mapInArrow(ask, "shard int, block long, anchors binary, several binary, times binary")
    return asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(answer, "block long, anchors binary, hot binary")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows of one shard at a time, as lists, from a stream sorted by shard."""
    held: dict[str, list] = {}
    now = None
    for b in batches:
        shard = b.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for x, y in zip(cuts, cuts[1:]):
            if x == y:
                continue
            if held and shard[x] != now:
                yield held
                held = {}
            now = shard[x]
            for k in b.schema.names:
                held.setdefault(k, []).extend(b.column(k).slice(x, y - x).to_pylist())
    if held:
        yield held


# ---- stretches and the suffix array

def _distinct(text: bytes, start: np.ndarray, count: np.ndarray, who: np.ndarray, size: int) -> dict[bytes, list[int]]:
    """Distinct stretches: text to [first place, smallest id, largest id, its numbers in the given order ...]."""
    found: dict[bytes, list[int]] = {}
    for k, (s, e, i) in enumerate(zip(start.tolist(), (start + count + size - 1).tolist(), who.tolist())):
        x = text[s:e]
        if (f := found.get(x)) is None:
            found[x] = [s, i, i, k]
        else:
            f[1] = min(f[1], i)
            f[2] = max(f[2], i)
            f.append(k)
    return found


def _singles(text: np.ndarray, start: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each string of the given stretches: its stretch, its place and a hash of its bytes."""
    nth = np.repeat(np.arange(len(start)), count)
    place = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(len(nth))
    word = _words(text)
    h = np.zeros(len(place), np.uint64)
    for at in [*range(0, size - 8, 8), size - 8]:
        h = (h ^ word[place + at]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return nth, place, h


def requests(joined: DataFrame, size: int, shards: int) -> DataFrame:
    """From blocks with their shared anchors: a row for each block and shard, with the distinct stretches end to end,
    compressed, and their numbers of strings, places, smallest ids and how far the largest are from those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, lens, ids = _block_arrays(b, i)
                shared, hot = (np.sort(np.frombuffer(b"".join(b.column(k)[i].as_py()), np.int64)).view(np.uint64) for k in ("anchors", "hot"))
                anchor, start, count, doc = stretches(text, lens, size)
                hit = shared[np.minimum(np.searchsorted(shared, anchor), len(shared) - 1)] == anchor
                anchor, start, count, doc = anchor[hit], start[hit], count[hit], doc[hit]
                much = np.isin(anchor, hot)
                to = anchor.copy()
                if much.any():  # strings of hot anchors go one by one
                    nth, place, h = _singles(text, start[much], count[much], size)
                    doc = np.r_[doc[~much], doc[much][nth]]
                    start, count, to = np.r_[start[~much], place], np.r_[count[~much], np.ones(len(place), np.int64)], np.r_[to[~much], h]
                    order = np.argsort(start, kind="stable")
                    start, count, to, doc = start[order], count[order], to[order], doc[order]
                found = _distinct(text.tobytes(), start, count, ids[doc], size)
                strings = list(found)
                place, low, high, nth = (np.array([f[k] for f in found.values()], np.int64) for k in range(4))
                to = (to[nth] % np.uint64(shards)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.r_[True, to[order][1:] != to[order][:-1]])
                parts = [order[x:y] for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[order][cuts], pa.int32()), pa.array(np.full(len(cuts), b.column("block")[i].as_py())),
                     pa.array([zstandard.compress(b"".join([strings[k] for k in p.tolist()]), 3) for p in parts], pa.binary()),
                     *(pa.array([_packed(x[p]) for p in parts], pa.binary()) for x in (count[nth], place, low, high - low))],
                    ["shard", "block", "strings", "count", "place", "low", "high"])

    return joined.mapInArrow(run, "shard int, block long, strings binary, count binary, place binary, low binary, high binary")


def suffix_order(t: np.ndarray, start: np.ndarray, stop: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t that begin in the ranges [start, stop) of places, in the order of their first `depth` bytes at least.

    t: bytes raised by one, each string ended by 0, then at least depth + 16 zeros. Places with equal such prefixes are
    next to each other, in no particular order."""
    n = int(stop.max())
    n += int(np.argmin(t[n:]))  # the end of the last string, a 0
    step = np.sign(t[1:n + 1].astype(np.int16) - t[:n])  # of equal neighbours, the next unequal pair counts
    known = np.where(step != 0, np.arange(n), n)
    known = np.minimum.accumulate(known[::-1])[::-1]
    small = np.r_[step, 1][np.minimum(known, n)] > 0  # smaller than its successor
    # what is asked for, and up to the next suffix to sort directly
    next_small = np.where(small, np.arange(n), n)
    next_small = np.minimum.accumulate(next_small[::-1])[::-1]
    need = np.zeros(n + 2, np.int64)
    np.add.at(need, start, 1)
    np.add.at(need, np.minimum(next_small[stop - 1], n) + 1, -1)
    need = np.cumsum(need)[:n + 1] > 0
    # stage 1: sort the small ones directly, 8 bytes a round, only among ties
    word = np.ndarray((n + depth + 9,), ">u8", t.data, strides=(1,))
    s = np.flatnonzero(need[:n] & small)
    if need[n]:
        s = np.r_[s, n]
    order = np.argsort(word[s].astype(np.uint64), kind="stable")
    s = s[order]
    key = word[s].astype(np.uint64)
    head = np.r_[True, key[1:] != key[:-1]]
    for at in range(8, depth + 8, 8):
        tied = ~head
        tied[:-1] |= ~head[1:]
        live = np.flatnonzero(tied)
        if not len(live):
            break
        group = np.cumsum(head)[live]
        key = word[s[live] + at].astype(np.uint64)
        order = np.lexsort((key, group))
        s[live] = s[live][order]
        key, group = key[order], group[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
        head[live] |= new
    # stage 2: a scan over the buckets induces the others, each after its successor
    first = t[s]
    places = np.searchsorted(first, np.arange(257))
    large = need.copy()
    large[:n] &= ~small
    large[n:] = False
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        got = waiting[c]
        k = 0
        while k < len(got):  # within the bucket: one generation after another
            q = got[k] - 1
            q = q[(q >= 0)]
            q = q[large[q] & (t[q] == c)]
            if len(q):
                got.append(q)
            k += 1
        bucket = np.concatenate([*got, s[places[c]:places[c + 1]]]) if got else s[places[c]:places[c + 1]]
        if not len(bucket):
            continue
        out.append(bucket)
        q = bucket - 1
        q = q[q >= 0]
        q = q[large[q] & (t[q] > c)]
        if len(q):
            b = t[q]
            order = np.argsort(b, kind="stable")
            q, b = q[order], b[order]
            cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(q)]):
                waiting[b[x]].append(q[x:y])
    return np.concatenate(out)


def smallest_ids(strings: list[bytes], count: np.ndarray, who: np.ndarray, size: int) -> np.ndarray:
    """For the first count[k] substrings of `size` bytes of each string, the smallest id of the strings that hold it; flat."""
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    t = np.frombuffer(b"\xff".join(strings) + b"\xff" * (size + 40), np.uint8) + np.uint8(1)  # 0xff is in no text; it becomes 0
    start = np.r_[0, np.cumsum(lens + 1)[:-1]]
    sa = suffix_order(t, start, start + count, size + 6)
    begins = np.zeros(len(t) + 1, np.int32)
    np.add.at(begins, start, 1)
    np.add.at(begins, start + count, -1)
    sa = sa[np.cumsum(begins)[sa] > 0]
    # common prefixes of neighbours: do they reach `size`?
    word = np.ndarray((len(t) - 7,), "<u8", t.data, strides=(1,))
    same = np.ones(len(sa) - 1, bool)
    for at in [*range(0, size - 8, 8), size - 8]:
        live = np.flatnonzero(same)
        same[live] = word[sa[live] + at] == word[sa[live + 1] + at]
    head = np.flatnonzero(np.r_[True, ~same])
    owner = np.repeat(np.arange(len(strings)), count)
    flat_of = np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    value = np.full(len(t), LAST)
    value[flat_of] = who[owner]
    low = np.minimum.reduceat(value[sa], head)
    value[sa] = np.repeat(low, np.diff(np.r_[head, len(sa)]))
    return value[flat_of]


def marks(asked: DataFrame, size: int) -> DataFrame:
    """(block, place, count, from, to, low, each packed in a binary): of the stretch that begins at `place` of the block,
    strings from..to also start in document `low`, which is smaller than one of the block's documents with the stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_shard(batches):
            index: dict[bytes, int] = {}
            own, count, low, high, place, sizes = [], [], [], [], [], []
            for k in range(len(rows["block"])):
                c, p, a, z = (_unpacked(rows[x][k]) for x in ("count", "place", "low", "high"))
                z = a + z
                at, raw = 0, zstandard.decompress(rows["strings"][k])
                for n in (c + size - 1).tolist():
                    own.append(index.setdefault(raw[at:at + n], len(index)))
                    at += n
                for x, y in ((count, c), (place, p), (low, a), (high, z)):
                    x.append(y)
                sizes.append(len(c))
            own = np.array(own, np.int64)
            count, low, high, place = map(np.concatenate, (count, low, high, place))
            strings = list(index)
            own_count = np.zeros(len(strings), np.int64)
            own_count[own] = count
            own_low = np.full(len(strings), LAST)
            np.minimum.at(own_low, own, low)
            least = smallest_ids(strings, own_count, own_low, size)
            base = np.r_[0, np.cumsum(own_count)[:-1]]
            rec = np.repeat(np.arange(len(own)), count)
            off = np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
            value = least[base[own[rec]] + off]
            hit = value < high[rec]
            rec, off, value = rec[hit], off[hit], value[hit]
            if not len(rec):
                continue
            head = np.flatnonzero(np.r_[True, (rec[1:] != rec[:-1]) | (off[1:] != off[:-1] + 1) | (value[1:] != value[:-1])])
            tail = np.r_[head[1:] - 1, len(rec) - 1]
            r = rec[head]
            cols = (place[r], count[r], off[head], off[tail] + 1, value[head])
            row = np.repeat(np.arange(len(sizes)), sizes)[r]
            cuts = np.searchsorted(row, np.arange(len(sizes) + 1)).tolist()
            keep = [k for k in range(len(sizes)) if cuts[k + 1] > cuts[k]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows["block"][k] for k in keep], pa.int64()), *(pa.array([x[cuts[k]:cuts[k + 1]].tobytes() for k in keep], pa.binary()) for x in cols)],
                ["block", "place", "count", "begin", "end", "low"])

    return asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        run, "block long, place binary, count binary, begin binary, end binary, low binary")


# ---- the cut

def _covered(text: np.ndarray, lens: np.ndarray, ids: np.ndarray, marked: list[np.ndarray], size: int) -> np.ndarray:
    """Which bytes of a block go."""
    place, count, begin, end, low = marked
    raw = text.tobytes()
    anchor, start, n, doc = stretches(text, lens, size)
    at = np.searchsorted(start, place, "right") - 1
    wanted: dict[bytes, list[int]] = {}
    for k, (p, c) in enumerate(zip(place.tolist(), count.tolist())):
        wanted.setdefault(raw[p:p + c + size - 1], []).append(k)
    hot = np.isin(anchor, anchor[at[n[at] != count]])  # their strings were asked for one by one
    if hot.any():
        nth, single, _ = _singles(text, start[hot], n[hot], size)
        anchor, doc = np.r_[anchor[~hot], anchor[hot][nth]], np.r_[doc[~hot], doc[hot][nth]]
        start, n = np.r_[start[~hot], single], np.r_[n[~hot], np.ones(len(single), np.int64)]
        order = np.argsort(start, kind="stable")
        anchor, doc, start, n = anchor[order], doc[order], start[order], n[order]
        at = np.searchsorted(start, place, "right") - 1
    hit = np.flatnonzero(np.isin(anchor, anchor[at]))
    diff = np.zeros(len(text) + 1, np.int64)
    who = ids[doc]
    from_, to, own, least = [], [], [], []
    for s, e, i in zip(start[hit].tolist(), (start + n + size - 1)[hit].tolist(), who[hit].tolist()):
        for k in wanted.get(raw[s:e], ()):
            if low[k] < i:
                from_.append(s + begin[k])
                to.append(s + end[k] + size - 1)
    np.add.at(diff, np.array(from_, np.int64), 1)
    np.add.at(diff, np.array(to, np.int64), -1)
    return np.cumsum(diff)[:-1] > 0


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, extra: Column | None = None,
                 kept_text: bool = False, hot: int = 50_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row per input row; with kept_text also `text`, what is left,
    and with extra, an expression over docs' columns, also its value, `extra`."""
    if size < 24:
        raise ValueError("size must be 24 at least")
    n, more = partitions(docs.sparkSession), extra is not None
    table = bucketed(blocks(docs, id_col, text_col, extra), "blocks", "block", n)
    answers = shared_anchors(table, size, n, hot).groupBy("block").agg(*(F.collect_list(k).alias(k) for k in ("anchors", "hot")))
    asked = requests(table.select("block", "ids", "lens", "text").join(answers.hint("shuffle_hash"), "block"), size, 4 * n)
    names = ("place", "count", "begin", "end", "low")
    found = written(marks(asked, size), "marks").groupBy("block").agg(*(F.collect_list(k).alias(k) for k in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, lens, ids = _block_arrays(b, i)
                raw = text.tobytes()
                marked = [np.frombuffer(b"".join(b.column(k)[i].as_py() or []), np.int64) for k in names]
                gone = _covered(text, lens, ids, marked, size) if len(marked[0]) else np.zeros(len(text), bool)
                kept, removed, spans, shas, at = [], [], [], [], 0
                for n in lens.tolist():
                    own, t = gone[at:at + n], raw[at:at + n]
                    if own.any():
                        t = text[at:at + n][~own].tobytes()
                        spans.append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()))
                    else:
                        spans.append(0)
                    removed.append(n - len(t))
                    shas.append(hashlib.sha256(t).hexdigest())
                    if kept_text:
                        kept.append(t.decode("utf-8", "ignore"))
                    at += n
                cols = [pa.array(ids, mask=ids == LAST), pa.array(lens), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas)]
                if kept_text:
                    cols.append(pa.array(kept, pa.string()))
                if more:
                    cols.append(b.column("extra")[i].values)
                yield pa.RecordBatch.from_arrays(cols, out)

    schema = T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * kept_text)
    if more:
        schema = schema.add("extra", table.schema["extra"].dataType.elementType)
    out = schema.names
    read = table if more else table.drop("extra")
    return read.join(found.hint("shuffle_hash"), "block", "left").mapInArrow(run, schema)
