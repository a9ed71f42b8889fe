"""Packing token sequences by non-negative least squares.

Documents are tokenized once. Every full window of 2048 ids is a sequence of its own; what is left of a document, a rest
of 1 to 2047 ids, is packed with others. The histogram of rest lengths (at most 2047 numbers, whatever the corpus) goes to
the driver, where shallow combinations of lengths that fill a window exactly are enumerated, their repeat counts are
solved by non-negative least squares against the histogram, rounded down and held to the histogram. Rests are numbered
within their length, and a number decides the combination and the place. Rests left over are packed greedily, longest
first, each cut where its sequence is full; the last, unfilled sequence is dealt out to sequences with lengths that are
powers of two, which need no padding.

Defined results: a null text is empty, and an empty one has the closing id alone; a null id stays null, and one that is no
number becomes null; repeated rows are packed each; very long texts are tokenized whole; rests of equal length are placed in the
order of a hash of their row; an empty table gives no rows; other columns are not read. Sequence ids are unique, not dense."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ranked, written
from .word_cache import blocks_of, encoder

#: Sequence ids of packed rests start here; those of full windows are below.
PACKED = 1 << 62
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, tokenizer: str, window: int, id_col: str = "doc_id", text_col: str = "text",
              end_id: int = 1) -> DataFrame:
    """A row per document: row (unique), doc_id, doc_tokens, first_sequence, crcs of its full windows, rest_len, rest_crc
    and rest (little-endian unsigned 16-bit ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        row = sequence
        for b in batches:
            n, first, crcs, rest_len, rest_crc, rest = [], [], [], [], [], []
            for ids in (x for some in blocks_of([t or "" for t in b.column(1).to_pylist()]) for x in encode(some)):
                ids = np.append(ids, np.uint16(end_id)).astype("<u2")
                wide = memoryview(ids.astype("<u4")).cast("B")
                full = len(ids) // window
                n.append(len(ids))
                first.append(sequence)
                sequence += full
                crcs.append([zlib.crc32(wide[4 * window * i:4 * window * (i + 1)]) for i in range(full)])
                rest_len.append(len(ids) - full * window)
                rest_crc.append(zlib.crc32(wide[4 * window * full:]))
                rest.append(ids[window * full:].tobytes())
            rows = np.arange(row, row + len(n))
            row += len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), b.column(0), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(crcs, pa.list_(pa.int64())),
                 pa.array(rest_len, pa.int64()), pa.array(rest_crc, pa.int64()), pa.array(rest, pa.binary())],
                ["row", "doc_id", "doc_tokens", "first_sequence", "crcs", "rest_len", "rest_crc", "rest"])

    return docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "row long, doc_id long, doc_tokens long, first_sequence long, crcs array<long>, rest_len long, rest_crc long, rest binary")


def combinations(lengths: list[int], window: int, depth: int = 8) -> list[tuple[int, int, int]]:
    """(a, k, b): k <= depth parts of length a and one of length b (0: none) that fill the window exactly."""
    there, out = set(lengths), []
    for a in lengths:
        for k in range(1, min(depth, window // a) + 1):
            b = window - k * a
            if b == 0 or (b in there and not (k == 1 and b < a) and b != a):
                out.append((a, k, b))
    return out


def solve(hist: dict[int, int], window: int, sweeps: int = 60) -> list[tuple[int, int, int, int]]:
    """(a, k, b, times): repeat counts of combinations that use no more of a length than the histogram has.

    Minimises |A x - histogram|^2 over x >= 0 by cyclic coordinate descent (a column of A has one or two entries)."""
    cols = combinations(sorted(hist), window)
    left = {n: float(c) for n, c in hist.items()}
    x = [0.0] * len(cols)
    for _ in range(sweeps):
        moved = 0.0
        for j, (a, k, b) in enumerate(cols):
            step = (k * left[a] + left[b]) / (k * k + 1) if b else left[a] / k
            step = max(step, -x[j])
            if step:
                x[j] += step
                left[a] -= k * step
                if b:
                    left[b] -= step
                moved = max(moved, abs(step))
        if moved < 0.5:
            break
    have, out = dict(hist), []
    for j in sorted(range(len(cols)), key=lambda j: (-x[j], cols[j])):
        a, k, b = cols[j]
        times = min(int(x[j]), have[a] // k, have[b] if b else have[a])
        if times:
            have[a] -= k * times
            if b:
                have[b] -= times
            out.append((a, k, b, times))
    return out


def plan(hist: dict[int, int], window: int) -> dict[str, np.ndarray]:
    """Where the rest of each length and number goes. Its size is bound by the window, not by the corpus.

    Slots (sorted by key = length << 40 | first number): sequence base, times, offset of the first part. A number below a
    slot's end is part number // times of sequence base + number % times. Numbers from rest_from[length] on belong to the
    greedy stream, which begins at stream_at[length]; `edges` are the stream's sequence ends after its full windows."""
    base, slots, used = 0, [], dict.fromkeys(hist, 0)
    for a, k, b, times in solve(hist, window):
        for length, parts, offset in ((a, k, 0), (b, 1, k * a)):
            if length:
                slots.append((length << 40 | used[length], parts * times, base, times, offset))
                used[length] += parts * times
        base += times
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 5)
    rest_from, stream_at, at = np.zeros(window, np.int64), np.zeros(window, np.int64), 0
    for length in sorted(hist, reverse=True):
        rest_from[length], stream_at[length] = used[length], at
        at += length * (hist[length] - used[length])
    full, tail = divmod(at, window)
    edges, done = [full * window], full * window
    for bit in reversed(range(window.bit_length())):
        if tail >> bit & 1:
            done += 1 << bit
            edges.append(done)
    return {"slots": table, "rest_from": rest_from, "stream_at": stream_at, "edges": np.array(edges, np.int64),
            "base": np.int64(base)}


def placed(numbered: DataFrame, to: dict[str, np.ndarray], window: int) -> DataFrame:
    """Pieces of the rests in `numbered` (row, doc_id, doc_tokens, rest_len, rest_crc, rank). A rest that is cut has
    ids_crc32 null. cut: from and to within the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, edges = to["slots"], to["edges"]
        for b in batches:
            row, n, length, crc, rank = (b.column(k).to_numpy() for k in ("row", "doc_tokens", "rest_len", "rest_crc", "rank"))
            whole = rank < to["rest_from"][length]
            s = slots[np.searchsorted(slots[:, 0], length[whole] << 40 | rank[whole], "right") - 1] if len(slots) else slots
            t = rank[whole] - (s[:, 0] & ((1 << 40) - 1))
            part, nth = np.divmod(t, np.maximum(s[:, 3], 1))
            cols = [[row[whole]], [np.zeros(whole.sum(), np.int64)], [length[whole]],
                    [PACKED + s[:, 2] + nth], [s[:, 4] + part * length[whole]]]
            at = np.flatnonzero(~whole)
            begin = to["stream_at"][length[at]] + (rank[at] - to["rest_from"][length[at]]) * length[at]
            inner = np.zeros(len(at), np.int64)
            while len(at):
                pos = begin + inner
                in_tail = pos >= edges[0]
                k = np.searchsorted(edges, pos, "right")
                end = np.where(in_tail, edges[np.minimum(k, len(edges) - 1)], (pos // window + 1) * window)
                start = np.where(in_tail, edges[np.maximum(k - 1, 0)], pos // window * window)
                size = np.minimum(end - pos, length[at] - inner)
                number = np.where(in_tail, edges[0] // window + k - 1, pos // window)
                for c, v in zip(cols, (row[at], inner, size, PACKED + to["base"] + number, pos - start)):
                    c.append(v)
                inner = inner + size
                more = inner < length[at]
                at, begin, inner = at[more], begin[more], inner[more]
            r, inner, size, seq, off = map(np.concatenate, cols)
            i = np.searchsorted(row, r, sorter=(order := np.argsort(row)))
            i = order[i]
            cut = size < length[i]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(i)), pa.array(n[i] - length[i] + inner), pa.array(size), pa.array(crc[i], mask=cut), pa.array(n[i]),
                 pa.array(seq), pa.array(off), pa.array(r), pa.array(inner)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row", "inner"])

    return numbered.select("row", "doc_id", "doc_tokens", "rest_len", "rest_crc", "rank").mapInArrow(
        run, PIECES + ", row long, inner long")


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, id_col: str = "doc_id", text_col: str = "text",
         broadcast_rows: int = 200_000) -> DataFrame:
    """A row per piece, see PIECES: which ids of a document lie where in which sequence.

    Texts are read once; ids of full windows are not kept, only their checksums. Cut rests are looked up for their ids by
    a join, in which they are broadcast only if their number, known from the plan, is at most broadcast_rows."""
    if window & (window - 1) or window > 32768:
        raise ValueError("window must be a power of two, 32768 at most")
    t = written(tokenized(docs, tokenizer, window, id_col, text_col), "tokens")
    hist = {r["rest_len"]: r["n"] for r in t.where("rest_len > 0").groupBy("rest_len").agg(F.count(F.lit(1)).alias("n")).collect()}
    to = plan(hist, window)
    full = t.select("doc_id", "doc_tokens", "first_sequence", F.posexplode("crcs").alias("i", "ids_crc32")).select(
        "doc_id", (F.col("i") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32",
        "doc_tokens", (F.col("first_sequence") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    numbered = ranked(t.select("row", "doc_id", "doc_tokens", "rest_len", "rest_crc").where("rest_len > 0"), ["rest_len"], "row")
    pieces = written(placed(numbered, to, window), "pieces")
    names = full.columns
    cut = pieces.where("ids_crc32 is null").drop("ids_crc32")
    if int(to["edges"][-1]) // window + len(to["edges"]) <= broadcast_rows:
        cut = F.broadcast(cut)  # at most two pieces for each end of a sequence in the greedy stream
    ids = t.select("row", "rest").join(cut, "row")

    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, size = b.column("inner").to_pylist(), b.column("length").to_pylist()
            crc = [zlib.crc32(np.frombuffer(r, "<u2")[i:i + n].astype("<u4").tobytes()) for r, i, n in zip(b.column("rest").to_pylist(), at, size)]
            yield pa.RecordBatch.from_arrays([pa.array(crc, pa.int64()) if k == "ids_crc32" else b.column(k) for k in names], names)

    return full.unionByName(pieces.where("ids_crc32 is not null").select(*names)).unionByName(ids.mapInArrow(checksums, PIECES))
