"""Best-fit packing of token sequences in rounds.

Documents are tokenized once; those longer than a window are cut into full windows and a rest. Full windows are sequences.
Rests are items: each task packs its own by best fit, longest first (an item goes to the fullest bin that can take it), in
blocks of a bounded number of items. Bins that lack at most `slack` ids are emitted. The others are the items of the
next round, in which the tasks of `fan` neighbours are merged, so that what two tasks left over may meet; an item is packed
whole, with all that is in it. Rounds end when one task has packed what is left or when nothing has been merged. At
last what became of the bins of each round is followed upwards through the tables of the rounds.

The items of a round are read where their table lies, so no round shuffles; a task is given `items` of them in the mean and
holds one block of so many, whatever it is given.

Defined results: a null text is empty, and an empty one has the closing id alone; a null id stays null, and one that is
no number becomes null; repeated rows are packed each; very long texts are tokenized whole; items of equal length go in
the order of their numbers; an empty table gives no rows; other columns are not read. Sequence ids are unique, not dense."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .word_cache import blocks_of, spaced_encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
#: A sequence's id: the round (from 1; 0: a full window), the task's partition and a number in it.
ROUND, PARTITION = 57, 30


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it) of each item, and how full each bin is: in the order given, each item goes to the fullest bin that
    can take it, else to a new one. `open` has a bit for each gap that some bin has, so the least that is enough is found at once."""
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, gaps, open_ = [], [], [], 0
    for n in lengths.tolist():
        enough = open_ >> n
        if enough:
            gap = n + (enough & -enough).bit_length() - 1
            own = by_gap[gap]
            b = own.pop()
            if not own:
                open_ &= ~(1 << gap)
        else:
            b, gap = len(gaps), capacity
            gaps.append(gap)
        bins.append(b)
        offsets.append(capacity - gap)
        gap -= n
        gaps[b] = gap
        if gap:
            by_gap[gap].append(b)
            open_ |= 1 << gap
    return np.array(bins, np.int64), np.array(offsets, np.int64), capacity - np.array(gaps, np.int64)


def tokenized(docs: DataFrame, tokenizer: str, window: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
              ids: bool = False) -> DataFrame:
    """A row for each piece: PIECE, and with `ids` the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = spaced_encoder(tokenizer)
        for b in batches:
            at = 0
            for block in blocks_of([t or "" for t in b.column(1).to_pylist()]):
                rows, pieces, starts, lengths, crcs, held = [], [], [], [], [], []
                for i, x in enumerate(encode(block), at):
                    wide = np.append(x, np.uint16(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(wide), window)):
                        part = wide[start:start + window]
                        rows.append(i)
                        pieces.append(k)
                        starts.append(start)
                        lengths.append(len(part))
                        crcs.append(zlib.crc32(part.tobytes()))
                        if ids:
                            held.append(part.astype(np.int32))
                at += len(block)
                cols = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), *(pa.array(c, pa.int64()) for c in (starts, lengths, crcs))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(held, pa.list_(pa.int32()))] * ids, NAMES[:5] + ["ids"] * ids)

    return docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, PIECE + ", ids array<int>" * ids)


def packed(items: DataFrame, window: int, nth: int, most: int) -> DataFrame:
    """items, the first column a number, with `length`; adds bin, offset, and fill of the bin. Each task packs blocks of `most`."""
    names = items.columns

    def block(held: list[pa.RecordBatch], base: int) -> tuple[pa.RecordBatch, int]:
        t = pa.Table.from_batches(held)
        length = t.column("length").to_numpy()
        order = np.lexsort((t.column(names[0]).to_numpy(), -length))
        bins, offsets, fill = best_fit(length[order], window)
        cols = t.take(pa.array(order)).combine_chunks().to_batches()[0].columns
        return pa.RecordBatch.from_arrays([*cols, pa.array(base + bins), pa.array(offsets), pa.array(fill[bins])], [*names, "bin", "offset", "fill"]), base + len(fill)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = nth << ROUND | TaskContext.get().partitionId() << PARTITION
        held, rows = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, most - rows)
                b = b.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == most:
                    done, base = block(held, base)
                    yield done
                    held, rows = [], 0
        if rows:
            yield block(held, base)[0]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields)
    return items.mapInArrow(run, schema + ", bin long, offset long, fill long")


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", items: int = 1 << 15, slack: int = 2,
         fan: int = 8, ids: bool = False) -> DataFrame:
    """A row for each piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset), and with `ids` its ids."""
    pieces = written(tokenized(docs, tokenizer, window, id_col, text_col, ids=ids).select(F.monotonically_increasing_id().alias("item"), "*"), "pieces")
    rests = pieces.where(F.col("length") < window)
    tasks = -(-rests.count() // items)
    first = written(packed(rests.coalesce(max(1, tasks)), window, 1, items), "round")
    rounds, level = [], first
    while True:
        left = level.where((F.col("offset") == 0) & (F.col("fill") < window - slack)).select(F.col("bin").alias("item"), F.col("fill").alias("length"))
        n = left.count()
        fewer = max(-(-tasks // fan), -(-n // items))
        if tasks <= 1 or not n:
            break
        level = written(packed(left.coalesce(fewer), window, len(rounds) + 2, items), "round")
        rounds.append(level)
        bins = level.where("offset = 0").count()
        if bins == n and fewer == tasks:
            break
        tasks = fewer
    up = None
    for level in reversed(rounds):
        own = level.select("item", F.col("bin").alias("to"), F.col("offset").alias("by"))
        if up is not None:
            own = own.join(up.select(F.col("item").alias("to"), F.col("to").alias("over"), F.col("by").alias("more")), "to", "left").select(
                "item", F.coalesce("over", "to").alias("to"), (F.col("by") + F.coalesce("more", F.lit(0))).alias("by"))
        up = own
    names = NAMES + ["ids"] * ids
    done = first.withColumnRenamed("bin", "sequence_id")
    if up is not None:
        done = done.join(up.withColumnRenamed("item", "sequence_id"), "sequence_id", "left").withColumns(
            {"sequence_id": F.coalesce("to", "sequence_id"), "offset": F.col("offset") + F.coalesce("by", F.lit(0))})
    full = pieces.where(F.col("length") == window).select("*", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return done.select(*names).unionByName(full.select(*names))
