"""SimHash near-duplicate components, linked through BK-trees.

Fingerprints are 64 bits; two of them link at `radius` (3) or fewer differing bits. With 5 blocks of 12 or 13 bits, three
differing bits leave at least 2 blocks untouched, so linked fingerprints share at least one of the 10 pairs of blocks.
Distinct fingerprints are dealt to shards by (pair, the pair's bits). A shard's fingerprints form a BK-tree: a child hangs
on its parent by their Hamming distance, and a search follows only the edges within the radius of the query's distance to
the node. A shard's tree is built where its fingerprints are shuffled to and is searched there: its size follows the
data, so it has no bound that would let it be broadcast. All trees of a task are built and searched level by level at
once, in numpy. A shard with more than `part` fingerprints (a third of all rows may be near copies) is dealt into parts, and
every pair of parts has a tree in a task of its own. Each tree gives a spanning forest of its links, never all pairs;
components follow from the forests. Nodes of the graph are fingerprints, so rows that repeat an id stay apart.

`similar_components` and `keep_one` judge by shingles instead: texts link if the sets of their five-word shingles have a Jaccard
similarity of `least` (0.8) or more. Three differing bits miss most such pairs, so there candidates come from minima of the
shingle sets: those of 200 orders in 40 bands of 5, and a pair of similarity s shares none with probability (1 - s^5)^40, 1.3e-7
at 0.8. Texts of equal sets are one class; each band links its classes to its smallest one, so candidate components come
from as many rows as there are bands. The members of a component, in blocks of about `block` classes and 1000 times as many
shingles if they are many, and every pair of blocks, form BK-trees of the fingerprints of their sets. Edges within 28 bits are followed (a pair of 0.8 or more differs in
more with probability 1e-6), and what they find is confirmed by the exact sets.

Defined results: a null or blank text has fingerprint zero, linked like any other, and is one class with other blank ones;
repeated rows, also of one id, are rows of their own; a component's id is its smallest doc_id (null if it has none), and
keep_one leaves its row with the smallest id, one of them if several share it, a null id coming last; ids that are no
numbers are null; a very long text is one fingerprint of all its shingles; an empty table gives no rows; other columns,
whatever their names, are not read."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, with_rows, written

BANDS, ROWS = 40, 5
_RND = np.random.default_rng(20)
FLIP = _RND.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)[:, None]
ODD = _RND.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
SEEDS = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
WIDE = 28  # bits in which sets of similarity 0.8 or more differ at most
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PAIRS = tuple(combinations(range(len(BLOCKS)), 2))


def hashes(text: str | None, size: int) -> np.ndarray:
    """Of the shingles of `size` words, repeats included; a shorter text is one shingle, a blank one has none. ASCII letters
    are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    # a shingle is the stretch of the joined text from its first word's start to its last word's end
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[min(size, len(words)) - 1:].tolist())], np.uint64)


def majority(h: np.ndarray) -> int:
    """The number whose bits are 1 where over half the hashes have them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the shingles of `size` words, as an unsigned integer."""
    return majority(hashes(text, size))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp: long, the fingerprint's bits), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long")


def _block_key(fp: Column, pair: tuple[int, int]) -> Column:
    part = [F.shiftrightunsigned(fp, BLOCKS[i][0]).bitwiseAND(F.lit((1 << BLOCKS[i][1]) - 1)) for i in pair]
    return F.shiftleft(part[0], 13) + part[1]


def bk_hits(shard: np.ndarray, fp: np.ndarray, radius: int, block: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (indices a < b, distance of fp at most radius) inside each shard, as they are found.

    shard must be sorted. Building: all fingerprints of a shard start at its root, the first one; at each level those at
    the same distance from their node move to the child at that distance, whose node is the first of them. Searching: a
    (query, node) pair is kept while |edge - distance| <= radius."""
    n = len(fp)
    parent = np.full(n, -1, np.int64)
    edge = np.zeros(n, np.uint8)
    if n == 0:
        return
    first = np.r_[True, shard[1:] != shard[:-1]]
    node = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    roots = node.copy()
    live = np.flatnonzero(~first)
    while len(live):
        d = np.bitwise_count(fp[live] ^ fp[node[live]])
        order = np.lexsort((live, d, node[live]))
        live, d = live[order], d[order]
        up = node[live]
        head = np.r_[True, (up[1:] != up[:-1]) | (d[1:] != d[:-1])]
        child = live[np.maximum.accumulate(np.where(head, np.arange(len(live)), 0))]
        new = live[head]
        parent[new], edge[new] = up[head], d[head]
        node[live] = child
        live = live[~head]
    # children in CSR form, by parent and then by edge
    kids = np.flatnonzero(parent >= 0)
    kids = kids[np.lexsort((edge[kids], parent[kids]))]
    at = np.searchsorted(parent[kids], np.arange(n + 1))
    multi = np.flatnonzero(~first | np.r_[~first[1:], False])  # shards of one have no links
    for i in range(0, len(multi), block):
        stack = [(multi[i:i + block], roots[multi[i:i + block]])]
        while stack:
            q, nodes = stack.pop()
            many = at[nodes + 1] - at[nodes]
            if len(q) > 1024 and many.sum() > 8 * block:  # a wide front is searched in halves
                half = len(q) // 2
                stack += [(q[:half], nodes[:half]), (q[half:], nodes[half:])]
                continue
            d = np.bitwise_count(fp[q] ^ fp[nodes]).astype(np.int64)
            hit = (d <= radius) & (q > nodes)
            if hit.any():
                yield nodes[hit], q[hit]
            q, nodes = _down(q, nodes, d, many, at, kids, edge, radius)
            if len(q):
                stack.append((q, nodes))


def bk_links(shard: np.ndarray, fp: np.ndarray, radius: int, block: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of each shard's links (indices a < b)."""
    label = np.arange(len(fp))
    out = [_forest(a, b, label) for a, b in bk_hits(shard, fp, radius, block)]
    return (np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])) if out else (label[:0], label[:0])


def _down(q, nodes, d, many, at, kids, edge, radius):
    """The next level's (query, node) pairs: children whose edge is within the radius of the query's distance."""
    start = np.repeat(at[nodes] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    child = kids[start]
    near = np.abs(edge[child].astype(np.int64) - np.repeat(d, many)) <= radius
    return np.repeat(q, many)[near], child[near]


def _forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b that join two groups, per the group labels so far; label is brought up to date."""
    kept_a, kept_b = [], []
    while len(a):
        la, lb = _find(label, a), _find(label, b)
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        lo, hi = np.minimum(la, lb), np.maximum(la, lb)
        order = np.lexsort((lo, hi))
        pick = order[np.r_[True, hi[order][1:] != hi[order][:-1]]]  # each larger label is hung on one smaller label
        label[hi[pick]] = lo[pick]
        kept_a.append(a[pick])
        kept_b.append(b[pick])
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *kept_a]), np.concatenate([empty, *kept_b])


def _find(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = label[x]
    while True:
        up = label[r]
        if (up == r).all():
            label[x] = r
            return r
        r = up


def links(fps: DataFrame, radius: int = 3, part: int = 50_000) -> DataFrame:
    """(src, dst) between distinct fingerprints (fp: long) that differ in `radius` <= 3 bits or fewer: a spanning forest of
    each tree's links, so every linked pair is connected, though not always directly."""
    if radius > 3:
        raise ValueError("5 blocks find 3 differing bits at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        key, i, j, fp = (t.column(k).to_numpy() for k in ("key", "i", "j", "fp"))
        order = np.lexsort((fp, j, i, key))
        key, i, j, fp = key[order], i[order], j[order], fp[order]
        shard = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(key) else key
        a, b = bk_links(shard, fp.view(np.uint64), radius)
        for k in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(fp[a[k:k + 100_000]]), pa.array(fp[b[k:k + 100_000]])], ["src", "dst"])

    keys = F.array(*(F.lit(k).cast("long") * (1 << 26) + _block_key(F.col("fp"), p) for k, p in enumerate(PAIRS)))
    dealt = fps.select("fp", F.explode(keys).alias("key"))
    hot = written(dealt.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("g")).where("g > 1"), "hot-keys")
    if hot.isEmpty():
        dealt = dealt.select("fp", "key", F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:
        dealt = _in_pairs(dealt.join(hot, "key", "left").withColumn("g", F.coalesce("g", F.lit(1))), "fp", "key")
    return dealt.repartition("key", "i", "j").mapInArrow(run, "src long, dst long")


def _in_pairs(dealt: DataFrame, by: str, *keep: str) -> DataFrame:
    """(by, keep, p, i, j): rows dealt into g parts by `by`, each standing in every pair (i, j) that its part p is in."""
    dealt = dealt.withColumn("p", F.pmod(F.xxhash64(by), F.col("g")).cast("int"))
    return dealt.select(by, *keep, "p", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("q")).select(
        by, *keep, "p", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
                       radius: int = 3, part: int = 50_000) -> DataFrame:
    """(doc_id, fingerprint: 16 hex digits, component_id: the smallest doc_id reachable by links), a row per input row."""
    fps = written(fingerprints(docs, id_col, text_col, size), "simhash")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "fingerprints")
    comps = connected_components(links(reps.select("fp"), radius, part))
    of = reps.join(comps, reps["fp"] == comps["node"], "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    least = of.groupBy("component").agg(F.min("id").alias("component_id"))
    classes = of.select("fp", "component").join(least, "component").select("fp", "component_id")
    return fps.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- by the similarity of shingle sets

def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(hashes(text, size))


def set_digest(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 7)).view(np.int64)) if len(h) else 0


def bands(h: np.ndarray) -> np.ndarray:
    """BANDS keys of a set that isn't empty."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        low = np.minimum(low, ((h[None, at:at + 1024] ^ FLIP) * ODD).min(1))
    key = SEEDS.copy()
    for part in low.reshape(BANDS, ROWS).T:
        key = (key ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def classes(rows: DataFrame, text_col: str, size: int) -> DataFrame:
    """(row, digest of the set, its size, keys) of with_rows()'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, size) for t in b.column(1).to_pylist()]
            keys = pa.array([bands(h) if len(h) else [] for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(set_digest, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), keys],
                                             ["row", "digest", "size", "keys"])

    return rows.select("row", F.col("doc")[text_col].cast("string").alias("text")).mapInArrow(run, "row long, digest long, size long, keys array<long>")


def similar_links(rows: list[tuple[int, int, np.ndarray]], least: float, own: bool) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of (digest, block, set) with similarity `least` or more: all pairs within one block
    (own), or all between two. A BK-tree of the sets' fingerprints finds them, the sets confirm them."""
    rows = sorted(rows, key=lambda r: r[0])
    fp = np.array([majority(h) for _, _, h in rows], np.uint64)
    block, size = np.array([r[1] for r in rows]), np.array([len(r[2]) for r in rows])
    label, out = np.arange(len(rows)), []
    common = _common([h for _, _, h in rows])
    for a, b in bk_hits(np.zeros(len(rows), np.int64), fp, WIDE, 2000):
        fit = np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - 1e-9
        if not own:
            fit &= block[a] != block[b]
        a, b = a[fit], b[fit]
        apart = _find(label, a) != _find(label, b)
        a, b = a[apart], b[apart]
        if len(a):
            both = common(a, b)
            near = both >= least * (size[a] + size[b] - both) - 1e-9
            x, y = _forest(a[near], b[near], label)
            out += [(rows[i][0], rows[j][0]) for i, j in zip(x.tolist(), y.tolist())]
    return out


def _common(sets: list[np.ndarray], most: int = 64 << 20):
    """A function of two index arrays: the sizes of the sets' intersections. Elements of two sets or more are bits of rows
    of words, if these take no more than `most` bytes; else the sets themselves are compared."""
    flat = np.concatenate([*sets, np.empty(0, np.uint64)])
    seen, times = np.unique(flat, return_counts=True)
    seen = seen[times > 1]
    words = -(-len(seen) // 64) or 1
    if 8 * words * len(sets) <= most:
        bits = np.zeros((len(sets), 8 * words), np.uint8)
        for row, h in zip(bits, sets):
            at = np.searchsorted(seen, h)
            at = at[seen[np.minimum(at, len(seen) - 1)] == h] if len(seen) else at[:0]
            np.bitwise_or.at(row, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        packed = bits.view(np.uint64)
        step = max(1, (4 << 20) // words)
        return lambda a, b: np.concatenate([np.bitwise_count(packed[a[i:i + step]] & packed[b[i:i + step]]).sum(1, dtype=np.int64) for i in range(0, len(a), step)])
    return lambda a, b: np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist())], np.int64)


def similar(texts: DataFrame, size: int, least: float) -> DataFrame:
    """(src, dst: digests) from (digest, text, component, p, i, j): the members of block pair (i, j) of a component."""

    def done(members: dict[int, tuple[int, str]], own: bool) -> pa.RecordBatch:
        got = similar_links([(d, p, shingles(t, size)) for d, (p, t) in members.items()], least, own)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members = None, {}
        for b in batches:
            for digest, text, c, p, i, j in zip(*(col.to_pylist() for col in b.columns)):
                if at != (c, i, j):
                    if len(members) > 1:
                        yield done(members, at[1] == at[2])
                    at, members = (c, i, j), {}
                members[digest] = (p, text)
        if len(members) > 1:
            yield done(members, at[1] == at[2])

    return texts.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(run, "src long, dst long")


def _similar_rows(docs: DataFrame, id_col: str, text_col: str, size: int, least: float, block: int) -> tuple[DataFrame, DataFrame]:
    """with_rows()'s rows, and (row, id, component: a digest) of them."""
    if not 0.8 <= least <= 1:
        raise ValueError("the bands find similarities of 0.8 and more")
    held = written(with_rows(docs), "rows")
    rows = written(classes(held, text_col, size), "classes")
    # an exact copy adds no row here; of a class, one row's text is read
    keyed = rows.groupBy("digest").agg(F.min_by("keys", "row").alias("keys")).select("digest", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("digest").alias("hub"), F.max("digest").alias("last")).where("hub < last").select("key", "hub")
    near = connected_components(keyed.join(hubs, "key").where("digest <> hub").select(F.col("digest").alias("src"), F.col("hub").alias("dst")).distinct())
    near = written(near.withColumnRenamed("node", "digest"), "candidates")
    one = rows.groupBy("digest").agg(F.min("row").alias("row"), F.max("size").alias("size"))
    near = near.join(one, "digest")
    parts = near.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("size") / (1000 * block))).cast("int").alias("g"))
    dealt = _in_pairs(near.join(parts, "component"), "digest", "row", "component")
    own = held.select("row", F.col("doc")[text_col].cast("string").alias("text"))
    texts = own.join(dealt, "row").select("digest", "text", "component", "p", "i", "j")
    found = connected_components(similar(texts, size, least)).withColumnRenamed("node", "digest")
    ids = held.select("row", F.col("doc")[id_col].try_cast("long").alias("id"))
    of = rows.select("row", "digest").join(found, "digest", "left").select("row", F.coalesce("component", "digest").alias("component"))
    return held, written(of.join(ids, "row"), "components")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8,
                       block: int = 4000) -> DataFrame:
    """(doc_id, component_id: the smallest doc_id reachable by links), a row per input row."""
    _, of = _similar_rows(docs, id_col, text_col, size, least, block)
    smallest = of.groupBy("component").agg(F.min("id").alias("component_id"))
    return of.join(smallest, "component").select(F.col("id").alias("doc_id"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, block: int = 4000) -> DataFrame:
    """One row of docs of each component, see above, with all its columns."""
    held, of = _similar_rows(docs, id_col, text_col, size, least, block)
    first = of.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = of.join(first, "component").where("row <> first.row").select("row")
    return held.join(gone, "row", "left_anti").select(*(F.col("doc")[c].alias(c) for c in docs.columns))
