"""A layered neighbour graph, kept: approximate search that measures few rows, with insertion, deletion and compaction.

Rows are dealt into segments of a bounded size, one row of a Parquet table each: ids, vectors, the level that each node was
drawn, and for each level the lists of its neighbours. Equal vectors of a segment are one node with several ids, so that a
vector that many rows share blocks no way. A segment's graph is built in one task from exact
nearest neighbours, and searched by a greedy descent through the upper levels and a beam of bounded width in the lowest.
Every query meets every segment: blocks of queries are broadcast if they measure little, else dealt to groups of segments by a
join, and each pair gives k rows at most.

What is added later forms segments of its own; a row that is deleted or replaced stays in its graph as a way through, but
is no longer found. Segments that have become small or have lost many rows are built anew by compact(). The manifest is renamed
into place after all else, so readers see one version, and opening an index builds nothing."""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.session import partitions
from ..sources.store import Folder
from .search import BROADCAST_BYTES, SearchError

SEGMENT = "segment long, dim int, n long, vectors binary, levels binary, links array<binary>, starts binary, ids array<{}>"
#: The least that a draw counts as, and neighbours of a node in the upper levels.
LEAST_DRAW, NEIGHBOURS = 1e-10, 16
#: Neighbours of a node in the lowest level, how wide a beam is in the upper levels, and how many nodes a search begins with at least.
LOWEST, UPPER_WIDTH, ENTRIES = 24, 8, 3
METRICS = ("cosine", "euclidean")
#: Numbers of a matrix of distances that a build holds at a time (and a few matrices of that size).
MEASURED = 1 << 21


def level(id_col: Column, m: int = NEIGHBOURS) -> Column:
    """The level of a node, floor(-ln(u) / ln m) for a u in (0, 1) drawn from its id: the same in every build."""
    u = F.conv(F.substring(F.md5(id_col.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return F.floor(-F.log(F.greatest(u, F.lit(LEAST_DRAW))) / F.lit(math.log(m))).cast("int")


def _nearness(x: np.ndarray, q: np.ndarray, half: np.ndarray | None) -> np.ndarray:
    """Larger is nearer: cosine of unit vectors, or what decides of two distances."""
    return x @ q if half is None else x @ q - half


def neighbour_lists(x: np.ndarray, most: int) -> np.ndarray:
    """(n, most) places, -1 for none. Half of a node's are chosen among its 2 * most nearest, nearest first, each nearer to it than
    to those chosen before, so that they lie on all sides; then the nearest that are left; the other half are nodes that
    have chosen it."""
    n, half = len(x), (x * x).sum(1) / 2
    out, c, k = np.full((n, most), -1, np.int32), min(2 * most, n - 1), max(1, most // 2)
    if c < 1:
        return out
    near, far, held = np.empty((n, c), np.int64), np.empty((n, c)), np.zeros((n, c), bool)
    step = max(16, min(512, MEASURED // n))
    for at in range(0, n, step):
        d = half[at:at + step, None] + half
        d -= x[at:at + step] @ x.T  # half the squared distance
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        own = np.argpartition(d, c - 1, axis=1)[:, :c]
        own = np.take_along_axis(own, np.argsort(np.take_along_axis(d, own, 1), axis=1, kind="stable"), 1)
        near[at:at + step], far[at:at + step] = own, np.take_along_axis(d, own, 1)
        between = half[own][:, :, None] + half[own][:, None] - np.matmul(x[own], x[own].transpose(0, 2, 1))
        chosen, number = held[at:at + step], np.zeros(len(own), np.int64)
        for i in range(c):
            apart = ~(chosen[:, :i] & (between[:, i, :i] <= far[at:at + step, i:i + 1])).any(1) & (number < k)
            chosen[:, i] = apart
            number += apart
        for i in range(c):
            more = ~chosen[:, i] & (number < k)
            chosen[:, i] |= more
            number += more
    of, i = np.nonzero(held)
    to, how = near[of, i], far[of, i]
    out[of, np.arange(len(of)) - np.searchsorted(of, of)] = to
    new = ~np.isin(to * n + of, of * n + to)  # not chosen by both
    order = np.lexsort((of[new], how[new], to[new]))
    back, by = to[new][order], of[new][order]
    nth = held.sum(1)[back] + np.arange(len(back)) - np.searchsorted(back, back)
    fits = nth < most
    out[back[fits], nth[fits]] = by[fits]
    return out


class Segment:
    """Nodes of distinct vectors; the rows of node i are those from starts[i] to starts[i + 1]. dead: rows that are not found."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray] | None, metric: str, starts: np.ndarray | None = None, dead: list[int] = (),
                 lowest: int = LOWEST):
        x = vectors.astype(np.float64)
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        self.metric = metric
        self.x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0) if metric == "cosine" else x
        self.half = None if metric == "cosine" else norm[:, 0] ** 2 / 2
        self.levels, self.starts = levels, np.arange(len(x) + 1) if starts is None else starts
        self.lives = np.ones(self.starts[-1], bool)
        self.lives[list(dead)] = False
        self.alive = np.add.reduceat(self.lives, self.starts[:-1], dtype=np.int64) > 0 if len(x) else np.zeros(0, bool)
        top = int(levels.max(initial=0))
        self.own = [np.flatnonzero(levels >= i) for i in range(top + 1)]
        if links is None:
            links = []
            for i, own in enumerate(self.own):
                near = neighbour_lists(self.x[own], NEIGHBOURS if i else lowest)
                links.append(np.where(near >= 0, own[near], -1).astype(np.int32))
        self.links = links
        self.at = [{int(o): i for i, o in enumerate(own)} for own in self.own[1:]]

    def _beam(self, i: int, q: np.ndarray, start: list[tuple[float, int]], width: int, living: int = 0) -> tuple[list[tuple[float, int]], int]:
        """(the nearest nodes met in level i, at most `width`; how many nodes were measured), from the nodes of `start` on: the
        nearest node not yet looked at is next, until it is farther than all that are kept. With `living`, of the living nodes
        met the nearest that many."""
        seen, measured = np.zeros(len(self.x), bool), 0
        seen[[j for _, j in start]] = True
        ahead, kept = [(-v, j) for v, j in start], [(v, -j) for v, j in start]
        heapq.heapify(ahead)
        heapq.heapify(kept)
        while len(kept) > width:
            heapq.heappop(kept)
        found = [(v, -j) for v, j in start if self.alive[j]]
        heapq.heapify(found)
        while ahead:
            far, node = heapq.heappop(ahead)
            if len(kept) >= width and -far < kept[0][0]:
                break
            beside = self.links[i][node if not i else self.at[i - 1][node]]
            beside = beside[beside >= 0]
            beside = beside[~seen[beside]]
            if not len(beside):
                continue
            seen[beside] = True
            measured += len(beside)
            for v, j in zip(self._near(beside, q).tolist(), beside.tolist()):
                if len(kept) < width or v > kept[0][0]:
                    heapq.heappush(ahead, (-v, j))
                    heapq.heappush(kept, (v, -j))
                    if len(kept) > width:
                        heapq.heappop(kept)
                if living and self.alive[j] and (len(found) < living or v > found[0][0]):
                    heapq.heappush(found, (v, -j))
                    if len(found) > living:
                        heapq.heappop(found)
        return [(v, -j) for v, j in sorted(found if living else kept, reverse=True)][:living or width], measured

    def _near(self, nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
        return _nearness(self.x[nodes], q, None if self.half is None else self.half[nodes])

    def rows_of(self, node: int, k: int) -> list[int]:
        """The first k living rows of a node, those of the smallest ids."""
        a, b = self.starts[node:node + 2]
        return (a + np.flatnonzero(self.lives[a:b])[:k]).tolist()

    def search(self, q: np.ndarray, k: int, width: int) -> tuple[list[tuple[float, int]], int]:
        """(the k nearest living nodes found, nearest first; how many nodes were measured). It begins with all nodes of the
        highest level that has ENTRIES of them."""
        top = max((i for i, own in enumerate(self.own) if len(own) >= ENTRIES), default=0)
        own = self.own[top] if top else self.own[-1]
        found, cost = list(zip(self._near(own, q).tolist(), own.tolist())), len(own)
        for i in range(top - 1, 0, -1):
            found, more = self._beam(i, q, sorted(found)[-UPPER_WIDTH:], UPPER_WIDTH)
            cost += more
        found, more = self._beam(0, q, sorted(found)[-UPPER_WIDTH:], width, k)
        return found, cost + more

    def near_enough(self, q: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each row of q: all living nodes that may be as near as `least`, and how near they are; 32 queries at a time."""
        for at in range(0, len(q), 32):
            s = self.x @ q[at:at + 32].T
            if self.half is not None:
                s -= self.half[:, None]
            for j, v in enumerate(q[at:at + 32]):
                low = least[at + j]
                own = np.flatnonzero(self.alive & (s[:, j] >= low - 1e-9 * max(1.0, abs(low) if np.isfinite(low) else 1.0)))
                yield own, (self.x[own] * v).sum(1) - (0 if self.half is None else self.half[own])


@dataclass(frozen=True)
class GraphManifest:
    dimension: int
    kind: str
    metric: str = "cosine"
    rows_a_segment: int = 32768
    neighbours: int = LOWEST
    segments: list[str] = field(default_factory=list)
    dead: str = ""
    next_segment: int = 0
    rows: int = 0
    gone: int = 0
    before: list[str] = field(default_factory=list)


class GraphIndex(Folder):
    """ids and vectors in a folder: `replace` them all, `insert`, `delete`, `compact`, `search`."""

    def manifest(self) -> GraphManifest | None:
        found = self._read("graph.json")
        return GraphManifest(**found) if found else None

    def is_empty(self) -> bool:
        return self.count() == 0

    def count(self) -> int:
        m = self.manifest()
        return m.rows - m.gone if m else 0

    def clear(self) -> None:
        self._fs().delete(self._path(""), True)

    # ---- segments

    def _built(self, rows: DataFrame, m: GraphManifest) -> tuple[str, int, int]:
        """(where the segments of rows (id, v) are, the number of the next one, how many rows)."""
        where, kind, metric, lowest = f"segments-{uuid.uuid4().hex}", m.kind, m.metric, m.neighbours
        rows = rows.withColumn("level", level(F.col("id")))
        n = rows.count()
        if not n:
            return "", m.next_segment, 0
        parts = -(-n // m.rows_a_segment)
        dealt = rows.withColumn("segment", F.lit(m.next_segment) + F.pmod(F.xxhash64("id"), F.lit(parts)))

        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by("id").combine_chunks()
            x, node = np.unique(np.asarray(t.column("v").chunk(0).flatten(), np.float32).reshape(t.num_rows, -1), axis=0, return_inverse=True)
            order = np.argsort(node, kind="stable")
            starts = np.searchsorted(node[order], np.arange(len(x) + 1)).astype(np.int32)
            s = Segment(x, t.column("level").to_numpy()[order][starts[:-1]].astype(np.int32), None, metric, lowest=lowest)
            one = {"segment": t.column("segment").slice(0, 1), "dim": [x.shape[1]], "n": [t.num_rows], "vectors": [x.tobytes()], "levels": [s.levels.tobytes()],
                   "links": [[np.ascontiguousarray(a).tobytes() for a in s.links]], "starts": [starts.tobytes()],
                   "ids": pa.ListArray.from_arrays([0, t.num_rows], t.column("id").chunk(0).take(pa.array(order)))}
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary(), None]
            return pa.table({k: v if t is None or isinstance(v, pa.ChunkedArray) else pa.array(v, t) for (k, v), t in zip(one.items(), kinds)})

        dealt.groupBy("segment").applyInArrow(run, SEGMENT.format(kind)).write.parquet(f"{self.root}/{where}")
        return where, m.next_segment + parts, n

    def segments(self) -> DataFrame:
        m = self.manifest()
        return self.spark.read.schema(SEGMENT.format(m.kind)).parquet(*(f"{self.root}/{s}" for s in m.segments)) if m.segments else self.spark.createDataFrame([], SEGMENT.format(m.kind))

    def _places(self) -> DataFrame:
        """(id, segment, place, dead) of all nodes."""
        nodes = self.segments().select("segment", F.posexplode("ids").alias("place", "id"))
        m = self.manifest()
        if not m.dead:
            return nodes.withColumn("dead", F.lit(False))
        dead = self._dead(m).select("segment", F.explode("places").alias("place"), F.lit(True).alias("dead"))
        return nodes.join(dead, ["segment", "place"], "left").withColumn("dead", F.coalesce("dead", F.lit(False)))

    def _dead(self, m: GraphManifest) -> DataFrame:
        return self.spark.read.schema("segment long, places array<int>").parquet(f"{self.root}/{m.dead}")

    def _without(self, ids: DataFrame, m: GraphManifest) -> GraphManifest:
        """The manifest under which rows of `ids` are dead, besides those that are."""
        if not m.segments:
            return m
        where = f"dead-{uuid.uuid4().hex}"
        marked = self._places().join(ids.select("id").distinct().withColumn("now", F.lit(True)), "id", "left").where("dead or now")
        marked.groupBy("segment").agg(F.sort_array(F.collect_list("place")).alias("places")).write.parquet(f"{self.root}/{where}")
        gone = self.spark.read.schema("segment long, places array<int>").parquet(f"{self.root}/{where}").agg(F.sum(F.size("places"))).first()[0] or 0
        return replace(m, dead=where if gone else "", gone=gone)

    def _publish(self, m: GraphManifest) -> None:
        """Renames the manifest into place. Tables of the version before stay for its readers, older ones go."""
        old = self.manifest()
        own = [*old.segments, *filter(None, [old.dead])] if old else []
        self._write("graph.json", asdict(replace(m, before=own)))
        for gone in set(old.before if old else ()).difference(own, m.segments, [m.dead]):
            self._fs().delete(self._path(gone), True)

    @staticmethod
    def _rows(vectors: DataFrame, id_col: str, vec_col: str, dimension: int) -> DataFrame:
        """(id, v): valid vectors of the dimension, others are passed over; of a repeated id the largest vector."""
        v = F.col(vec_col).cast("array<float>")
        fine = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(V.is_valid("v") & (F.size("v") == dimension) & F.col("id").isNotNull())
        return fine.groupBy("id").agg(F.max("v").alias("v"))

    # ---- what a user calls

    def replace(self, vectors: DataFrame, dimension: int, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "cosine", rows_a_segment: int = 32768,
                neighbours: int = LOWEST) -> int:
        """Builds the index of `vectors` and puts it in place of what there was, with so many neighbours of a node in the lowest
        level. Returns the number of rows."""
        if metric not in METRICS:
            raise SearchError(f"no metric {metric}")
        m = GraphManifest(dimension, vectors.schema[id_col].dataType.simpleString(), metric, rows_a_segment, neighbours)
        where, following, n = self._built(self._rows(vectors, id_col, vec_col, dimension), m)
        self._publish(replace(m, segments=[where] if where else [], next_segment=following, rows=n))
        return n

    def insert(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> int:
        """Adds rows as segments of their own; a row whose id is there already is replaced. Returns how many came in."""
        m = self._opened()
        rows = self._rows(vectors.withColumn(id_col, F.col(id_col).cast(m.kind)), id_col, vec_col, m.dimension)
        where, following, n = self._built(rows, m)
        if n:
            left = self._without(rows, m)
            self._publish(replace(left, segments=[*m.segments, where], next_segment=following, rows=m.rows + n))
        return n

    def delete(self, ids: DataFrame, id_col: str = "vec_id") -> int:
        """Takes rows out; unknown ids are passed over. Returns how many went."""
        m = self._opened()
        left = self._without(ids.select(F.col(id_col).cast(m.kind).alias("id")), m)
        self._publish(left)
        return left.gone - m.gone

    def compact(self, least_full: float = 0.5) -> int:
        """Builds anew the segments of which less than `least_full` of a segment's size lives. Returns how many there were."""
        m = self._opened()
        living = self._places().groupBy("segment").agg(F.count_if(~F.col("dead")).alias("alive"), F.count(F.lit(1)).alias("n"))
        poor = living.where((F.col("alive") < least_full * m.rows_a_segment) | (F.col("alive") < least_full * F.col("n"))).select("segment")
        poor_n = poor.count()
        if poor_n <= 1 and not poor.join(living.where("alive < n"), "segment", "left_semi").count():
            return 0
        where, following, n = self._built(self.rows(poor).select("id", "v"), m)
        kept = f"segments-{uuid.uuid4().hex}"
        rest = self.segments().join(poor, "segment", "left_anti")
        rest.write.parquet(f"{self.root}/{kept}")
        still, dead = self._places().join(poor, "segment", "left_anti"), f"dead-{uuid.uuid4().hex}"
        still.where("dead").groupBy("segment").agg(F.sort_array(F.collect_list("place")).alias("places")).write.parquet(f"{self.root}/{dead}")
        left = still.agg(F.count(F.lit(1)).alias("n"), F.count_if("dead").alias("gone")).first()
        self._publish(replace(m, segments=([kept] if left["n"] else []) + ([where] if where else []), dead=dead if left["gone"] else "", gone=left["gone"],
                              next_segment=following, rows=left["n"] + n))
        return poor_n

    def rows(self, of: DataFrame | None = None) -> DataFrame:
        """(segment, id, v) of all living rows, or of those in some segments."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    dim, raw, ids = b.column("dim")[i].as_py(), b.column("vectors")[i].as_py(), b.column("ids")[i].values
                    x = np.repeat(np.frombuffer(raw, np.float32).reshape(-1, dim), np.diff(np.frombuffer(b.column("starts")[i].as_py(), np.int32)), axis=0)
                    v = pa.ListArray.from_arrays(np.arange(0, len(ids) * dim + 1, dim, dtype=np.int32), x.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array([b.column("segment")[i].as_py()] * len(ids)), pa.array(range(len(ids)), pa.int32()), ids, v], ["segment", "place", "id", "v"])

        m = self._opened()
        segments = self.segments() if of is None else self.segments().join(of, "segment", "left_semi")
        every = segments.select("segment", "dim", "vectors", "starts", "ids").mapInArrow(run, f"segment long, place int, id {m.kind}, v array<float>")
        if m.dead:
            every = every.join(self._dead(m).select("segment", F.explode("places").alias("place")), ["segment", "place"], "left_anti")
        return every.select("segment", "id", "v")

    def get(self, ids: list) -> DataFrame:
        """(id, v) of living rows by id: only the ids are read of segments that hold none of them."""
        wanted = F.col("id").isin(ids)
        return self.rows(self._places().where(wanted & ~F.col("dead")).select("segment").distinct()).where(wanted).select("id", "v")

    def neighbours(self) -> DataFrame:
        """(segment, level, id, nth, neighbour): the graph as a table, a node by the smallest of its ids."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    levels = np.frombuffer(r["levels"], np.int32)
                    for i, raw in enumerate(r["links"]):
                        own = np.flatnonzero(levels >= i)
                        links = np.frombuffer(raw, np.int32).reshape(len(own), -1)
                        of, nth = np.nonzero(links >= 0)
                        ids = pa.array(r["ids"]).take(pa.array(np.frombuffer(r["starts"], np.int32)[:-1]))
                        yield pa.RecordBatch.from_arrays([pa.array([r["segment"]] * len(of), pa.int64()), pa.array([i] * len(of), pa.int32()), ids.take(pa.array(own[of])),
                                                          pa.array(nth.astype(np.int32)), ids.take(pa.array(links[of, nth]))], ["segment", "level", "id", "nth", "neighbour"])

        kind = self._opened().kind
        return self.segments().select("segment", "levels", "links", "starts", "ids").mapInArrow(run, f"segment long, level int, id {kind}, nth int, neighbour {kind}")

    def hits(self, queries: DataFrame, k: int, width: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", queries_a_block: int = 512,
             exact: bool = False) -> DataFrame:
        """(query_id, segment, id, score, measured): what each segment finds for each query; measured: nodes that it compared.

        With `exact`, what the graph finds tells how near a row must be, and every node of the segment is checked against that, so
        that none of the k nearest is missed."""
        m = self._opened()
        if k <= 0:
            raise SearchError("k must be positive")
        asked = queries.schema[id_col].dataType.simpleString()
        q = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).cast("array<double>").alias("v")).where(V.is_valid("v"))
        q = q.where(F.when(F.size("v") == m.dimension, True).otherwise(F.raise_error(F.format_string(f"the index has dimension {m.dimension}, a query %d", F.size("v"))).cast("boolean")))

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, queries_a_block):
                    part = b.slice(at, queries_a_block)
                    raw = np.asarray(part.column("v").flatten(), np.float64).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, part.num_rows], part.column("query_id")), pa.array([raw], pa.binary())], ["query_ids", "queries"])

        few = q.count() * m.dimension * 8 <= BROADCAST_BYTES  # then segments stay where they are read
        groups = 1 if few else partitions(self.spark)
        dealt = q.mapInArrow(blocks, f"query_ids array<{asked}>, queries binary").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        segments = self.segments().withColumn("g", F.pmod(F.xxhash64("segment"), F.lit(groups)).cast("int"))
        segments = segments.join(self._dead(m), "segment", "left") if m.dead else segments.withColumn("places", F.lit(None).cast("array<int>"))
        metric, dim, kind = m.metric, m.dimension, m.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, s = None, None
            for b in batches:
                for i in range(b.num_rows):
                    r = {c: b.column(c)[i].as_py() for c in ("segment", "vectors", "levels", "links", "starts", "places", "queries")}
                    if r["segment"] != last:
                        levels = np.frombuffer(r["levels"], np.int32)
                        links = [np.frombuffer(raw, np.int32).reshape((levels >= i).sum(), -1) for i, raw in enumerate(r["links"])]
                        s, last = Segment(np.frombuffer(r["vectors"], np.float32).reshape(-1, dim), levels, links, metric, np.frombuffer(r["starts"], np.int32), r["places"] or ()), r["segment"]
                    of, rows, scores, measured = [], [], [], []
                    asked_here = np.frombuffer(r["queries"]).reshape(-1, dim)
                    sizes = np.sqrt((asked_here * asked_here).sum(1))
                    unit = np.divide(asked_here, sizes[:, None], out=asked_here.copy(), where=sizes[:, None] > 0) if metric == "cosine" else asked_here
                    hits = [s.search(v, k, max(k, width)) for v in unit]
                    if exact:
                        least = np.array([got[k - 1][0] if len(got) >= k else -np.inf for got, _ in hits])
                        hits = [(list(zip(near.tolist(), own.tolist())), len(s.x)) for own, near in s.near_enough(unit, least)]
                    for j, (got, cost) in enumerate(hits):
                        found = []
                        for x, node in got:
                            score = round(x, 12) if metric == "cosine" else round(math.sqrt(max(0.0, sizes[j] * sizes[j] - 2 * x)), 9)
                            found += [(score, row) for row in s.rows_of(node, k)]
                        if exact and len(found) > k:
                            ids = b.column("ids")[i].values.take(pa.array([row for _, row in found], pa.int64())).to_pylist()
                            best = sorted(range(len(found)), key=lambda n: (-found[n][0] if metric == "cosine" else found[n][0], ids[n]))
                            found = [found[n] for n in best[:k]]
                        of += [j] * len(found)
                        rows += [row for _, row in found]
                        scores += [score for score, _ in found]
                        measured += [cost] * len(found)
                    yield pa.RecordBatch.from_arrays([b.column("query_ids")[i].values.take(pa.array(of, pa.int64())), pa.array([last] * len(of), pa.int64()),
                                                      b.column("ids")[i].values.take(pa.array(rows, pa.int64())), pa.array(scores, pa.float64()), pa.array(measured, pa.int64())],
                                                     ["query_id", "segment", "id", "score", "measured"])

        return segments.join(F.broadcast(dealt) if few else dealt, "g").mapInArrow(run, f"query_id {asked}, segment long, id {kind}, score double, measured long")

    def search(self, queries: DataFrame, k: int = 12, width: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", exact: bool = False) -> DataFrame:
        """(query_id, rank, id, score): the k nearest found for each query, ties to smaller ids; an empty index has none. With
        `exact`, the k nearest of all: see hits()."""
        metric = self._opened().metric
        near = F.desc("score") if metric == "cosine" else F.asc("score")
        w = Window.partitionBy("query_id").orderBy(near, "id")
        return self.hits(queries, k, width, id_col, vec_col, exact=exact).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    def _opened(self) -> GraphManifest:
        m = self.manifest()
        if m is None:
            raise SearchError("no index has been built")
        return m


def share_measured(hits: DataFrame, rows: int) -> DataFrame:
    """(query_id, share): what part of the rows each query was compared with."""
    return hits.groupBy("query_id", "segment").agg(F.max("measured").alias("n")).groupBy("query_id").agg((F.sum("n") / rows).alias("share"))


def restored(spark: SparkSession, root: str) -> GraphIndex | None:
    """The index that is kept in a folder, if there is one: nothing is built."""
    found = GraphIndex(spark, root)
    return found if found.manifest() else None
