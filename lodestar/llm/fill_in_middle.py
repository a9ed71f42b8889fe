"""Fill-in-middle transformation by a parallel automaton scan.

An automaton over bytes ends code points and finds markers. What a stretch of bytes does is a function: for each state
the automaton may be in before it, the state after it and the numbers of code points ended and markers found. Such
functions are composed associatively, so stretches are scanned without knowing what came before: lines of `LINE` bytes
side by side in numpy, the chunks of a giant document in different tasks, folded `FAN` at a time. Composition from the
left resolves the state each chunk is entered in, and a cut after k code points is found by descending the folds to the
chunk, the line and the byte it falls in.

Texts of one chunk are scanned and cut where they are read. Longer ones are written as chunks once; only functions, cuts
and, at the end, the chunks of one document are brought together.

Defined results: a null text is empty; an empty text is plain; a null id counts as an empty string in the hashes, and an
id that is no number is given back as null; repeated rows are transformed each, alike for the same id; an empty table gives
no rows; other columns are not read. Texts are UTF-8."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a line, and functions folded at once.
LINE, FAN = 128, 64
#: 0: none; 1: after "<"; 2: after "<P", "<S" or "<M"; 3, 4, 5: one, two, three bytes of a code point to come.
STATES = 6


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte, what happens: next state | 8 if a code point ends | 16 if a marker does, by 6 * class + state).

    The last class is no byte: it changes nothing."""
    kind = np.full(256, 3, np.uint8)
    for k, some in enumerate((b"<", b"PSM", b">")):
        kind[list(some)] = k
    kind[0x80:0xC0], kind[0xC0:0xE0], kind[0xE0:0xF0], kind[0xF0:] = 4, 5, 6, 7
    does = np.empty((9, STATES), np.uint8)
    does[0], does[1], does[2], does[3] = 8 | 1, 8, 8, 8
    does[1, 1], does[2, 2] = 8 | 2, 8 | 16
    does[4] = [0, 0, 0, 8, 3, 4]
    for k in (5, 6, 7):
        does[k] = k - 2
    does[8] = range(STATES)
    return kind, does.ravel()


KIND, DOES = _automaton()


class Scan:
    """Functions of the lines of some chunks, and of the chunks: ends, points and hits, of shape (n, STATES)."""

    def __init__(self, chunks: list[bytes]):
        self.chunks = chunks
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        lines = -(-size // LINE)
        self.first = np.cumsum(lines) - lines
        grid = np.full((int(lines.sum()), LINE), 8, np.uint8)
        flat = grid.reshape(-1)
        for at, c in zip((self.first * LINE).tolist(), chunks):
            flat[at:at + len(c)] = KIND[np.frombuffer(c, np.uint8)]
        self._lines(np.ascontiguousarray(grid.T))
        self._chunks(lines)

    def _lines(self, columns: np.ndarray) -> None:
        n = columns.shape[1]
        state = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], n, 1)
        points, hits = np.zeros((STATES, n), np.int64), np.zeros((STATES, n), np.int64)
        for i, column in enumerate(columns):
            if len(state) > 1 and i % 8 == 0 and (state == state[0]).all():
                state = state[:1]  # from here on all that was before is forgotten: one run serves all
            did = DOES[column * np.uint8(STATES) + state]
            state = did & 7
            points += did >> 3 & 1
            hits += did >> 4
        self.line_ends, self.line_points, self.line_hits = np.broadcast_to(state, (STATES, n)).T, points.T, hits.T

    def _chunks(self, lines: np.ndarray) -> None:
        n = len(lines)
        self.ends = np.repeat(np.arange(STATES)[None], n, 0)
        self.points, self.hits = np.zeros((n, STATES), np.int64), np.zeros((n, STATES), np.int64)
        for i in range(int(lines.max(initial=0))):
            own = np.flatnonzero(lines > i)
            at, now = self.first[own] + i, self.ends[own]
            self.points[own] += np.take_along_axis(self.line_points[at], now, 1)
            self.hits[own] += np.take_along_axis(self.line_hits[at], now, 1)
            self.ends[own] = np.take_along_axis(self.line_ends[at], now, 1)

    def cut(self, i: int, state: int, points: int) -> int:
        """Bytes of chunk i, entered in `state`, up to the end of its code point number `points` (from 1; 0: none)."""
        if points <= 0:
            return 0
        chunk, line = self.chunks[i], int(self.first[i])
        while points > (here := int(self.line_points[line, state])):
            points -= here
            state = int(self.line_ends[line, state])
            line += 1
        at = (line - int(self.first[i])) * LINE
        for at in range(at, len(chunk)):
            did = int(DOES[KIND[chunk[at]] * STATES + state])
            state = did & 7
            points -= did >> 3 & 1
            if not points:
                return at + 1
        raise ValueError("no such code point")


def _short(docs: DataFrame) -> DataFrame:
    """Adds n, marked, and the bytes before the first and the second cut, to docs of one chunk each."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("bytes").to_pylist()
            s = Scan(texts)
            n = s.points[:, 0]
            cuts = np.sort(np.stack([b.column(k).to_numpy() % (n + 1) for k in ("h1", "h2")]), 0)
            found = [[s.cut(i, 0, k) for i, k in enumerate(c.tolist())] for c in cuts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), pa.array(s.hits[:, 0] > 0), *(pa.array(f, pa.int64()) for f in found)],
                                             [*names, "n", "marked", "first", "second"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, schema + ", n long, marked boolean, first long, second long")


def functions_of(parts: DataFrame) -> DataFrame:
    """(row, part, f: struct of ends, points and hits by state) of chunks (row, part, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = Scan(b.column("bytes").to_pylist())
            lists = [pa.array(list(x.astype(np.int64)), pa.list_(pa.int64())) for x in (s.ends, s.points, s.hits)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("part"), *lists], ["row", "part", "ends", "points", "hits"])

    return parts.select("row", "part", "bytes").mapInArrow(run, "row long, part long, ends array<long>, points array<long>, hits array<long>").select(
        "row", "part", F.struct("ends", "points", "hits").alias("f"))


def _at(values: Column, i: Column) -> Column:
    return F.get(values, i.cast("int"))


def composed(fs: Column) -> Column:
    """One function for an array of functions in order."""
    same = F.array(*(F.lit(i).cast("long") for i in range(STATES)))
    none = F.array_repeat(F.lit(0).cast("long"), STATES)

    def then(a: Column, b: Column) -> Column:
        more = lambda k: F.zip_with(a[k], a["ends"], lambda n, s: n + _at(b[k], s))
        return F.struct(F.transform(a["ends"], lambda s: _at(b["ends"], s)).alias("ends"), more("points").alias("points"), more("hits").alias("hits"))

    return F.aggregate(fs, F.struct(same.alias("ends"), none.alias("points"), none.alias("hits")), then)


def folded(level: DataFrame) -> DataFrame:
    """The functions of FAN neighbours each, with those of the neighbours: (row, part, f, inner)."""
    inner = F.array_sort(F.collect_list(F.struct("part", "f")))
    return level.groupBy("row", F.floor(F.col("part") / FAN).alias("above")).agg(inner.alias("inner")).select(
        "row", F.col("above").alias("part"), composed(F.transform("inner", lambda x: x["f"])).alias("f"), "inner")


def entered(inner: Column, state: Column, before: Column, points: Column) -> Column:
    """Of neighbours in order, entered in `state` after `before` code points: the one that ends code point number `points`
    (the first for none), with the state and the code points it is entered with."""
    start = F.struct(F.lit(None).cast("long").alias("part"), state.alias("state"), before.alias("before"))

    def step(a: Column, x: Column) -> Column:
        after = a["before"] + _at(x["f"]["points"], a["state"])
        here = F.struct(x["part"].alias("part"), a["state"].alias("state"), a["before"].alias("before"))
        on = F.struct(F.lit(None).cast("long").alias("part"), _at(x["f"]["ends"], a["state"]).alias("state"), after.alias("before"))
        return F.when(a["part"].isNotNull(), a).when(after >= points, here).otherwise(on)

    return F.aggregate(inner, start, step)


def _long(docs: DataFrame, chunk: int) -> DataFrame | None:
    """As _short, of docs of any length: chunks, folds, descents and cuts are tables. None: there are none."""
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.octet_length("bytes") - 1) / chunk)),
                         lambda i: F.substring(F.col("bytes"), (i * chunk + 1).cast("int"), F.lit(chunk)))
    parts = written(numbered.select("row", *(c for c in docs.columns if c != "bytes"), F.posexplode(pieces).alias("part", "bytes")).withColumn(
        "part", F.col("part").cast("long")), "parts")
    most = parts.agg(F.max("part")).first()[0]
    if most is None:
        return None
    levels = [written(functions_of(parts), "functions")]
    while most > 0:
        levels.append(written(folded(levels[-1]), "functions"))
        most //= FAN
    heads = parts.where("part = 0").select("row", *(c for c in docs.columns if c != "bytes"))
    total = levels[-1].select("row", _at(F.col("f.points"), F.lit(0)).alias("n"), (_at(F.col("f.hits"), F.lit(0)) > 0).alias("marked"))
    heads = written(heads.join(total, "row").withColumn("k", F.array(*(F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")))), "heads")
    zero = F.lit(0).cast("long")
    cuts = heads.select("row", F.explode(F.array_distinct("k")).alias("k")).select("row", "k", zero.alias("part"), zero.alias("state"), zero.alias("before"))
    for level in levels[:0:-1]:
        cuts = cuts.join(level.select("row", "part", "inner"), ["row", "part"]).select(
            "row", "k", entered(F.col("inner"), F.col("state"), F.col("before"), F.col("k")).alias("to")).select("row", "k", "to.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = Scan(b.column("bytes").to_pylist())
            state, k, part = (b.column(c).to_pylist() for c in ("state", "points", "part"))
            at = [p * chunk + s.cut(i, x, n) for i, (p, x, n) in enumerate(zip(part, state, k))]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(at, pa.int64())], ["row", "at"])

    places = cuts.join(parts.select("row", "part", "bytes"), ["row", "part"]).select("row", "part", "state", (F.col("k") - F.col("before")).alias("points"), "bytes").mapInArrow(
        run, "row long, at long").groupBy("row").agg(F.min("at").alias("first"), F.max("at").alias("second"))
    whole = parts.groupBy("row").agg(F.expr("listagg(bytes) within group (order by part)").alias("bytes"))
    return heads.join(places, "row").join(whole, "row").select(*docs.columns, "n", "marked", "first", "second")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", keep: int = 10, spm: int = 20,
                   chunk: int = 1 << 15) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each document: plain texts as they are (`keep` in a hundred,
    and those that hold a marker), others with prefix, suffix and middle after their markers, `spm` in a hundred of them
    suffix first."""
    if chunk % LINE:
        raise ValueError(f"chunk must be a multiple of {LINE}")
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = own.select(F.col("_id").try_cast("long").alias("doc_id"), *hashes, F.col("_text").cast("binary").alias("bytes"))
    done = _short(rows.where(F.octet_length("bytes") <= chunk))
    if (more := _long(rows.where(F.octet_length("bytes") > chunk), chunk)) is not None:
        done = done.unionByName(more)
    form = F.when((F.col("n") == 0) | F.col("marked") | (F.col("h3") % 100 >= 100 - keep), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    d = done.withColumn("form", form)
    a, b = (f(*(F.col(h) % (F.col("n") + 1) for h in ("h1", "h2"))) for f in (F.least, F.greatest))
    mark = {k: F.lit(k).cast("binary") for k in (PREFIX, SUFFIX, MIDDLE)}
    one, two, size = F.col("first").cast("int"), F.col("second").cast("int"), F.octet_length("bytes")
    part = {PREFIX: F.substring("bytes", F.lit(1), one), MIDDLE: F.substring("bytes", one + 1, two - one), SUFFIX: F.substring("bytes", two + 1, size - two)}
    put = lambda *ks: F.concat(*(x for k in ks for x in (mark[k], part[k])))
    output = F.when(F.col("form") == "plain", F.col("bytes")).when(F.col("form") == "spm", put(SUFFIX, PREFIX, MIDDLE)).otherwise(put(PREFIX, SUFFIX, MIDDLE))
    plain = F.col("form") == "plain"
    return d.select("doc_id", "n", "form", F.when(~plain, a).alias("prefix_chars"), F.when(~plain, b - a).alias("middle_chars"), output.cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that `output` was made of: no marker occurs in what is between the markers."""
    after = lambda mark: F.substring_index(output, mark, -1)
    between = lambda start, end: F.substring_index(after(start), end, 1)
    middle = after(MIDDLE)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def digest(done: DataFrame) -> DataFrame:
    """The result of fill_in_middle with checksums of the output and of the text rebuilt from it."""
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = """
with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id::varchar) as h from documents),
u as (select *, length(text) as n, ('0x' || substr(h, 1, 8))::ubigint as h1, ('0x' || substr(h, 9, 8))::ubigint as h2,
  ('0x' || substr(h, 17, 8))::ubigint as h3, ('0x' || substr(h, 25, 8))::ubigint as h4 from t),
v as (select *, least(h1 % (n + 1)::ubigint, h2 % (n + 1)::ubigint)::bigint as a, greatest(h1 % (n + 1)::ubigint, h2 % (n + 1)::ubigint)::bigint as b,
  case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
    when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
w as (select *, case form when 'plain' then text
  when 'psm' then '<P>' || substring(text, 1, a) || '<S>' || substring(text, b + 1) || '<M>' || substring(text, a + 1, b - a)
  else '<S>' || substring(text, b + 1) || '<P>' || substring(text, 1, a) || '<M>' || substring(text, a + 1, b - a) end as output from v)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(output) as output_sha256, sha256(text) as restored_sha256 from w"""
