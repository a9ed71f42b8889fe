"""Index files as a data source, `spark.read.format("index_files")`, and their checksums as a job.

Headers alone are read to plan: a partition is a range of rows of a file, or, where ids are asked for, a file, whose table of ids
is read before the rows that it names are, each by its offset. Tasks open files themselves, so they must lie in a folder
that driver and executors mount alike (file:); for other stores there is codec.read_files, which reads whole files.

Writing, each task fills files of a bounded number of rows under hidden names, which the driver renames when all tasks are done;
of a job that fails nothing stays."""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.checksums import merged
from .codec import ENTRY, HEADER, MAGIC, SIZE, VERSION, CorruptIndex, encode

SUFFIX = ".index"
NAMES = ["asset_id", "fingerprint", "embedding", "created_at", "updated_at"]


def local(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if ":" in path.split("/")[0]:
        raise ValueError(f"index files must be in a mounted folder, not in {path}")
    return path


def files_of(path: str) -> list[str]:
    path = local(path)
    if os.path.isfile(path):
        return [path]
    return sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(SUFFIX) and not n.startswith("."))


class IndexFile:
    """A file read by offsets; `read` counts the bytes."""

    def __init__(self, path: str):
        self.path, self.read, self.file = path, 0, open(path, "rb")  # noqa: SIM115
        raw = self.at(0, SIZE)
        if len(raw) < SIZE:
            raise CorruptIndex("too short for a header")
        magic, version, self.dim, self.rows, self.table, self.crc, _ = struct.unpack(HEADER, raw)
        if magic != MAGIC or version != VERSION or self.dim <= 0:
            raise CorruptIndex("not an index file of this version")
        self.start = SIZE + self.table + -self.table % 4
        if os.path.getsize(path) != self.start + 4 * self.rows * self.dim:
            raise CorruptIndex("wrong length")

    def at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        got = self.file.read(size)
        self.read += len(got)
        return got

    def ids(self) -> list[dict]:
        rows = json.loads(self.at(SIZE, self.table))
        if len(rows) != self.rows:
            raise CorruptIndex("the table has another number of rows")
        return rows

    def vectors(self, first: int, last: int) -> np.ndarray:
        """Of the rows from first to last - 1."""
        if not 0 <= first <= last <= self.rows:
            raise IndexError(first)
        return np.frombuffer(self.at(self.start + 4 * self.dim * first, 4 * self.dim * (last - first)), "<f4").reshape(-1, self.dim)

    def __enter__(self) -> IndexFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    last: int
    ids: tuple[str, ...] | None = None

    def __post_init__(self):
        super().__init__(None)


def _batch(table: list[dict], x: np.ndarray) -> pa.RecordBatch:
    stamp = lambda k: pa.array([int(r[k]) * 1000 for r in table], pa.timestamp("us", "UTC"))
    v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype(np.float32).ravel()))
    return pa.RecordBatch.from_arrays([pa.array([r["id"] for r in table], pa.string()), pa.array([r["fingerprint"] for r in table], pa.string()), v,
                                       stamp("createdAt"), stamp("updatedAt")], NAMES)


class IndexReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.a_part, self.ids = options["path"], int(options.get("rowsapartition", 1 << 16)), None

    def pushFilters(self, filters: list[Filter]):
        """Ids that are asked for are looked for in the files' tables; all else is left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("asset_id",):
                some = {f.value}
            elif isinstance(f, In) and f.attribute == ("asset_id",):
                some = set(f.value)
            else:
                yield f
                continue
            self.ids = some if self.ids is None else self.ids & some

    def partitions(self) -> list[Rows]:
        out = []
        for path in files_of(self.path):
            with IndexFile(path) as f:
                if self.ids is not None:
                    out.append(Rows(path, 0, f.rows, tuple(self.ids)))
                else:
                    out += [Rows(path, at, min(at + self.a_part, f.rows)) for at in range(0, f.rows, self.a_part)]
        return out or [Rows("", 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.path:
            with IndexFile(part.path) as f:
                yield from self.rows(f, part)

    @staticmethod
    def rows(f: IndexFile, part: Rows, a_batch: int = 4096) -> Iterator[pa.RecordBatch]:
        table = f.ids()
        if part.ids is not None:
            wanted = set(part.ids)
            for i, r in enumerate(table):
                if r["id"] in wanted:
                    yield _batch([r], f.vectors(i, i + 1))
            return
        for at in range(part.first, part.last, a_batch):
            end = min(at + a_batch, part.last)
            yield _batch(table[at:end], f.vectors(at, end))


@dataclass
class Written(WriterCommitMessage):
    hidden: list[str]


class IndexWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.dim, self.a_file, self.overwrite = local(options["path"]), int(options["dimension"]), int(options.get("rowsafile", 1 << 16)), overwrite
        os.makedirs(self.path, exist_ok=True)

    def write(self, rows: Iterator) -> Written:
        hidden, held = [], []

        def put() -> None:
            name = os.path.join(self.path, f".{uuid.uuid4().hex}{SUFFIX}")
            hidden.append(name)
            with open(name, "wb") as f:
                f.write(encode(held, self.dim))

        for r in rows:
            held.append({k: round(r[k].timestamp() * 1000) if k.endswith("_at") else r[k] for k in NAMES})
            if len(held) == self.a_file:
                put()
                held = []
        if held:
            put()
        return Written(hidden)

    def commit(self, messages: list[Written | None]) -> None:
        old = files_of(self.path) if self.overwrite else []
        for m in filter(None, messages):
            for name in m.hidden:
                os.replace(name, os.path.join(self.path, os.path.basename(name)[1:]))
        for name in old:
            os.remove(name)

    def abort(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            for name in m.hidden:
                if os.path.exists(name):
                    os.remove(name)


class IndexFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "index_files"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema: StructType) -> IndexReader:
        return IndexReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> IndexWriter:
        return IndexWriter(self.options, overwrite)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Entries of the index files in a folder, or of one file."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexFiles)
    return spark.read.format("index_files").options(**options).load(path)


def write(entries: DataFrame, path: str, dimension: int, mode: str = "append", **options) -> None:
    entries.sparkSession.dataSource.register(IndexFiles)
    entries.select(*NAMES).write.format("index_files").mode(mode).options(dimension=dimension, **options).save(path)


def verified(spark: SparkSession, path: str, part: int = 8 << 20) -> DataFrame:
    """(file, bytes, expected, crc32, ok): checksums of all that follows the headers, read in parts of a bounded size by as many
    tasks as there are parts, whichever file they belong to."""
    todo = []
    for name in files_of(path):
        with IndexFile(name) as f:
            end = f.start + 4 * f.rows * f.dim
            todo += [(name, at, min(part, end - at), f.crc) for at in range(SIZE, max(end, SIZE + 1), part)]
    rows = spark.createDataFrame(todo, "file string, at long, size long, expected long").repartition(max(1, len(todo)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                with open(r["file"], "rb") as f:
                    f.seek(r["at"])
                    yield pa.RecordBatch.from_pylist([r | {"data": f.read(r["size"])}])

    parts = rows.mapInArrow(run, "file string, at long, size long, expected long, data binary").withColumn("offset", F.col("at") - SIZE)
    return merged(parts, ["file", "expected"], "offset", "data").withColumn("ok", F.col("crc32") == F.col("expected"))


def checksum(raw: bytes) -> int:
    return zlib.crc32(raw[SIZE:])
