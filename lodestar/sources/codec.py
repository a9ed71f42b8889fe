"""The binary index file: a little-endian header of 36 bytes, a JSON table of rows padded to 4 bytes, a float32 matrix."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The header's layout (magic, version, dimension, rows, bytes of the table, CRC-32 of what follows, reserved).
HEADER, MAGIC, VERSION = "<4sIIQQII", bytes([0x50, 0x53, 0x49, 0x58]), 1
SIZE = struct.calcsize(HEADER)
ENTRY = "asset_id string, fingerprint string, embedding array<float>, created_at timestamp, updated_at timestamp"


class CorruptIndex(ValueError):
    """An index file that doesn't hold what its header says."""


def encode(rows: list[dict], dim: int) -> bytes:
    """rows: asset_id, fingerprint, embedding, created_at and updated_at in milliseconds since 1970."""
    table = json.dumps([{"id": r["asset_id"], "fingerprint": r["fingerprint"], "createdAt": r["created_at"], "updatedAt": r["updated_at"]} for r in rows],
                       ensure_ascii=False).encode()
    matrix = np.array([r["embedding"] for r in rows], "<f4")
    if rows and matrix.shape != (len(rows), dim):
        raise CorruptIndex("a vector has another dimension")
    body = table + bytes(-len(table) % 4) + matrix.tobytes()
    return struct.pack(HEADER, MAGIC, VERSION, dim, len(rows), len(table), zlib.crc32(body), 0) + body


def decode(raw: bytes) -> tuple[list[dict], np.ndarray]:
    """(rows of the table, matrix), after checking everything that the header says."""
    if len(raw) < SIZE:
        raise CorruptIndex("too short for a header")
    magic, version, dim, n, size, crc, _ = struct.unpack_from(HEADER, raw)
    if magic != MAGIC:
        raise CorruptIndex("not an index file")
    if version != VERSION:
        raise CorruptIndex(f"version {version} is not supported")
    if dim <= 0:
        raise CorruptIndex("no dimension")
    start = SIZE + size + -size % 4
    if len(raw) != start + 4 * n * dim:
        raise CorruptIndex("wrong length")
    if zlib.crc32(raw[SIZE:]) != crc:
        raise CorruptIndex("checksum differs")
    try:
        rows = json.loads(raw[SIZE:SIZE + size])
    except ValueError as e:
        raise CorruptIndex("the table of rows can't be read") from e
    if len(rows) != n:
        raise CorruptIndex("the table has another number of rows")
    return rows, np.frombuffer(raw, "<f4", n * dim, start).reshape(n, dim)


def row_vector(raw: bytes, row: int) -> np.ndarray:
    """One row's vector without reading the table."""
    _, _, dim, n, size, _, _ = struct.unpack_from(HEADER, raw)
    if not 0 <= row < n:
        raise IndexError(row)
    return np.frombuffer(raw, "<f4", dim, SIZE + size + -size % 4 + 4 * dim * row)


def decoded(files: DataFrame) -> DataFrame:
    """Index entries of encoded files (content: binary), decoded where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content").to_pylist():
                rows, x = decode(raw)
                stamp = lambda k: pa.array([int(r[k]) * 1000 for r in rows], pa.timestamp("us", "UTC"))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array([r["id"] for r in rows], pa.string()), pa.array([r["fingerprint"] for r in rows], pa.string()),
                                                  pa.array(list(x), pa.list_(pa.float32())), stamp("createdAt"), stamp("updatedAt")],
                                                 ["asset_id", "fingerprint", "embedding", "created_at", "updated_at"])

    return files.select("content").mapInArrow(run, ENTRY)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark.read.format("binaryFile").load(path))


def encoded_files(entries: DataFrame, dim: int) -> DataFrame:
    """(file: binary), one encoded index file for each batch of entries: batches are bounded, so any index can be exported."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                r["created_at"], r["updated_at"] = (round(r[k].timestamp() * 1000) for k in ("created_at", "updated_at"))
            yield pa.RecordBatch.from_arrays([pa.array([encode(rows, dim)], pa.binary())], ["file"])

    return entries.select("asset_id", "fingerprint", "embedding", "created_at", "updated_at").mapInArrow(run, "file binary")


def tensor(raw: bytes, shape: tuple[int, ...]) -> np.ndarray:
    """A file of little-endian float32 numbers."""
    return np.frombuffer(raw, "<f4").reshape(shape)
