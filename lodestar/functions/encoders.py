"""Encoders that a user plugs in, and cached embedding of payloads."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V


@dataclass(frozen=True)
class Descriptor:
    model_id: str
    version: str
    display_name: str
    dimension: int
    image_size: int = 224
    context_length: int = 52

    def fingerprint(self) -> str:
        return "|".join(map(str, (self.model_id, self.version, self.dimension, self.image_size, self.context_length)))


class Encoder(Protocol):
    """Loaded once in each worker, then given batches of payloads; vectors come out as they are, not normalised."""

    descriptor: Descriptor

    def load(self) -> None: ...

    def encode(self, payloads: list[bytes]) -> np.ndarray: ...


class HashingEncoder:
    """A deterministic stand-in: words are hashed to signed components. It tells nothing of meaning."""

    def __init__(self, dimension: int = 64):
        self.descriptor = Descriptor("hashing", "1", "Hashing", dimension)

    def load(self) -> None:
        pass

    def encode(self, payloads: list[bytes]) -> np.ndarray:
        out = np.zeros((len(payloads), self.descriptor.dimension), np.float32)
        for i, p in enumerate(payloads):
            for w in p.lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % out.shape[1]] += 1 if h >> 63 else -1
            if not out[i].any():
                out[i, 0] = 1
        return out


class NoEncoder:
    """Where no model is installed: every call fails."""

    descriptor = Descriptor("none", "0", "None", 0)

    def load(self) -> None:
        raise NotImplementedError("no encoder is installed")

    def encode(self, payloads: list[bytes]) -> np.ndarray:
        raise NotImplementedError("no encoder is installed")


class LetterEncoder:
    """A deterministic stand-in that SQL can follow: how often each of the letters a to z occurs."""

    def __init__(self):
        self.descriptor = Descriptor("letters", "1", "Letters", 26)

    def load(self) -> None:
        pass

    def encode(self, payloads: list[bytes]) -> np.ndarray:
        out = np.array([np.bincount(np.frombuffer(p, np.uint8), minlength=256)[97:123] for p in payloads], np.float32).reshape(-1, 26)
        out[~out.any(1), 0] = 1
        return out


class Loader:
    """The encoder of one worker process: idle, loading, ready or failed. It is loaded by the first task that needs it and serves
    the later ones; a load that failed is tried again by the next task."""

    def __init__(self):
        self.state, self.encoder, self.error = "idle", None, None

    def get(self, encoder: Encoder) -> Encoder:
        if self.state != "ready":
            self.state, self.error = "loading", None
            try:
                encoder.load()
            except Exception as e:
                self.state, self.error = "failed", e
                raise
            self.state, self.encoder = "ready", encoder
        return self.encoder


_LOADERS: dict[tuple, Loader] = {}


def loader_of(encoder: Encoder) -> Loader:
    """This process's loader for encoders of the type, description and settings (`key`, where an encoder has one)."""
    kind = (type(encoder).__module__, type(encoder).__qualname__, encoder.descriptor.fingerprint(), getattr(encoder, "key", None))
    return _LOADERS.setdefault(kind, Loader())


def _vectors(x: np.ndarray, rows: int, dim: int) -> np.ndarray:
    """What an encoder returned, cut to its dimension, checked and brought to unit length."""
    x = np.asarray(x, np.float64)[:, :dim]
    if x.shape != (rows, dim) or not np.isfinite(x).all():
        raise ValueError("the encoder returned no vectors of its dimension")
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.where((abs(n - 1) < V.UNIT_TOLERANCE) | (n == 0), x, x / np.where(n == 0, 1, n)).astype(np.float32)


def embed(rows: DataFrame, payload_col: str, encoder: Encoder, size: int = 256, keep_failures: bool = False) -> DataFrame:
    """Adds embedding: validated (dimension, finite), then brought to unit length. Payloads are given to the encoder `size` at
    a time. A failure ends the job; with keep_failures, the payloads of that call are tried one by one, and those that fail
    have a null embedding and their message in another column, error."""
    dim = encoder.descriptor.dimension

    def some(own: Encoder, payloads: list[bytes]) -> tuple[list, list]:
        try:
            return list(_vectors(own.encode(payloads), len(payloads), dim)), [None] * len(payloads)
        except Exception as e:
            if not keep_failures:
                raise
            if len(payloads) == 1:
                return [None], [str(e)[:500] or type(e).__name__]
        each = [some(own, [p]) for p in payloads]
        return [x[0][0] for x in each], [x[1][0] for x in each]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = loader_of(encoder).get(encoder) if b.num_rows else encoder  # only if there is something to encode
            payloads = [bytes(p or b"") for p in b.column(payload_col).to_pylist()]
            x, errors = [], []
            for at in range(0, len(payloads), size):
                got = some(own, payloads[at:at + size])
                x += got[0]
                errors += got[1]
            cols = [*b.columns, pa.array(x, pa.list_(pa.float32()))] + [pa.array(errors, pa.string())] * keep_failures
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, "embedding"] + ["error"] * keep_failures)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, schema + ", embedding array<float>" + ", error string" * keep_failures)


def cached_embed(rows: DataFrame, payload_col: str, cache: DataFrame, encoder: Encoder) -> tuple[DataFrame, DataFrame]:
    """(rows with fingerprint and embedding, what to add to the cache): each distinct payload that the cache (fingerprint,
    embedding) lacks is encoded once."""
    keyed = rows.withColumn("fingerprint", F.sha2(F.col(payload_col), 256))
    miss = keyed.select("fingerprint", payload_col).dropDuplicates(["fingerprint"]).join(cache.select("fingerprint"), "fingerprint", "left_anti")
    new = embed(miss, payload_col, encoder).select("fingerprint", "embedding")
    return keyed.join(cache.select("fingerprint", "embedding").unionByName(new), "fingerprint"), new
