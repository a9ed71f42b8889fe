"""Progress of builds and streams as rows, and what to do next by them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.encoders import Encoder
from ..sources.store import Checkpoint, IndexStore, Manifest
from . import index_build as B

STATE = "run string, step long, stage string, rows long, total long, message string, at string"


class ProgressTable:
    """States of builds and streams in the store's folder, each a file that is renamed into place."""

    def __init__(self, store: IndexStore):
        self.store = store

    def note(self, run: str, step: int, stage: str, rows: int, total: int = 0, message: str | None = None, at: str = "") -> None:
        self.store._write(f"progress/{run}-{step:09d}.json", {"run": run, "step": step, "stage": stage, "rows": rows, "total": total, "message": message, "at": at})

    def states(self) -> DataFrame:
        spark, fs = self.store.spark, self.store._fs()
        if not fs.exists(self.store._path("progress")):
            return spark.createDataFrame([], STATE)
        return spark.read.schema(STATE).option("multiLine", True).json(f"{self.store.root}/progress")

    def last(self) -> DataFrame:
        """The last state of each run."""
        return self.states().selectExpr("run", "struct(step, stage, rows, total, message, at) s").groupBy("run").agg({"s": "max"}).selectExpr("run", "`max(s)`.*")

    def of_build(self, run: str) -> Callable[[Checkpoint], None]:
        """What to give to build() as its progress."""
        steps = iter(range(1 << 40))
        return lambda c: self.note(run, next(steps), c.stage, c.completed, c.total, c.message)


class StreamProgress(StreamingQueryListener):
    """Notes each micro-batch of a stream by its name or id, and how it ended. Add it with spark.streams.addListener."""

    def __init__(self, table: ProgressTable):
        self.table, self.rows, self.names, self.steps = table, {}, {}, {}

    def _note(self, query, stage: str, message: str | None = None, at: str = "") -> None:
        key = str(query)
        self.steps[key] = step = self.steps.get(key, -1) + 1
        self.table.note(self.names.get(key, key), step, stage, self.rows.get(key, 0), message=message, at=at)

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = f"{event.name or event.id}-{event.runId}"
        self._note(event.runId, "preparing", at=event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        key = str(p.runId)
        self.rows[key] = self.rows.get(key, 0) + p.numInputRows
        self._note(key, "building", at=p.timestamp)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._note(event.runId, "failed" if event.exception else "ready", event.exception and event.exception[:500])


@dataclass(frozen=True)
class BuildState:
    """stage: idle, preparing, building, ready or failed."""

    stage: str
    completed: int = 0
    total: int = 0
    items: int = 0
    message: str | None = None


def current_state(store: IndexStore) -> BuildState:
    """The state to start in, by the checkpoint and the manifest: an unfinished build goes on (as preparing, before its first progress), a
    failure stays one, else what is published is ready."""
    c, m = store.load_checkpoint(), store.load_manifest()
    items = m.item_count if m else 0
    if c and c.stage == "building":
        return BuildState("building" if c.progress is not None else "preparing", c.completed, c.total, items)
    if c and c.stage == "failed":
        return BuildState("failed", c.completed, c.total, items, c.message)
    return BuildState("ready" if m else "idle", items=items)


def start(store: IndexStore, assets: DataFrame, encoder: Encoder, manifest: Manifest, **how) -> BuildState:
    """What a start does: an unfinished build is resumed, a failed one begins again with what it has committed, and otherwise
    nothing is built that is there."""
    state = current_state(store)
    if state.stage in ("building", "preparing"):
        B.resume(store, assets, encoder, manifest, **how)
    elif state.stage in ("failed", "idle"):
        B.build(store, assets, encoder, manifest, **how)
    return current_state(store)
