"""Search histories kept as the state of a stream: a list for each user, newest first.

An addition puts a trimmed query first, in place of an equal one, and the list is cut after `keep`; a deletion takes out the entry
of an id; a clearing all. What a user did is taken in the order of time within a micro-batch, and micro-batches follow
each other, so a source should be read with a bound on what it gives at once. Lists that changed are written batch by batch, and
a batch that is done over replaces itself."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import texts as T
from ..operators.catalog_ops import HISTORY

ENTRY = "id string, query string, results int, at timestamp"
#: user; op: add, delete or clear; id: of the entry that is added or deleted; at: when.
COMMAND = "user string, op string, id string, query string, results int, at timestamp"
LISTS = f"user string, entries array<struct<{', '.join(f.replace(' ', ':', 1) for f in ENTRY.split(', '))}>>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def applied(entries: list[tuple], commands: list, keep: int = HISTORY) -> list[tuple]:
    """The list of (id, query, results, at), newest first, after commands in the order of time."""
    for c in sorted(commands, key=lambda c: (c.at, c.id or "")):
        if c.op == "clear":
            entries = []
        elif c.op == "delete":
            entries = [e for e in entries if e[0] != c.id]
        elif c.op == "add" and c.query:
            entries = [(c.id, c.query, c.results, c.at), *(e for e in entries if e[1] != c.query)][:keep]
    return entries


class Histories(StatefulProcessor):
    def __init__(self, keep: int = HISTORY):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", ENTRY)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = applied([tuple(e) for e in self.entries.get()], list(rows), self.keep)
        self.entries.clear()
        if now:
            self.entries.put(now)
        yield Row(user=key[0], entries=[Row(id=i, query=q, results=n, at=at) for i, q, n, at in now])

    def close(self) -> None:
        pass


def keep_histories(commands: DataFrame, root: str, keep: int = HISTORY):
    """Runs a stream of commands (COMMAND) over the states in `root` as far as it goes. Returns the query."""
    spark = commands.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    tidy = commands.where("user is not null and at is not null").withColumn("query", T.trimmed(F.col("query")))
    lists = tidy.groupBy("user").transformWithState(Histories(keep), LISTS, "Update", "None")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/lists/batch={number}")

    return lists.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()


def histories(spark: SparkSession, root: str) -> DataFrame:
    """(user, nth, id, query, results, at): every user's list as it is, newest first from 0; an empty list has no rows."""
    lists = spark.read.schema(LISTS + ", batch long").option("basePath", f"{root}/lists").parquet(f"{root}/lists")
    now = lists.groupBy("user").agg(F.max_by("entries", "batch").alias("entries"))
    return now.select("user", F.posexplode("entries").alias("nth", "e")).select("user", "nth", "e.*")
