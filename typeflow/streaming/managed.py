"""Managed paths as a stream: arbitrary state for each path, in the order of event time.

A path's state is its count of references and the events that the watermark has not passed yet.  Once it has passed
them they are applied in order, however they came: an addition to a path without state begins its
life, the last removal ends it and clears the state, and a removal from nothing changes nothing and is put out as
an underflow.  Events older than the watermark are dropped by Spark, which counts them.

State lies in RocksDB under the query's checkpoint, so a restarted query goes on where it was, and each
batch's changes replace what an earlier try at the same batch wrote.  All events of one path are handled by one task at a
time, as any keyed state is; its buffer holds only what the watermark has not passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What is put out: ``count`` (references of a path after a batch), ``deleted`` and ``underflow`` (with the event).
KINDS = ("count", "deleted", "underflow")


class PathState(StatefulProcessor):
    """Counts of a path's references, applied in the order of time and event."""

    def init(self, handle) -> None:
        self.handle = handle
        self.refs = handle.getValueState("refs", "refs long")
        self.waiting = handle.getListState("waiting", "at long, event long, delta long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            at = part["at"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList(list(zip(at.tolist(), part["event"].tolist(), part["delta"].tolist())))
        self._wake()
        return iter(())

    def _wake(self) -> None:
        """One timer, at the earliest event that waits."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        first = min((at for at, _, _ in self.waiting.get()), default=None)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(tuple(e) for e in self.waiting.get())
        due = [e for e in events if e[0] <= passed]
        refs = before = self.refs.get()[0] if self.refs.exists() else 0
        out = []
        for _, event, delta in due:
            if delta < 0 and refs == 0:
                out.append(("underflow", event, 0))
                continue
            refs += delta
            if delta < 0 and refs == 0:
                out.append(("deleted", event, 0))
        if refs:
            self.refs.update((refs,))
        elif before:
            self.refs.clear()
        left = events[len(due) :]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        self._wake()
        if due:
            out.append(("count", due[-1][1], refs))
        if out:
            made = pd.DataFrame(out, columns=["kind", "event", "refs"])
            made.insert(0, "path", key[0])
            yield made

    def close(self) -> None:
        pass


def managed_references(events: DataFrame, path: str, at: str, event: str, delta: Column, delay: str = "0 seconds") -> DataFrame:
    """(path, kind, event, refs), a stream of the changes of all paths; see KINDS.

    ``at`` is the event time, ``event`` a number that orders events of equal time; ``delay`` is how late an
    event may come.  Deltas are +1, -1 or 0.  Rows without a time are dropped.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = events.select(F.col(path).alias("path"), F.col(at).cast("timestamp").alias("at"), F.col(event).cast("long").alias("event"), delta.cast("long").alias("delta"))
    rows = rows.where("at IS NOT NULL").withWatermark("at", delay)
    out = StructType().add("path", rows.schema["path"].dataType).add("kind", "string").add("event", "long").add("refs", "long")
    return rows.groupBy("path").transformWithStateInPandas(PathState(), out, "Append", "EventTime")


def start(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """All changes there are now, as Parquet under ``folder``/batch=<number>; a batch that is run again replaces its own."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return changes.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """What has been put out so far: path, kind, event, refs and the number of the batch."""
    return spark.read.option("basePath", folder).parquet(folder)


def tracked(changes: DataFrame) -> DataFrame:
    """(path, refs) of the paths that have references, from the last count of each."""
    last = changes.where("kind = 'count'").groupBy("path").agg(F.max_by("refs", F.struct("batch")).alias("refs"))
    return last.where("refs > 0")
