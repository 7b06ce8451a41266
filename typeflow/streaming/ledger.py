"""The reference ledger as a stream (an addition of this library)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_references(events: DataFrame, path: str, delta: Column) -> DataFrame:
    """(path, refs) over a stream of ledger events; run it in complete or update mode."""
    return events.groupBy(path).agg(F.sum(delta).cast("long").alias("refs"))


def start(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The counts of all events there are now, as Parquet files at ``path``."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
