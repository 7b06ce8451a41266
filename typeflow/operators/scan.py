"""An associative scan of reference ledgers.

A run of +1 and -1 events takes a count x to max(x + s, s - m), where s is the run's sum and m the least of its
partial sums (or 0): a removal from nothing fails and changes nothing.  Such maps combine to maps of
the same form, so a ledger is cut into bins, each bin is summed by itself, and the bins of a path are combined in
order.  Bins are ranges of (path, order) of like size, whatever the paths: one with very many events is
cut into many bins, and a bin has at most one path that goes on from the bin before.  So what is carried
from bin to bin is at most two rows a bin, which are broadcast.

A path's life begins when a reference is added to a path that has none and ends when the last one goes.
Counts from different starts agree from the time the lower one reaches nothing, so the lives that begin in a
bin are those of a start from nothing, less those before that time: one number for each bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import checkpointed

#: Events of a bin, about; a ledger of no more is one bin.
BIN_ROWS = 1_000_000
#: Bins at most, so that what is carried between them can be broadcast.
MOST_BINS = 20_000


def scanned(ledger: DataFrame, path: str, delta: Column, order: list[str], bin: Column | None = None, bin_rows: int = BIN_ROWS) -> DataFrame:
    """The ledger's columns with, for each event in its path's order:

    ``running``, the plain sum of all deltas so far; ``before`` and ``count``, the references before and after it when
    removals from nothing fail; ``failed``, true for such a removal; ``life``, how many lives of the path
    have begun.  Deltas are +1, -1 or 0 (``running`` takes any).  A null path is a path.  ``bin`` gives bins
    of the caller's own, which must grow with ``order``.
    """
    events = ledger.withColumn("__delta", delta.cast("long"))
    bins = 1 if bin is not None else min(max(1, -(-events.count() // bin_rows)), MOST_BINS)
    if bin is not None:
        events = events.withColumn("__bin", bin)
    elif bins > 1:
        events = events.repartitionByRange(bins, path, *order).withColumn("__bin", F.spark_partition_id())
    else:
        events = events.withColumn("__bin", F.lit(0))
    own = Window.partitionBy("__bin", path).orderBy(*order)
    so_far, earlier = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    events = events.withColumn("__sum", F.sum("__delta").over(so_far))
    events = events.withColumns({"__least": F.min("__sum").over(so_far), "__lower": F.min("__sum").over(earlier)})
    born = (F.col("__delta") > 0) & (F.col("__sum") - F.col("__delta") == F.least(F.lit(0), F.coalesce("__lower", F.lit(0))))
    events = events.withColumn("__births", F.sum(born.cast("long")).over(so_far))
    if bin is None and bins == 1:
        return _counted(events, ledger.columns, F.lit(0), F.lit(0), F.lit(0), F.lit(0))
    events = checkpointed(events)
    carried = _carried(events, path)
    near = F.broadcast if bin is None else (lambda df: df)
    same = F.col("__bin").eqNullSafe(F.col("__at")) & F.col(path).eqNullSafe(F.col("__of"))
    joined = events.join(near(carried), same, "left")
    value = lambda name: F.coalesce(name, F.lit(0))
    return _counted(joined, ledger.columns, value("__past"), value("__start"), value("__skipped"), value("__lives"))


def _carried(events: DataFrame, path: str) -> DataFrame:
    """For the bins of paths that have several: the sum and the count before the bin, and the lives begun before it and not in it."""
    own = events.groupBy("__bin", path).agg(F.sum("__delta").alias("__s"), F.min("__sum").alias("__m"), F.max("__births").alias("__b"))
    whole = Window.partitionBy(path)
    earlier = whole.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    past = own.withColumns({"__past": F.coalesce(F.sum("__s").over(earlier), F.lit(0)), "__bins": F.count("*").over(whole)})
    lowest = F.least(F.coalesce(F.min(F.col("__past") + F.col("__m")).over(earlier), F.lit(0)), F.lit(0))
    split = past.withColumn("__start", F.col("__past") - lowest).where("__bins > 1")
    split = checkpointed(split.select(F.col("__bin").alias("__at"), F.col(path).alias("__of"), "__past", "__start", "__b"))
    # lives that a start from nothing begins before the true count has come down to nothing
    same = F.col("__bin").eqNullSafe(F.col("__at")) & F.col(path).eqNullSafe(F.col("__of"))
    apart = F.least(F.coalesce("__lower", F.lit(0)), F.lit(0)) > -F.col("__start")
    above = events.join(split.where("__start > 0"), same).where(apart).groupBy("__at", "__of").agg(F.max("__births").alias("__skipped"))
    above = above.select(F.col("__at").alias("__a"), F.col("__of").alias("__o"), "__skipped")
    both = split.join(above, F.col("__at").eqNullSafe(F.col("__a")) & F.col("__of").eqNullSafe(F.col("__o")), "left").withColumn("__skipped", F.coalesce("__skipped", F.lit(0)))
    before = Window.partitionBy("__of").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    lives = F.coalesce(F.sum(F.col("__b") - F.col("__skipped")).over(before), F.lit(0))
    return checkpointed(both.select("__at", "__of", "__past", "__start", "__skipped", lives.alias("__lives")))


def _counted(events: DataFrame, columns: list[str], past: Column, start: Column, skipped: Column, lives: Column) -> DataFrame:
    lowest = lambda least: F.least(F.coalesce(start + F.col(least), F.lit(0)), F.lit(0))
    before = start + F.col("__sum") - F.col("__delta") - lowest("__lower")
    return events.select(
        *columns,
        (past + F.col("__sum")).cast("long").alias("running"),
        before.cast("long").alias("before"),
        (start + F.col("__sum") - lowest("__least")).cast("long").alias("count"),
        ((F.col("__delta") < 0) & (before == 0)).alias("failed"),
        (lives + F.greatest(F.col("__births") - skipped, F.lit(0))).cast("long").alias("life"),
    )


def lives(events: DataFrame, path: str, event: str) -> DataFrame:
    """(path, life, born, died, peak): every life in scanned ``events``, with the events that begin and end it; one that goes on has no end."""
    alive = events.where((F.col("before") > 0) | (F.col("count") > 0))
    return alive.groupBy(path, "life").agg(
        F.max(F.when(F.col("before") == 0, F.col(event))).alias("born"),
        F.max(F.when(F.col("count") == 0, F.col(event))).alias("died"),
        F.max("count").alias("peak"),
    )
