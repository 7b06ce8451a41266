"""Sharding by balanced label propagation.

Documents and link groups form a bipartite graph: each document of a group (equal texts, for
``shard``) has one edge to the group's hub.  Hubs take the label that most of their documents
carry among the labels whose quota holds them whole, and the documents take their hub's label.
Quotas are of final counts, so what comes into a shard and what leaves it offset each other.
Documents without links weigh nothing in the cut, so they only fill what room the linked ones
leave.  Counts end at most one apart (law ``rows``).

Large groups, at most one for 1 / (SHARDS * SLICE_PART) of all rows or HOT_ROWS rows, are served first, the largest
before the others.  All other groups vote one by one, at any number of rows: in each round every group that waits asks for
the label with most votes among those that still have room for it, and a shard grants what it is asked for in a hashed order,
as far as its quota reaches.  Groups that were not granted ask again with the quotas that are left.  Groups
that no quota holds any more are dealt in hashed bins, in finer ones in later rounds; only a group that no quota holds
is split, by ranks, over as few shards as hold it.  A document has one group, so
the cut can fall no more once no group waits, and the rounds end.

Work is bounded per task: ranks and votes come from counts per hashed bin.  A group of more than
HOT_ROWS rows, or than 1 / (SHARDS * SLICE_PART) of all, is never shuffled by its key: what is known
of it is broadcast, at most one row for that many rows.  Rows without links take part in no join.
All of it is joins, aggregates and windows over hashed bins; a row's bin follows from its doc_id, its
text and a number of its own, so equal rows spread too.

Defined cases: a null text has no bytes (size 1, crc of nothing) and no links; a very long text
counts with all its bytes and is hashed before any shuffle; a null doc_id is placed like any other
row; repeated rows are placed each; an empty table gives no rows; columns besides doc_id and text
are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_ROWS, settle, table

SHARDS = 16
ROUNDS = 8
#: Rounds in which groups ask for labels.
ASKS = 12
#: Hashed bins in which groups are dealt that no quota holds.
MOVE_BINS = 4096
#: A group larger than this part of a shard's capacity is served by itself.
SLICE_PART = 64
#: Rows that one window task ranks, on average.
RANK_ROWS = 50_000


def _bins(rows: int) -> int:
    return max(64, rows // (SHARDS * RANK_ROWS) + 1)


def _ranked(df: DataFrame, key: Column, bins: int, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: a gapless rank from 0 inside each ``key``, made of hashed bins.

    Counts per (key, bin) give each bin its offset; rows are numbered inside their bin only.
    ``df`` must be settled, since it is read for the counts and for the rows.
    """
    df = df.withColumns({"__key": key, "__bin": F.pmod(F.col("unit"), F.lit(bins))})
    counts = df.groupBy("__key", "__bin").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__key").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__key", "__bin", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__key", "__bin").orderBy(*order)
    return (
        df.withColumn("__i", F.row_number().over(inside))
        .join(offsets, ["__key", "__bin"])
        .withColumn(name, F.col("__before") + F.col("__i") - 1)
        .drop("__key", "__bin", "__before", "__i")
    )


def _large_rows(rows: int, shards: int) -> int:
    """A group with more rows than this is large."""
    return max(1, min(rows // (shards * SLICE_PART), HOT_ROWS))


def _by_shard(values: list[int], shard: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), shard)


def _deal(hubs: list, left: list[int], last: bool) -> tuple[list[tuple], list[tuple]]:
    """Labels of ``hubs``, the largest first, as (hub, first, end, label) ranges of its rows; and the hubs that wait.

    A hub takes the label with most votes among those whose quota holds it whole.  Where none does, a bin of
    several groups waits to be dealt in finer bins, and a single group fills the largest quota and goes on.
    """
    dealt, waiting = [], []
    for hub in sorted(hubs, key=lambda h: (-h["n"], h["hub"])):
        votes, n, at = hub["votes"], hub["n"], 0
        if max(left) < n and not (hub["single"] or last):
            waiting.append((hub["hub"],))
            continue
        while at < n:
            fits = [s for s in range(len(left)) if left[s] >= n - at]
            to = max(fits, key=lambda s: (votes[s], left[s])) if fits else max(range(len(left)), key=lambda s: (left[s], votes[s]))
            end = n if fits or left[to] <= 0 else at + left[to]
            left[to] -= end - at
            dealt.append((hub["hub"], at, end, to))
            at = end
    return dealt, waiting


def _votes(shards: int) -> Column:
    return F.array(*[F.count_if(F.col("shard") == s) for s in range(shards)])


def _granted(groups: DataFrame, left: list[int], bins: int) -> tuple[DataFrame | None, DataFrame]:
    """(group, to) of the ``groups`` (group, n, votes) that got a label, and those that no quota holds; ``left`` is used up."""
    waiting, done = groups, []
    for _ in range(ASKS):
        room = F.array(*[F.lit(x).cast("long") for x in left])
        offers = F.transform("votes", lambda v, s: F.struct(v.alias("votes"), F.get(room, s).alias("left"), (-s).alias("s")))
        best = F.array_max(F.filter(offers, lambda o: o["left"] >= F.col("n")))
        tag = F.xxhash64("group")
        asked = waiting.withColumns({"to": -best["s"], "tag": tag, "bin": F.pmod(tag, F.lit(bins))})
        # what a shard is asked for before a group, by bins, then inside the bin
        sums = asked.groupBy("to", "bin").agg(F.sum("n").alias("s"))
        before = Window.partitionBy("to").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("to", "bin", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"))
        inside = Window.partitionBy("to", "bin").orderBy("tag", "group").rowsBetween(Window.unboundedPreceding, 0)
        ranked = asked.where(F.col("to").isNotNull()).withColumn("upto", F.sum("n").over(inside)).join(sums, ["to", "bin"])
        served = ranked.select("group", "n", "votes", "to", (F.col("before") + F.col("upto") <= F.get(room, F.col("to"))).alias("granted"))
        served = settle(served.unionByName(asked.where(F.col("to").isNull()).select("group", "n", "votes", "to", F.lit(False).alias("granted"))))
        used = served.where("granted").groupBy("to").agg(F.sum("n").alias("n")).collect()  # a row a shard
        for row in used:
            left[row["to"]] -= row["n"]
        done.append(served.where("granted").select("group", "to"))
        waiting = served.where("NOT granted").select("group", "n", "votes")
        if not used or waiting.isEmpty():
            break
    return reduce(DataFrame.unionByName, done), waiting.select("group")


def propagate(linked: DataFrame, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Labels of ``linked`` (doc_id, text_crc32, unit, group, shard, ...) after groups took theirs; ends when none waits."""
    if not rounds:
        return linked
    left, columns = list(capacity), linked.columns
    slice_rows = _large_rows(sum(capacity), len(capacity))
    large = linked.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > slice_rows)
    large = F.broadcast(settle(large.select("group", F.concat(F.lit("g"), F.hex("group")).alias("hub"))))  # at most one for slice_rows rows
    done, _ = _dealt(linked.join(large, "group"), left, sum(capacity), True, columns)
    small = linked.join(large, "group", "left_anti")
    groups = settle(small.groupBy("group").agg(F.count("*").alias("n"), _votes(len(capacity)).alias("votes")))
    labels, waiting = _granted(groups, left, _bins(sum(capacity)))
    done.append(small.join(labels, "group").withColumn("shard", F.col("to")).select(columns))
    rest = settle(small.join(waiting, "group", "left_semi").select(columns))
    for k in range(rounds):
        if rest.isEmpty():
            break
        bin_ = F.pmod(F.xxhash64("group", F.lit(k)), F.lit(MOVE_BINS)).cast("string")
        got, rest = _dealt(rest.withColumn("hub", bin_), left, sum(capacity), k == rounds - 1, columns)
        done += got
    return settle(reduce(DataFrame.unionByName, done)) if done else linked


def _dealt(keyed: DataFrame, left: list[int], rows: int, last: bool, columns: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The rows of ``keyed`` (``columns`` and hub) whose hubs were dealt, with their labels, and those that wait; a row for each hub is on the driver."""
    spark, tag = keyed.sparkSession, F.xxhash64("group")
    counts = keyed.groupBy("hub").agg(F.count("*").alias("n"), (F.min(tag) == F.max(tag)).alias("single"), _votes(len(left)).alias("votes"))
    dealt, waiting = _deal(counts.collect(), left, last)
    pieces = Counter(hub for hub, *_ in dealt)
    whole = [(hub, to) for hub, _, _, to in dealt if pieces[hub] == 1]
    labels = spark.createDataFrame(whole, "hub string, to int")
    done = [keyed.join(F.broadcast(labels), "hub").withColumn("shard", F.col("to")).select(columns)]
    split = [x for x in dealt if pieces[x[0]] > 1]
    if split:
        ranges = spark.createDataFrame(split, "hub string, first long, end long, to int")
        hubs = spark.createDataFrame([(h,) for h in sorted({x[0] for x in split})], "hub string")
        cut = settle(keyed.join(F.broadcast(hubs), "hub").select(*columns, "hub"))
        cut = _ranked(cut, F.col("hub"), _bins(rows) * SHARDS, [F.col(c) for c in ("unit", "doc_id", "text_crc32")], "rank")
        inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
        done.append(cut.join(F.broadcast(ranges), "hub").where(inside).withColumn("shard", F.col("to")).select(columns))
    left_over = keyed.join(F.broadcast(spark.createDataFrame(waiting, "hub string")), "hub", "left_semi").select(columns)
    return done, settle(left_over) if waiting else left_over.limit(0)


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, group (null without links), shard, slot for each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.unhex(F.sha2(F.col("text").cast("binary"), 256))).alias("group"),
    )
    base = settle(base.withColumn("unit", F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id())))
    rows = base.count()
    capacity = [rows // shards + (s < rows % shards) for s in range(shards)]

    # groups are counted apart from the joins, so that these can be planned without the groups' own shuffle
    grouped = base.where(F.col("group").isNotNull())
    sizes = settle(grouped.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"))
    large = F.broadcast(sizes.where(F.col("n") > _large_rows(rows, shards)).select("group"))
    others = sizes.where(F.col("n") <= _large_rows(rows, shards)).select("group", F.lit(True).alias("linked"))
    hot = grouped.join(large, "group").withColumn("linked", F.lit(True))
    cold = grouped.join(large, "group", "left_anti").join(others, "group", "left")
    alone = base.where(F.col("group").isNull()).withColumn("linked", F.lit(None).cast("boolean"))
    # linked documents start on a hashed shard; free ones have none until they fill the room that is left
    marked = hot.unionByName(cold).unionByName(alone)
    marked = settle(
        marked.withColumn("shard", F.when(F.col("linked"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")))
        .withColumn("group", F.when(F.col("linked"), F.col("group")))
        .drop("linked")
    )
    linked = propagate(settle(marked.where(F.col("shard").isNotNull())), capacity, rounds)

    bins = _bins(rows)
    order = [F.col("unit"), F.col("doc_id"), F.col("text_crc32")]
    placed = settle(_ranked(linked, F.col("shard"), bins, order, "slot"))
    fits = F.col("slot") < _by_shard(capacity, F.col("shard"))
    taken = [0] * shards
    for row in placed.where(fits).groupBy("shard").agg(F.count("*").alias("n")).collect():  # one row a shard
        taken[row["shard"]] = row["n"]
    free = [c - t for c, t in zip(capacity, taken)]
    ends = [sum(free[: s + 1]) for s in range(shards)]

    columns = ["doc_id", "size", "text_crc32", "group", "unit"]
    pool = settle(marked.where(F.col("shard").isNull()).select(columns).unionByName(placed.where(~fits).select(columns)))
    # the pool is ranked in as many parts as shards, so that no bin is larger than elsewhere
    part = F.pmod(F.shiftright("unit", 20), F.lit(shards)).cast("int")
    pool = pool.withColumn("part", part)
    sizes_of_parts = [0] * shards
    for row in pool.groupBy("part").agg(F.count("*").alias("n")).collect():  # one row a part
        sizes_of_parts[row["part"]] = row["n"]
    starts = [sum(sizes_of_parts[:s]) for s in range(shards)]
    pool = _ranked(pool, F.col("part"), bins, order, "rank").withColumn("rank", F.col("rank") + _by_shard(starts, F.col("part")))
    to = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("rank")))
    pool = pool.withColumn("shard", to.cast("int"))
    first = [e - f for e, f in zip(ends, free)]
    pool = pool.withColumn("slot", F.col("rank") - _by_shard(first, F.col("shard")) + _by_shard(taken, F.col("shard")))
    final = ["doc_id", "size", "text_crc32", "group", "shard", "slot"]
    return placed.where(fits).select(final).unionByName(pool.select(final))


def cut_edges(sharded: DataFrame) -> DataFrame:
    """One row: edges between documents and hubs, and those cut when a hub sits on its group's most frequent shard."""
    votes = sharded.where(F.col("group").isNotNull()).groupBy("group", "shard").agg(F.count("*").alias("n"))
    groups = votes.groupBy("group").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    return groups.agg(
        F.coalesce(F.sum("all"), F.lit(0)).alias("n_edges"),
        F.coalesce(F.sum(F.col("all") - F.col("most")), F.lit(0)).alias("n_cut"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
