"""The stream of managed paths: replays equal the batch ledger, restarts, late events."""

import random

import pytest
from pyspark.sql import functions as F

from typeflow.operators import scan
from typeflow.streaming import managed

KINDS = "path string, at timestamp, event long, delta int"


def made(seed, n, first=0):
    rng = random.Random(seed)
    return [(rng.choice([None, "a", "b", "c", "d"]), first + k, rng.choice([1, 1, -1, -1, 0])) for k in range(n)]


def frame(spark, events):
    """Two events share each second."""
    df = spark.createDataFrame(events, "path string, event long, delta int")
    return df.select("path", F.timestamp_seconds(F.floor(F.col("event") / 2) + 1_700_000_000).alias("at"), "event", "delta")


def run(spark, folder, delay="0 seconds"):
    stream = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = managed.start(managed.managed_references(stream, "path", "at", "event", F.col("delta"), delay), f"{folder}/out", f"{folder}/state")
    query.awaitTermination()
    return query


def ledger(spark, df):
    got = scan.scanned(df, "path", F.col("delta"), ["at", "event"])
    last = got.groupBy("path").agg(F.max_by("count", F.struct("at", "event")).alias("refs")).where("refs > 0")
    failed = got.where("failed").select("path", "event")
    deleted = got.where("before = 1 AND count = 0").select("path", "event")
    return [set(map(tuple, x.collect())) for x in (last, failed, deleted)]


def put_out(spark, folder):
    got = managed.changes(spark, f"{folder}/out")
    of = lambda kind: set(map(tuple, got.where(F.col("kind") == kind).select("path", "event").collect()))
    return [set(map(tuple, managed.tracked(got).collect())), of("underflow"), of("deleted")]


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def write(spark, folder, events):
    frame(spark, events).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_replay_and_restart(spark, folder):
    """Events come out of order inside the delay, in three files, with a stop and a restart between them."""
    events = made(3, 240)
    shuffled = sorted(events, key=lambda e: e[1] + random.Random(e[1]).randrange(30))
    write(spark, folder, shuffled[:80])
    run(spark, folder, "60 seconds")
    before = put_out(spark, folder)
    write(spark, folder, shuffled[80:160])
    write(spark, folder, shuffled[160:])
    write(spark, folder, [("clock", 10_000, 0)])
    run(spark, folder, "60 seconds")
    want = ledger(spark, frame(spark, events))
    assert put_out(spark, folder) == want and all(want)
    assert before[1] <= want[1] and before[2] <= want[2]
    # nothing is new: nothing changes
    run(spark, folder, "60 seconds")
    assert put_out(spark, folder) == want


def test_late_events_are_dropped_and_counted(spark, folder):
    events = made(5, 60, first=1000)
    write(spark, folder, events)
    run(spark, folder)
    write(spark, folder, [("a", 10, 1), ("a", 11, -1)])  # long passed
    write(spark, folder, [("clock", 10_000, 0)])
    query = run(spark, folder)
    assert put_out(spark, folder) == ledger(spark, frame(spark, events))
    dropped = sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
    assert dropped == 2
