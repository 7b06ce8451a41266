"""The ledger's scan against a counter in plain Python that deletes a path with its last reference."""

import random

import pytest
from pyspark.sql import functions as F

from typeflow.operators import assets, scan


def replay(events):
    """Sorted rows (seq, running, before, count, failed, life)."""
    sums, counts, lives, out = {}, {}, {}, []
    for seq, path, delta in sorted(events):
        sums[path] = sums.get(path, 0) + delta
        before = counts.get(path, 0)
        failed = delta < 0 and before == 0
        if delta > 0 and before == 0:
            lives[path] = lives.get(path, 0) + 1
        counts[path] = before if failed else before + delta
        out.append((seq, sums[path], before, counts[path], failed, lives.get(path, 0)))
    return out


def ledger(spark, events):
    return spark.createDataFrame(events, "seq int, path string, delta int").repartition(5)


def rows(df):
    return sorted(tuple(r) for r in df.select("seq", "running", "before", "count", "failed", "life").collect())


@pytest.mark.parametrize("seed", range(4))
def test_scan_against_replay(spark, seed):
    """One path holds a third of the rows and is cut into many bins; others begin and end inside bins; null is a path too."""
    rng = random.Random(seed)
    steps = [[1, -1, -1, 0], [1, 1, 1, -1], [1, -1], [1, 1, -1, -1, -1]][seed]
    names = [None, *(f"p{k}" for k in range(40))]
    events = [(k, "hot" if rng.random() < 0.34 else rng.choice(names), rng.choice(steps)) for k in range(900)]
    want = replay(events)
    df = ledger(spark, events)
    for size in (10_000, 300, 40):
        assert rows(scan.scanned(df, "path", F.col("delta"), ["seq"], bin_rows=size)) == want
    assert rows(scan.scanned(df, "path", F.col("delta"), ["seq"], F.floor(F.col("seq") / 50))) == want


def test_a_hot_path_is_cut(spark):
    df = ledger(spark, [(k, "hot" if k % 3 == 0 else f"p{k}", 1) for k in range(3000)])
    cut = df.repartitionByRange(10, "path", "seq").withColumn("bin", F.spark_partition_id())
    most = cut.groupBy("bin").count().agg(F.max("count")).first()[0]
    assert most < 700 and cut.where("path = 'hot'").select("bin").distinct().count() >= 3
    got = scan.scanned(df, "path", F.col("delta"), ["seq"], bin_rows=300)
    assert got.where("path = 'hot'").agg(F.max("count"), F.max("life")).first()[:] == (1000, 1)
    # what is carried from bin to bin has at most two rows a bin
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_lives(spark):
    events = [(1, "a", 1), (2, "a", 1), (3, "a", -1), (4, "a", -1), (5, "a", -1), (6, "a", 1), (7, "b", -1), (8, "c", 1), (9, "c", -1), (10, None, 1), (11, "a", 0)]
    got = assets.reference_lives(ledger(spark, events), "path", "seq", F.col("delta"), ["seq"]).collect()
    assert {tuple(r) for r in got} == {("a", 1, 1, 4, 2), ("a", 2, 6, None, 1), ("c", 1, 8, 9, 1), (None, 1, 10, None, 1)}
    assert assets.reference_lives(ledger(spark, []), "path", "seq", F.col("delta"), ["seq"]).collect() == []
