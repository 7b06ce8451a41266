"""Connected components over an edge table, by alternating star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each vertex's neighbours linked to its least one: the larger neighbours, or the smaller ones and itself.

    A vertex with very many neighbours, the centre of a large star, is a skewed key of the join.  Its
    minimum comes from a partial aggregate and is settled, so that both sides of the join are plain
    shuffles, of which Spark's adaptive execution splits the long one.
    """
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    least = settle(least) if large else least
    linked = around.join(least, "u")
    if large:
        made = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return made.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex of ``edges`` (u, v: bigint) that is not its component's least vertex.

    Large and small star rewrites alternate until the edges no longer change; they then are
    stars around the least vertex of each component.
    """
    edges = settle(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        edges = settle(_star(_star(edges, large=True), large=False))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == before:
            return edges.select("u", F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
