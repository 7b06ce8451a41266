"""Commands that feed commands: levels of the command graph, and how long each file is needed.

A command reads and writes assets; it can run once all commands that write what it reads have run.  Levels are found
from the sources onwards: a round counts off, for the commands that the last round made ready, what waits for
them, and those that wait for nothing more are the next level.  Dependencies are dealt by the command that is waited for
once and stay so; only the ready ones are joined with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import CUT, dealt
from .storage import checkpointed


def dependencies(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(command, on): each command and the others that write an asset it reads.  Both tables have (command, asset)."""
    wrote = writes.select(F.col("command").alias("on"), "asset")
    return reads.join(wrote, "asset").where(F.col("command") != F.col("on")).select("command", "on").distinct()


def command_levels(commands: DataFrame, needs: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(command, level): 0 for a command that waits for none, else one more than the highest level it waits for.

    ``needs`` is (command, on) with distinct rows.  Commands that wait for each other are an error.
    """
    spark = commands.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    commands = commands.select("command").distinct()
    by_source = dealt(checkpointed(needs), parts, "on").persist()
    left = by_source.groupBy("command").agg(F.count("*").alias("left"))
    waiting = dealt(checkpointed(commands.join(left, "command", "left").withColumn("left", F.coalesce("left", F.lit(0)))), parts, "command").persist()
    ready = checkpointed(waiting.where("left = 0").select("command", F.lit(0).alias("level")))
    levels, old, done = ready, [], ready.count()
    total, level = waiting.count(), 0
    while True:
        level += 1
        off = ready.select(F.col("command").alias("on")).join(by_source, "on").groupBy("command").agg(F.count("*").alias("off"))
        after = waiting.join(off, "command", "left").select("command", (F.col("left") - F.coalesce("off", F.lit(0))).alias("left"), F.col("off").isNotNull().alias("hit"))
        now = (dealt(checkpointed(after), parts, "command") if level % CUT == 0 else after).persist()
        ready = checkpointed(now.where("hit AND left = 0").select("command", F.lit(level).alias("level")))
        old.append(waiting)
        waiting = now.drop("hit")
        found = ready.count()
        for df in old[:-1]:
            df.unpersist()
        old = [now]
        if not found:
            break
        if level > rounds:
            raise ValueError(f"commands are more than {rounds} levels deep")
        done += found
        levels = checkpointed(levels.unionByName(ready)) if level % CUT == 0 else levels.unionByName(ready)
    if done != total:
        names = [str(r.command) for r in waiting.where("left > 0").select("command").limit(5).collect()]
        raise ValueError(f"{total - done} commands wait for each other, or for those that do: {', '.join(names)}")
    by_source.unpersist()
    return levels


def asset_uses(levels: DataFrame, reads: DataFrame, writes: DataFrame) -> DataFrame:
    """For every asset: ``writer`` and ``level`` (of the last command that writes it; null for a file that is given), ``readers``,
    ``last_reader`` and ``last_level`` (null if nothing reads it), and ``free_after``.

    A written asset may go once all commands up to the level ``free_after`` have run; a file that is given stays.  Of
    commands on the last level the one that is greatest is named.
    """
    at = F.struct("level", "command")
    made = writes.join(levels, "command").groupBy("asset").agg(F.max(at).alias("w"))
    used = reads.select("command", "asset").distinct().join(levels, "command").groupBy("asset").agg(F.max(at).alias("r"), F.count("*").alias("readers"))
    both = made.join(used, "asset", "full")
    free = F.when(F.col("w").isNotNull(), F.greatest("w.level", "r.level"))
    return both.select(
        "asset",
        F.col("w.command").alias("writer"),
        F.col("w.level").alias("level"),
        F.coalesce("readers", F.lit(0)).alias("readers"),
        F.col("r.command").alias("last_reader"),
        F.col("r.level").alias("last_level"),
        free.alias("free_after"),
    )


def held_files(uses: DataFrame) -> DataFrame:
    """(level, made, freed, held): written files by level, and how many are there while it runs."""
    written = uses.where("writer IS NOT NULL")
    made = written.groupBy("level").agg(F.count("*").alias("made"))
    freed = written.groupBy(F.col("free_after").alias("level")).agg(F.count("*").alias("freed"))
    both = made.join(freed, "level", "full").select("level", F.coalesce("made", F.lit(0)).alias("made"), F.coalesce("freed", F.lit(0)).alias("freed"))
    so_far = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)  # a row a level
    return both.withColumn("held", F.sum(F.col("made") - F.col("freed")).over(so_far) + F.col("freed"))
