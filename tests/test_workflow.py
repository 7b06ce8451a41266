"""Command graphs against plain Python."""

import random

import pytest

from typeflow.operators import workflow


def brute(commands, reads, writes):
    needs = {c: {w for w, a in writes if (c, a) in reads and w != c} for c in commands}
    level = {}
    while len(level) < len(commands):
        ready = {c for c in commands if c not in level and needs[c] <= level.keys()}
        level |= {c: 1 + max((level[n] for n in needs[c]), default=-1) for c in ready}
    out = set()
    for asset in {a for _, a in reads} | {a for _, a in writes}:
        made = max(((level[c], c) for c, a in writes if a == asset), default=(None, None))
        used = [(level[c], c) for c, a in reads if a == asset]
        last = max(used, default=(None, None))
        out.add((asset, made[1], made[0], len(used), last[1], last[0], None if made[0] is None else max(made[0], last[0] if last[0] is not None else 0)))
    return level, out


def frames(spark, commands, reads, writes):
    pairs = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], "command long, asset string, level int").repartition(3).select("command", "asset")
    return spark.createDataFrame([(c,) for c in commands], "command long"), pairs(reads), pairs(writes)


def run(spark, commands, reads, writes):
    commands, reads, writes = frames(spark, commands, reads, writes)
    levels = workflow.command_levels(commands, workflow.dependencies(reads, writes))
    uses = workflow.asset_uses(levels, reads, writes)
    return {r.command: r.level for r in levels.collect()}, uses


@pytest.mark.parametrize("seed", range(2))
def test_levels_and_last_uses(spark, seed):
    """A file that a third of the commands read, files that nothing reads, given files, two writers of a file, reads of a command's own file."""
    rng = random.Random(seed)
    commands = list(range(120))
    writes = {(c, f"f{c}") for c in commands} | {(c, f"second{c}") for c in commands if c % 7 == 0} | {(5, "both"), (9, "both")}
    reads = {(c, f"f{rng.randrange(c)}") for c in commands[1:] for _ in range(2)} | {(c, "f1") for c in commands[2::3]} | {(c, "given") for c in commands[::4]}
    reads |= {(60, "both"), (61, "f61")}
    levels, uses = run(spark, commands, sorted(reads), sorted(writes))
    want, files = brute(commands, reads, writes)
    assert levels == want and max(levels.values()) > workflow.CUT
    assert {tuple(r) for r in uses.collect()} == files
    held = {r.level: (r.made, r.freed, r.held) for r in workflow.held_files(uses).collect()}
    written = [f for f in files if f[1] is not None]
    for level, got in held.items():
        assert got == (sum(f[2] == level for f in written), sum(f[6] == level for f in written), sum(f[2] <= level <= f[6] for f in written))


def test_cycles_and_empty_graphs(spark):
    with pytest.raises(ValueError, match="3 commands wait for each other"):
        run(spark, [1, 2, 3, 4], [(2, "c"), (3, "b"), (4, "c")], [(1, "a"), (2, "b"), (3, "c")])
    assert run(spark, [], [], [])[0] == {}
    assert run(spark, [7], [(7, "x")], [])[0] == {7: 0}
