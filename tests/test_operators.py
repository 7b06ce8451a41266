import gzip

import pytest
from pyspark.sql import functions as F

from typeflow.operators import assets, execute, volumes
from typeflow.operators.command import Command, Output, Param, bind_defaults, matches
from typeflow.operators.proxified import ProxyCommand
from typeflow.plans import visualizers
from typeflow.plans.defaults import default_registry
from typeflow.plans.planner import Context
from typeflow.sources import metadata
from typeflow.streaming import ledger


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_commands(spark):
    spec = Command("prog", [Param("inputs", label="i"), Param("outputs", label="o"), Param("value", "keyword", default=42), Param("fast", "flag", default=False)], ("go", "run"))
    argv = lambda **given: one(spark, spec.argv({k: F.lit(v) for k, v in given.items()}).alias("a")).a
    assert argv(inputs="/a b", outputs="/o") == ["go", "run", "prog", "-i", "/a b", "-o", "/o", "--value", "42"]
    assert argv(inputs="/a", outputs="/o", value=7, fast=True)[-3:] == ["--value", "7", "--fast"]
    assert argv(inputs=None, outputs="/o", fast=None) == ["go", "run", "prog", "-o", "/o", "--value", "42"]
    with pytest.raises(ValueError, match="missing"):
        argv(inputs="/a")
    with pytest.raises(ValueError, match="unknown"):
        argv(inputs="/a", outputs="/b", other=1)


def test_validation_and_postprocess(spark):
    spec = Command("prog", [Param("f", pattern=r"(.+)\.vol", label="renamed"), Param("flag", "flag")], postprocess=lambda g: F.transform(g, lambda p, k: F.when(k == 0, F.slice(p, 2, 9)).otherwise(p)))
    good = {"f": F.lit("file.vol"), "flag": F.lit(True)}
    bad = {"f": F.lit("file.vol\n"), "flag": F.lit(True)}
    assert one(spark, spec.argv(good).alias("a")).a == ["prog", "file.vol", "--flag"]
    assert one(spark, spec.invalid(bad).alias("a")).a == ["f"]
    with pytest.raises(Exception, match="invalid f"):
        one(spark, spec.argv(bad))
    assert one(spark, matches(F.lit(12), "[0-9]+").alias("a")).a
    with pytest.raises(ValueError):
        Param("x", default=True)
    with pytest.raises(ValueError):
        Command("p", [Param("x"), Param("x")])
    assert list(bind_defaults([Param("b", default=1), Param("a", default=2)], {})) == ["b", "a"]


def test_execution(spark):
    df = spark.createDataFrame([(1, ["true"]), (2, ["sh", "-c", "echo no >&2; exit 42"]), (3, ["no-such-program"]), (4, None)], "k int, argv array<string>")
    got = {r.k: (r.exit_code, r.stderr) for r in execute.run_commands(df, "k", "argv").collect()}
    assert got[1] == (0, "") and got[2] == (42, "no\n") and got[3][0] == 127 and got[4] == (None, None)
    with pytest.raises(Exception, match="command failed with 42"):
        execute.require_success(execute.run_commands(df.where("k = 2"), "k", "argv")).collect()


def test_ledger(spark):
    events = [(1, "p1", 1), (2, "p2", 1), (3, "p1", 1), (4, "p1", -1), (5, "p2", 1), (6, "p1", -1)]
    df = spark.createDataFrame(events, "seq int, path string, delta int")
    counts = assets.reference_counts(df, "path", F.col("delta"))
    assert {r.path: r.refs for r in counts.collect()} == {"p1": 0, "p2": 2}
    assert [r.path for r in assets.collectable(counts).collect()] == ["p1"]
    assert [r.path for r in assets.tracked(counts).collect()] == ["p2"]
    assert [r.running for r in assets.running_counts(df, "path", F.col("delta"), ["seq"]).orderBy("seq").collect()] == [1, 1, 2, 1, 2, 0]


def test_removals_of_untracked_paths(spark):
    """Against a counter that refuses to go below nothing."""
    import random

    random.seed(4)
    events = [(k, f"p{random.randrange(4)}", random.choice([1, -1, -1, 0])) for k in range(300)]
    count, bad = {}, []
    for seq, path, delta in events:
        if delta < 0 and count.get(path, 0) == 0:
            bad.append(seq)
        else:
            count[path] = count.get(path, 0) + delta
    df = spark.createDataFrame(events, "seq int, path string, delta int").repartition(3)
    assert sorted(r.seq for r in assets.underflows(df, "path", F.col("delta"), ["seq"]).collect()) == bad


def test_running_counts_by_bins(spark):
    df = spark.range(500).selectExpr("id AS seq", "IF(id % 3 = 0, NULL, id % 2) AS path", "id % 5 - 2 AS delta").repartition(3)
    whole = assets.running_counts(df, "path", F.col("delta"), ["seq"])
    binned = assets.running_counts(df, "path", F.col("delta"), ["seq"], F.when(F.col("seq") > 40, F.floor(F.col("seq") / 40)))
    assert binned.columns == whole.columns and sorted(map(str, binned.collect())) == sorted(map(str, whole.collect()))


def test_typed_assets(spark):
    rows = [("/a/p", None, None, True), ("/a/q", "", "", False)]
    df = spark.createDataFrame(rows, "path string, ext string, type string, managed boolean").select(F.struct("*").alias("a"))
    kind = assets.AssetType("PosFile", ".pos")
    got = [tuple(r.t) for r in df.select(assets.typed(F.col("a"), kind).alias("t")).collect()]
    assert got == [("/a/p.pos", ".pos", "PosFile", True), ("/a/q.pos", ".pos", "PosFile", False)]
    with pytest.raises(Exception, match="has a type already"):
        df.select(assets.typed(assets.typed(F.col("a"), kind), assets.AssetType("Other", ".oth"))).collect()
    for bad in (("Pos File", ".pos"), ("PosFile", "pos")):
        with pytest.raises(ValueError):
            assets.AssetType(*bad)


def test_proxified_command(spark):
    registry = default_registry()
    registry.declare("MyVolume", "proxy", suffix=".custom")
    params = [Param("bar", "keyword"), Param("outputs", default=Output("MyVolume", ".custom"), label="o"), Param("n", "keyword", default=3), Param("fast", "flag", default=False)]
    program = ProxyCommand(Command("foo", params), {"outputs": "MyVolume"})
    df = spark.createDataFrame([(7, "x", "/mine.custom"), (8, None, "/other.custom")], "k long, bar string, own string")
    run = lambda **given: program.apply(df, "k", given, Context(registry), "/tmp/out").orderBy("k").collect()
    made = run(bar=(F.col("bar"), "str"), fast=(F.lit(True), "bool"))
    assert [r.argv for r in made] == [["foo", "--bar", "x", "-o", "/tmp/out/outputs-7.custom", "--n", "3", "--fast"], ["foo", "-o", "/tmp/out/outputs-8.custom", "--n", "3", "--fast"]]
    assert [tuple(r.outputs) for r in made] == [(f"/tmp/out/outputs-{k}.custom", "MyVolume", True) for k in (7, 8)]
    given = run(bar=(F.lit(42.0), "float"), outputs=(F.col("own"), "path"))
    assert [tuple(r.outputs) for r in given] == [("/mine.custom", "MyVolume", False), ("/other.custom", "MyVolume", False)]
    assert given[0].argv == ["foo", "--bar", "42.0", "-o", "/mine.custom", "--n", "3"] and program.outputs() == ["outputs"]
    with pytest.raises(Exception, match="expected a .custom file"):
        run(bar=(F.lit("x"), "str"), outputs=(F.lit("/wrong.txt"), "path"))
    with pytest.raises(ValueError, match="missing argument: bar"):
        run()


def test_streaming_ledger(spark, sf_dir, tmp_path):
    stored = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type")
    stored.write.parquet(str(tmp_path / "events"))
    delta = F.when(F.col("event_type") == "error", -1).otherwise(1)
    stream = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "events"))
    query = ledger.start(ledger.running_references(stream, "user_id", delta), str(tmp_path / "counts"), str(tmp_path / "state"))
    query.awaitTermination()
    want = assets.reference_counts(stored, "user_id", delta)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "counts")).collect())) == sorted(map(tuple, want.collect()))


def test_assets_and_volumes(spark):
    row = one(spark, assets.retype(F.lit("/x/p"), ".txt").alias("a"), assets.retype(F.lit("/x/p.txt"), ".txt").alias("b"), assets.is_type(F.lit("/x.d/p"), ".d/p").alias("c"))
    assert (row.a, row.b, row.c) == ("/x/p.txt", "/x/p.txt", False)
    data = F.array(*[F.lit(v).cast("float") for v in (0.0, 0.02, 0.5, 0.019)])
    row = one(spark, volumes.threshold(data, 0.02).alias("m"), volumes.count_nonzero(data).alias("n"), volumes.count_at_least(data, 0.02).alias("k"))
    assert (row.m, row.n, row.k) == ([0, 1, 1, 0], 3, 2)
    assert volumes.sphere(spark, 32, 12).where("inside").count() == 7153


def test_sources(spark):
    doc = F.lit('{"a": {"x": 3, "id": "ABC"}}')
    m = one(spark, metadata.map_metadata(doc, {"x": ("$.a.x", "int"), "id": ("$.a.id", "string"), "no": ("$.b", "string")}, ("x",), ("id",)).alias("m")).m
    assert (m.x, m.id, m.no) == (-3, "abc", None)
    files = spark.createDataFrame([("a", bytearray(gzip.compress(b"hi"))), ("b", bytearray(b"junk")), ("c", None)], "k string, d binary")
    assert {r.k: r.d and bytes(r.d) for r in metadata.gunzip(files, "k", "d").collect()} == {"a": b"hi", "b": None, "c": None}
    star = spark.createDataFrame([("f", "data_\nloop_\n _score1\n _score2\n 0.5  1.5\n")], "k string, t string")
    (row,) = metadata.star_rows(star, "k", "t").collect()
    assert row["values"] == {"_score1": "0.5", "_score2": "1.5"}


def test_visualizers():
    show = visualizers.visualizer(".test")(lambda df: "shown")
    assert visualizers.show(None, ".test") == show(None) == "shown"
    with pytest.raises(ValueError):
        visualizers.visualizer(".test")(show)
    with pytest.raises(LookupError):
        visualizers.show(None, ".none")
