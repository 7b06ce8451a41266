"""Bricks against whole volumes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from typeflow.operators import bricks, volumes

SHAPE = (9, 7, 10)


@pytest.fixture(scope="module")
def whole():
    return {v: np.random.default_rng(v).normal(size=SHAPE).astype(np.float32) for v in range(3)}


@pytest.fixture(scope="module")
def cut(spark, whole, tmp_path_factory):
    rows = [(v, z, [float(x) for x in p.ravel()]) for v, a in whole.items() for z, p in enumerate(a)]
    planes = spark.createDataFrame(rows, "volume long, z int, plane array<float>").repartition(4)
    folder = str(tmp_path_factory.mktemp("bricks") / "b")
    bricks.write_bricks(bricks.to_bricks(planes, SHAPE[1], SHAPE[2], 4), folder, 3)
    return spark.read.parquet(folder)


def test_morton(spark):
    rng = random.Random(1)
    places = [(0, 0, 0), (1, 2, 3), (2**21 - 1,) * 3, *[tuple(rng.randrange(2**21) for _ in range(3)) for _ in range(30)]]
    df = spark.createDataFrame(places, "z int, y int, x int").select(bricks.morton(F.col("z"), F.col("y"), F.col("x")).alias("m"))
    plain = lambda z, y, x: sum((z >> i & 1) << 3 * i + 2 | (y >> i & 1) << 3 * i + 1 | (x >> i & 1) << 3 * i for i in range(21))
    assert [r.m for r in df.collect()] == [plain(*p) for p in places]


def test_bricks_hold_the_volume(cut, whole):
    rows = cut.collect()
    assert len(rows) == 3 * 3 * 2 * 3
    for r in rows:
        part = whole[r.volume][r.z0 : r.z0 + 4, r.y0 : r.y0 + 4, r.x0 : r.x0 + 4]
        assert (r.nz, r.ny, r.nx) == part.shape and r["values"] == [float(x) for x in part.ravel()]


@pytest.mark.parametrize("centre,radius", [((4, 3, 5), 3), ((0, 0, 0), 2.5), ((4.5, 3.5, 4.5), 100), ((20, 3, 3), 4), ((8, 6, 9), 0), ((4, 3, 5), 6)])
def test_spheres_equal_those_of_whole_rows(spark, cut, whole, centre, radius):
    got = {v: [] for v in whole}
    for r in bricks.sphere_voxels(cut, centre, radius, 4).collect():
        got[r.volume] += r["values"]
    flat = spark.createDataFrame([(v, [float(x) for x in a.ravel()]) for v, a in whole.items()], "volume long, data array<float>")
    want = flat.select("volume", volumes.sphere_values(F.col("data"), SHAPE, centre, radius).alias("s")).collect()
    assert {v: sorted(x) for v, x in got.items()} == {r.volume: sorted(r.s) for r in want}


def test_pruning(cut, whole):
    kept = bricks.near_sphere(cut, (1, 1, 1), 1.5, 4)
    assert {(r.z0, r.y0, r.x0) for r in kept.collect()} == {(0, 0, 0)} and kept.count() == len(whole)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert all(name in pushed for name in ("z0", "y0", "x0"))
    # a larger sphere leaves the corners of its box out: 4 voxels away along each axis is too far
    kept = bricks.near_sphere(cut.where("volume = 0"), (0, 0, 0), 6, 4)
    assert (4, 4, 4) not in {(r.z0, r.y0, r.x0) for r in kept.collect()} and kept.count() == 7


def test_planes(cut, whole):
    for z in (0, 5, 8):
        got = np.zeros((3, *SHAPE[1:]), np.float32)
        for r in bricks.plane_tiles(cut, z).collect():
            got[r.volume, r.y0 : r.y0 + r.ny, r.x0 : r.x0 + r.nx] = np.array(r.tile, np.float32).reshape(r.ny, r.nx)
        assert (got == np.stack([whole[v][z] for v in range(3)])).all()
    assert bricks.plane_tiles(cut, 9).count() == 0
