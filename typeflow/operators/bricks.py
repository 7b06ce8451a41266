"""Volumes larger than a row: bricks in Morton order.

A brick is a cube of at most ``edge`` voxels a side, one row of a few thousand values.  Its key interleaves the bits of its
place, so bricks that are near in space are near in the files, and what Parquet knows of a row group's
places rules most of it out.  Spheres and planes are cut out of bricks: those outside are left by their places alone,
before any voxel is read, those wholly inside are taken as they are, and only the others test their voxels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .volumes import inside_sphere

EDGE = 32

#: Steps that spread 21 bits to every third place: shift, then mask.
_SPREAD = [(32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]


def _spread(v: Column) -> Column:
    v = v.cast("long")
    for by, mask in _SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
    return v


def morton(z: Column, y: Column, x: Column) -> Column:
    """The bits of three places below 2^21, interleaved."""
    return F.shiftleft(_spread(z), 2).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(_spread(x))


def to_bricks(planes: DataFrame, ny: int, nx: int, edge: int = EDGE) -> DataFrame:
    """(volume, brick, z0, y0, x0, nz, ny, nx, values): ``planes`` (volume, z, plane) cut into bricks, values in z, y, x order.

    A brick gathers at most ``edge`` tiles of a plane.  Planes that are missing make lower bricks only at the end of a volume.
    """
    places = [(y, x) for y in range(0, ny, edge) for x in range(0, nx, edge)]
    rows = lambda y, x: [F.slice("plane", j * nx + x + 1, min(edge, nx - x)) for j in range(y, min(y + edge, ny))]
    tiles = F.array(*[F.struct(F.lit(y).alias("y0"), F.lit(x).alias("x0"), F.concat(*rows(y, x)).alias("tile")) for y, x in places])
    cut = planes.select("volume", "z", F.explode(tiles).alias("t")).select("volume", "z", "t.*", F.expr(f"cast(z div {edge} * {edge} as int)").alias("z0"))
    whole = cut.groupBy("volume", "z0", "y0", "x0").agg(F.sort_array(F.collect_list(F.struct("z", "tile"))).alias("tiles"))
    step = lambda name: F.expr(f"{name} div {edge}")
    return whole.select(
        "volume",
        morton(step("z0"), step("y0"), step("x0")).alias("brick"),
        "z0",
        "y0",
        "x0",
        F.size("tiles").alias("nz"),
        F.least(F.lit(edge), F.lit(ny) - F.col("y0")).alias("ny"),
        F.least(F.lit(edge), F.lit(nx) - F.col("x0")).alias("nx"),
        F.flatten(F.transform("tiles", lambda t: t["tile"])).alias("values"),
    )


def write_bricks(bricks: DataFrame, folder: str, parts: int | None = None) -> None:
    """Parquet files in the order of volume and brick."""
    dealt = bricks.repartitionByRange(parts, "volume", "brick") if parts else bricks.repartitionByRange("volume", "brick")
    dealt.sortWithinPartitions("volume", "brick").write.parquet(folder)


_AXES = (("z0", "nz"), ("y0", "ny"), ("x0", "nx"))


def near_sphere(bricks: DataFrame, centre: tuple[float, float, float], radius: float, edge: int = EDGE) -> DataFrame:
    """The bricks that reach into a sphere; bounds on their places reach the files, then the box's nearest voxel decides."""
    for (start, _), c in zip(_AXES, centre):
        bricks = bricks.where((F.col(start) >= int(c - radius) - edge) & (F.col(start) <= int(c + radius) + 1))
    squares = F.lit(0.0)
    for (start, n), c in zip(_AXES, centre):
        away = F.greatest(F.col(start) - F.lit(float(c)), F.lit(float(c)) - (F.col(start) + F.col(n) - 1), F.lit(0.0))
        squares = squares + away * away
    return bricks.where(squares <= F.lit(float(radius * radius)))


def sphere_voxels(bricks: DataFrame, centre: tuple[float, float, float], radius: float, edge: int = EDGE) -> DataFrame:
    """(volume, brick, values): the values of each brick inside a sphere."""
    far = F.lit(0.0)
    for (start, n), c in zip(_AXES, centre):
        away = F.greatest(F.abs(F.col(start) - F.lit(float(c))), F.abs(F.col(start) + F.col(n) - 1 - F.lit(float(c))))
        far = far + away * away
    layer = F.col("ny") * F.col("nx")

    def inside(v: Column, i: Column) -> Column:
        z, y, x = F.floor(i / layer), F.floor(i / F.col("nx")) % F.col("ny"), i % F.col("nx")
        return inside_sphere(F.col("z0") + z, F.col("y0") + y, F.col("x0") + x, centre, radius)

    values = F.when(far <= F.lit(float(radius * radius)), F.col("values")).otherwise(F.filter("values", inside))
    return near_sphere(bricks, centre, radius, edge).select("volume", "brick", values.alias("values"))


def plane_tiles(bricks: DataFrame, z: int) -> DataFrame:
    """(volume, y0, x0, ny, nx, tile): the plane at depth ``z``, in tiles; other bricks are left by their places."""
    layer = F.col("ny") * F.col("nx")
    at = bricks.where((F.col("z0") <= z) & (F.col("z0") + F.col("nz") > z))
    return at.select("volume", "y0", "x0", "ny", "nx", F.slice("values", (F.lit(z) - F.col("z0")) * layer + 1, layer).alias("tile"))
