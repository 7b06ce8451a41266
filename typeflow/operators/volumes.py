"""Dense volumes held as flat arrays in z, y, x order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def to_float32(data: Column) -> Column:
    return data.cast("array<float>")


def to_float64(data: Column) -> Column:
    return data.cast("array<double>")


def threshold(data: Column, below: float) -> Column:
    """0 where a value is below the threshold as a float32, else 1."""
    return F.transform(data, lambda v: F.when(v < F.lit(below).cast("float"), F.lit(0)).otherwise(F.lit(1)))


def count_at_least(data: Column, least: float) -> Column:
    """How many values a threshold mask at ``least`` keeps."""
    return F.size(F.filter(data, lambda v: v >= F.lit(least).cast("float"))).cast("long")


def count_nonzero(data: Column) -> Column:
    return F.size(F.filter(data, lambda v: v != 0)).cast("long")


def plane(data: Column, shape: tuple[int, int, int], z: int) -> Column:
    """The plane at depth ``z``."""
    _, ny, nx = shape
    return F.slice(data, z * ny * nx + 1, ny * nx)


def voxels(df: DataFrame, key: str, data: str, shape: tuple[int, int, int]) -> DataFrame:
    """(key, z, y, x, v), a row for each voxel."""
    _, ny, nx = shape
    flat = df.select(key, F.posexplode(data).alias("i", "v"))
    at = lambda expression: F.expr(expression).cast("int")
    return flat.select(key, at(f"i div {ny * nx}").alias("z"), at(f"(i div {nx}) % {ny}").alias("y"), at(f"i % {nx}").alias("x"), "v")


def sphere(spark: SparkSession, size: int, radius: float) -> DataFrame:
    """(z, y, x, inside) over a cubic grid, for the sphere around its centre voxel."""
    c = size // 2
    grid = spark.range(size**3).select(
        F.expr(f"cast(id div {size * size} as int)").alias("z"), F.expr(f"cast((id div {size}) % {size} as int)").alias("y"), F.expr(f"cast(id % {size} as int)").alias("x")
    )
    return grid.withColumn("inside", inside_sphere(F.col("z"), F.col("y"), F.col("x"), (c, c, c), radius))


def sphere_values(data: Column, shape: tuple[int, int, int], centre: tuple[float, float, float], radius: float) -> Column:
    """The values of a flat volume inside a sphere, in the row itself: a voxel's place follows from its index."""
    _, ny, nx = shape
    at = lambda i, step, n: F.floor(i / step) % n if n else F.floor(i / step)
    return F.filter(data, lambda v, i: inside_sphere(at(i, ny * nx, 0), at(i, nx, ny), at(i, 1, nx), centre, radius))


def inside_sphere(z: Column, y: Column, x: Column, centre: tuple[float, float, float], radius: float) -> Column:
    squares = [(axis - F.lit(c)) * (axis - F.lit(c)) for axis, c in zip((z, y, x), centre)]
    return squares[0] + squares[1] + squares[2] <= F.lit(radius * radius)
