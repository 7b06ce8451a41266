"""Metadata, archives, locators and labelled text loops."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_field(document: Column, path: str, kind: str = "string") -> Column:
    """The value at a JSON path; null if it is missing."""
    return F.get_json_object(document, path).cast(kind)


def map_metadata(document: Column, fields: dict[str, tuple[str, str]], negate: tuple[str, ...] = (), lower: tuple[str, ...] = ()) -> Column:
    """A struct of named JSON values (name: path and type); some with the sign turned, some in lower case."""

    def value(name: str, path: str, kind: str) -> Column:
        v = json_field(document, path, kind)
        return -v if name in negate else F.lower(v) if name in lower else v

    return F.struct(*[value(n, p, k).alias(n) for n, (p, k) in fields.items()])


def locator(template: str, *parts: Column) -> Column:
    """A path or address made from a printf template."""
    return F.format_string(template, *parts)


def gunzip(files: DataFrame, key: str, data: str) -> DataFrame:
    """(key, data) with each gzip content unpacked; content that is no gzip gives null."""
    kind = files.schema[key].dataType.simpleString()

    def opened(content: bytes | None) -> bytes | None:
        try:
            return None if content is None else gzip.decompress(content)
        except (OSError, EOFError):
            return None

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time in memory
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([opened(batch.column(1)[i].as_py())], pa.binary())], names=[key, data])

    return files.select(key, data).mapInArrow(of, f"`{key}` {kind}, `{data}` binary")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files at a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def star_rows(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, values map) of the loop in each file's text: labels start with '_', rows follow them."""
    lines = F.transform(F.split(F.col(text), "\n"), lambda line: F.trim(line))
    whole = files.select(key, lines.alias("lines")).select(
        key,
        F.transform(F.filter("lines", lambda s: s.startswith("_")), lambda s: F.split(s, r"\s+")[0]).alias("labels"),
        F.filter("lines", lambda s: (s != "") & ~s.rlike(r"^(data_|loop_|_|#)")).alias("rows"),
    )
    exploded = whole.select(key, "labels", F.posexplode("rows").alias("row", "line"))
    return exploded.select(key, "row", F.map_from_arrays("labels", F.slice(F.split("line", r"\s+"), F.lit(1), F.size("labels"))).alias("values"))
