"""Files that tasks open by their address, on any file system that pyarrow knows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 20


def opened(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address and the path in it."""
    return pafs.FileSystem.from_uri(address.replace("s3a://", "s3://", 1))


def copy_content(source: str, target: str) -> int:
    """Copies a file in pieces; returns its bytes.

    The content is written under a name that no other try uses and renamed when it is whole, so a reader never sees
    part of it and a task that runs twice, or at the same time as its twin, leaves the same file.
    """
    home, path = opened(target)
    place, start = opened(source)
    folder, _, name = path.rpartition("/")
    home.create_dir(folder, recursive=True)
    temporary, size = f"{folder}/.{name}-{uuid.uuid4().hex}", 0
    try:
        with place.open_input_stream(start, compression=None) as taken, home.open_output_stream(temporary, compression=None) as out:
            while piece := taken.read(PIECE):
                size += out.write(piece)
        home.move(temporary, path)
    except BaseException:
        if home.get_file_info(temporary).type != pafs.FileType.NotFound:
            home.delete_file(temporary)
        raise
    return size


def copy_files(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(source, target, bytes, error): copies the files that ``pairs`` names; a file that cannot be copied has an error and no bytes.

    A target that several sources name is an error of all of them, since the last would win; nulls copy nothing.
    """
    named = pairs.select(F.col(source).alias("source"), F.col(target).alias("target")).distinct()
    several = named.groupBy("target").agg(F.count("*").alias("n")).where("n > 1 AND target IS NOT NULL").select("target", F.lit(True).alias("several"))
    work = named.join(several, "target", "left").select("source", "target", F.coalesce("several", F.lit(False)).alias("several"))

    def one(source: str | None, target: str | None, several: bool) -> tuple[int | None, str | None]:
        if source is None or target is None:
            return None, "no file named"
        if several:
            return None, f"several sources for {target}"
        try:
            return copy_content(source, target), None
        except (OSError, pa.ArrowException) as e:
            return None, f"{type(e).__name__}: {e}"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            done = [one(*r) for r in rows]
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["source", "target", "bytes", "error"])

    return work.mapInArrow(of, "source string, target string, bytes long, error string")
