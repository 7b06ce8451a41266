"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words in the shingle and rule operators.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, read by Spark from any file system."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset a temporary one is chosen in local mode (tests); on a cluster it is an error,
    since executors do not see each other's folders.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whatever kind that is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of a few numbers that are broadcast at most: some tens of MB in an executor.
BROADCAST_ROWS = 500_000


def if_small(df: DataFrame) -> DataFrame:
    """``df`` (settled rows of a few numbers) marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: A key with more rows than this is hot.
HOT_ROWS = 100_000


def hot_join(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``found``, a settled table of one row a ``key`` with the number ``n`` of its rows in ``rows``.

    The few hot keys (at most one for HOT_ROWS rows) are broadcast, so their rows stay where they are; the
    others are shuffled.
    """
    hot = F.broadcast(found.where(F.col("n") > HOT_ROWS))
    if found.where(F.col("n") > HOT_ROWS).isEmpty():
        return rows.join(found.drop("n"), key)
    rest = rows.join(hot.select(key), key, "left_anti").join(found.where(F.col("n") <= HOT_ROWS).drop("n"), key)
    return rest.unionByName(rows.join(hot.drop("n"), key))


_C = ctypes.CDLL(None)


def trim() -> None:
    """Give memory that this worker has freed back to the system: workers wait, and count, through later stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def trimmed(of: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``of`` for ``mapInArrow``, with its memory given back after the last batch of a task."""

    def run(batches: Iterator) -> Iterator:
        yield from of(batches)
        trim()

    return run


def portions(texts: Iterable[str], chars: int = 4_000_000) -> Iterator[list[str]]:
    """The texts in runs of about ``chars`` characters, one text at least."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for the row.

    Binding through a one-element array keeps the optimizer from inlining a costly
    expression into a lambda that would evaluate it for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and every other character unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no label may be learned from (null ids belong to it)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
