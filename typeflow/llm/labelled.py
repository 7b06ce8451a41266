"""A bounded sample of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out

_LEAST, _VALUES = -(1 << 63), 1 << 64


def hash_bound(rows: int, total: int) -> int:
    """The signed 64-bit number below which a hash falls for about ``rows`` of ``total`` keys; exact for any total."""
    return _LEAST + rows * _VALUES // total


def in_sample(doc_id: Column, rows: int, total: int) -> Column:
    """True for about ``rows`` of ``total`` distinct ids, chosen by a hash; for all of them if there are no more."""
    return F.lit(True) if rows >= total else F.xxhash64(doc_id) < F.lit(hash_bound(rows, total))


def labelled_sample(labels: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """doc_id and the labels of about ``rows`` documents that are not held out, chosen by a hash of doc_id.

    Rows that repeat a document give its largest labels.  A label that is null in all of them stays null
    and teaches nothing; the document's other labels do.  A document without any label is left out.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in columns])
    usable = usable.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns])
    usable = usable.dropna(how="all", subset=columns)
    return usable.where(in_sample(F.col("doc_id"), rows, usable.count()))
