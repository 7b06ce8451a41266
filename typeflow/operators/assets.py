"""File assets as rows, and their reference counts as a ledger of deltas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.convert import asset, suffix_of
from ..sources.files import copy_files
from .scan import lives, scanned


@dataclass(frozen=True)
class AssetType:
    """A named kind of file."""

    name: str
    suffix: str

    def __post_init__(self):
        if not self.name.isidentifier():
            raise ValueError(f"{self.name!r} is no identifier")
        if not self.suffix.startswith("."):
            raise ValueError(f"the suffix {self.suffix!r} must start with a point")


def untyped(asset: Column) -> Column:
    """True for an asset that has no type yet."""
    return F.coalesce(asset["ext"], F.lit("")) == ""


def typed(asset: Column, kind: AssetType) -> Column:
    """An asset without a type as one of ``kind``: the suffix is appended; one that has a type is an error.

    Its content is whatever lies at the new path; ``typed_content`` brings it there.
    """
    new = F.struct(
        F.concat(asset["path"], F.lit(kind.suffix)).alias("path"), F.lit(kind.suffix).alias("ext"), F.lit(kind.name).alias("type"), asset["managed"].alias("managed")
    )
    message = F.concat(F.lit("asset has a type already: "), F.coalesce(asset["type"], F.lit("")), F.lit(" "), asset["path"])
    return F.when(untyped(asset), new).otherwise(F.raise_error(message))


def typed_content(df: DataFrame, asset: str, kind: AssetType) -> DataFrame:
    """(source, target, bytes, error): copies the content of the assets in a column to the paths that ``typed`` gives them.

    The stage may be run again, in part or whole: every file is written under another name and renamed when it is whole.
    """
    named = df.select(F.col(asset)["path"].alias("source"), typed(F.col(asset), kind)["path"].alias("target"))
    return copy_files(named)


def retype(base: Column, suffix: str) -> Column:
    """The path of a base under a type: its suffix is added unless it is there."""
    return F.when(suffix_of(base) == suffix, base).otherwise(F.concat(base, F.lit(suffix)))


def is_type(path: Column, suffix: str) -> Column:
    return suffix_of(path) == suffix


def with_outputs(df: DataFrame, key: str, outputs: dict[str, tuple[str, str]], folder: str) -> DataFrame:
    """``df`` with a managed asset column for each declared output (name: type and suffix).

    Paths follow from the key, so a repeated task names the same file.
    """
    made = {
        name: asset(F.concat(F.lit(f"{folder}/{name}-"), F.col(key).cast("string"), F.lit(suffix)), type_name, suffix, True)
        for name, (type_name, suffix) in outputs.items()
    }
    return df.withColumns(made)


def reference_counts(ledger: DataFrame, path: str, delta: Column) -> DataFrame:
    """(path, refs): the references that are held; creation is its owner's +1."""
    return ledger.groupBy(path).agg(F.sum(delta).cast("long").alias("refs"))


def running_counts(ledger: DataFrame, path: str, delta: Column, order: list[str], bin: Column | None = None) -> DataFrame:
    """The ledger with the count after each event, by a scan of bins: a path with very many events is no single task.

    ``bin`` gives bins of the caller's own; it grows with ``order`` (an hour of a time, say).
    """
    return scanned(ledger, path, delta, order, bin).select(*ledger.columns, "running")


def underflows(ledger: DataFrame, path: str, delta: Column, order: list[str]) -> DataFrame:
    """The events that take a reference from a path that has none: such a removal is an error and changes nothing.  Deltas are +1, -1 or 0."""
    return scanned(ledger, path, delta, order).where("failed").select(*ledger.columns)


def reference_lives(ledger: DataFrame, path: str, event: str, delta: Column, order: list[str]) -> DataFrame:
    """(path, life, born, died, peak): a path is deleted when its last reference goes, and one that is added later begins a new life."""
    return lives(scanned(ledger, path, delta, order), path, event)


def collectable(counts: DataFrame) -> DataFrame:
    """The paths that nothing refers to any more."""
    return counts.where(F.col("refs") <= 0)


def tracked(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("refs") > 0)
