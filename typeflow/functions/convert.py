"""Column conversions: text forms, parameter structs, checked paths.

Doubles are written as Spark writes them; booleans as True and False.  A null stays null until a
command is rendered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIX = r"([.][^./]+)$"


def to_string(value: Column) -> Column:
    return value.cast("string")


def bool_to_string(value: Column) -> Column:
    return F.when(value, F.lit("True")).when(~value, F.lit("False"))


def to_int(value: Column) -> Column:
    """Toward zero, as a cast of a double does."""
    return value.cast("int")


def join_elements(values: Column, element=to_string, separator: str = " ") -> Column:
    """The elements' text forms, joined; ``element`` converts each."""
    return F.concat_ws(separator, F.transform(values, element))


def param_struct(text: Column, dtype: str, managed: Column | bool = False) -> Column:
    """A parameter: its text, the type it came from, and whether its file is managed."""
    managed = F.lit(managed) if isinstance(managed, bool) else managed
    return F.struct(text.cast("string").alias("str_rep"), F.lit(dtype).alias("dtype"), managed.alias("managed"))


def asset(path: Column, type_name: str, suffix: str, managed: bool) -> Column:
    """A file asset: its path, suffix and type, and whether its file is managed."""
    return F.struct(path.alias("path"), F.lit(suffix).alias("ext"), F.lit(type_name).alias("type"), F.lit(managed).alias("managed"))


def suffix_of(path: Column) -> Column:
    """The last suffix of a path, with its point; empty if there is none."""
    return F.regexp_extract(path, SUFFIX, 1)


def checked_path(path: Column, suffix: str) -> Column:
    """The path, or an error for a path with another suffix."""
    message = F.concat(F.lit("expected a " + suffix + " file: "), path)
    return F.when(path.isNull() | (suffix_of(path) == suffix), path).otherwise(F.raise_error(message).cast("string"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` written and evaluated once, as the one element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
