"""Conversion by a value's run-time type.

In a table a value's own type is data: a tag beside it, or what a VARIANT holds.  Every type that can occur is
planned once, on the driver, and the chains become the branches of one CASE expression, so rows of mixed types
are converted in one projection.  What cannot be converted does not end the job: the result is a
struct of ``value`` and ``error``, and one of them is null unless the value itself was.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.convert import let
from .planner import Context, NodeNotFound, NoPath

#: What a VARIANT's own schema begins with, the type that it stands for, and the Spark type it is read as.
VARIANT_TYPES = [
    ("BIGINT|INT|SMALLINT|TINYINT", "int", "bigint"),
    ("DECIMAL|DOUBLE|FLOAT", "float", "double"),
    ("BOOLEAN", "bool", "boolean"),
    ("STRING", "str", "string"),
    ("ARRAY", "tuple", "array<variant>"),
]
#: Levels of VARIANT arrays inside one another that are dispatched.
DEPTH = 3


def distinct_tags(df: DataFrame, tag: Column, most: int = 1000) -> list[str]:
    """The type tags that occur; types are few, and more than ``most`` of them are an error."""
    found = [r[0] for r in df.select(tag.alias("tag")).where("tag IS NOT NULL").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} type tags")
    return sorted(found)


def _outcome(value: Column | None, error: Column | None, kind: str) -> Column:
    value = F.lit(None).cast(kind) if value is None else value.cast(kind)
    error = F.lit(None).cast("string") if error is None else error
    return F.struct(value.alias("value"), error.alias("error"))


def resolve_tagged(context: Context, tag: Column, values: Mapping[str, Column | list], target: str, kind: str, via: str | None = None) -> Column:
    """Each row's value converted from the type that its tag names: a struct of ``value`` (of Spark type ``kind``) and ``error``.

    ``values`` has, for each type that can occur, the column that holds its values; a type with ancestors begins
    at its nearest one in the graph, and a tuple may name its elements' type (``tuple[int]``).  A tag
    without a column, one that no chain leads from, and a null tag give an error.
    """
    cases = F.when(tag.isNull(), _outcome(None, F.lit("no type"), kind))
    for name, value in values.items():
        try:
            made = _outcome(context.resolve(value, name, target, via), None, kind)
        except (NodeNotFound, NoPath):
            made = _outcome(None, F.lit(f"no chain from {name} to {target}"), kind)
        cases = cases.when(tag == name, made)
    return cases.otherwise(_outcome(None, F.concat(F.lit("unknown type: "), tag), kind))


def variant_tag(schema: Column, types: Iterable[tuple[str, str, str]] = VARIANT_TYPES) -> Column:
    """The type that a VARIANT stands for, from its own schema; the schema itself where that stands for none."""
    tag = F.when(schema.isNull(), F.lit(None).cast("string"))
    for pattern, name, _ in types:
        tag = tag.when(schema.rlike(rf"\A(?:{pattern})\b"), F.lit(name))
    return tag.otherwise(schema)


def resolve_variant(context: Context, value: Column, target: str, kind: str, via: str | None = None, depth: int = DEPTH) -> Column:
    """A VARIANT converted by the type of what it holds: a struct of ``value`` and ``error``.

    A JSON null is a null value without error.  The elements of an array are VARIANTs too, each converted by
    its own type, and the first error among them is the array's; an array more than ``depth`` levels down is an error.
    Schemas and elements are bound once, so the expression grows with the depth, not with its power.
    """
    scalars = {name: F.try_variant_get(value, "$", as_type) for _, name, as_type in VARIANT_TYPES if name != "tuple"}
    types = [t for t in VARIANT_TYPES if t[1] != "tuple" or depth > 0]
    inner = replace(context, elements=lambda outcome: outcome["value"])

    def whole(outcomes: Column) -> Column:
        wrong = F.get(F.filter(F.transform(outcomes, lambda o: o["error"]), lambda e: e.isNotNull()), F.lit(0))
        return F.when(wrong.isNotNull(), _outcome(None, wrong, kind)).otherwise(resolve_tagged(inner, F.lit("tuple"), {"tuple": outcomes}, target, kind, via))

    def made(schema: Column) -> Column:
        out = let(variant_tag(schema, types), lambda tag: resolve_tagged(context, tag, scalars, target, kind, via))
        if depth > 0:
            elements = F.try_variant_get(value, "$", "array<variant>")
            resolved = F.transform(elements, lambda v: resolve_variant(context, v, "str", "string", depth=depth - 1))
            out = F.when(schema.startswith("ARRAY"), let(resolved, whole)).otherwise(out)
        return F.when(schema == "VOID", _outcome(None, None, kind)).otherwise(out)

    return F.when(value.isNull(), _outcome(None, None, kind)).otherwise(let(F.schema_of_variant(value), made))
