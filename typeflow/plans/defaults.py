"""The converters that every registry starts with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import convert
from .planner import Context
from .registry import CORE, Registry


def join(values: Column | list, context: Context, separator: str) -> Column:
    """A tuple's elements, each resolved to text as its own type, and joined."""
    if isinstance(values, Column):
        return convert.join_elements(values, context.elements or (lambda v: context.resolve(v, context.element, "str")), separator)
    return F.concat_ws(separator, *[context.resolve(v, kind, "str") for v, kind in values])


def default_registry() -> Registry:
    """Text forms of any value and of tuples, and parameters from text, paths and proxies."""
    registry = Registry()
    # fixed values: the Spark types that hold each type
    registry.declare("int", stored="tinyint|smallint|int|bigint")
    registry.declare("float", stored="float|double|decimal.*|tinyint|smallint|int|bigint")
    registry.declare("bool", stored="boolean")
    registry.declare("str", stored="string")
    registry.declare("path", stored="string")
    registry.declare("tuple", stored="array<.*")
    registry.declare("proxy", stored="struct<path:string.*")
    registry.declare("param", stored="struct<str_rep:string.*")
    registry.add("object", "str", convert.to_string, CORE)
    registry.add("bool", "str", convert.bool_to_string, CORE)
    for name in ("int", "float", "path"):
        registry.add(name, "str", convert.to_string, CORE)

    @registry.converter("tuple", "str", CORE, nested=True)
    def tuple_to_string(values, context):
        return join(values, context, " ")

    registry.add("str", "param", lambda v: convert.param_struct(v, "str"), CORE)
    registry.add("path", "param", lambda v: convert.param_struct(v, "path"), CORE)
    registry.add("proxy", "param", lambda v: convert.param_struct(v["path"], "proxy", F.coalesce(v["managed"], F.lit(False))), CORE)
    registry.add("str", "path", lambda v: v, CORE)
    return registry
