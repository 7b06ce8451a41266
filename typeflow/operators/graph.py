"""Set-based operators on conversion graphs held as rows.

They work on graphs of any size with joins and aggregates; the driver's planner covers
the small graphs of a program's own types.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linear import linear_order
from .search import paths_via, shortest_paths  # noqa: F401  a part of this module's interface
from .storage import checkpointed


def _first(df: DataFrame, key: list[str], order: Column, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by an aggregate, which needs no task to hold a key's rows."""
    rest = [c for c in df.columns if c not in key]
    pick = F.max_by if last else F.min_by
    found = df.groupBy(*key).agg(pick(F.struct(*rest), order).alias("__row"))
    return found.select(*[F.col(c) if c in key else F.col(f"__row.{c}").alias(c) for c in df.columns])


def dedupe_edges(edges: DataFrame, key: list[str], order: list[str], scope: str | None = None) -> DataFrame:
    """One edge for each key: the first in ``order``.

    With ``scope`` the first of each key and scope survives, and of those the last one wins.
    """
    kept = _first(edges, key + ([scope] if scope else []), F.struct(*order))
    return _first(kept, key, F.struct(*order), last=True) if scope else kept


def ancestors_closure(parents: DataFrame, position: str | None = None, levels: int = 100) -> DataFrame:
    """(sub, sup, weight): every ancestor of every type with its place in the type's linear order.

    ``parents`` has (sub, sup) rows and, where a type has several parents, their ``position``.  Types are
    ordered level by level, each once all its parents are: one parent's order is taken over whole,
    several are merged.  A type without parents is a root.
    """
    waiting = checkpointed(_parent_lists(parents, position))
    roots = parents.select(F.col("sup").alias("sub")).distinct().join(waiting, "sub", "left_anti")
    return _ranked(_lines(waiting, checkpointed(roots.select("sub", F.array("sub").alias("line"))), levels))


def _parent_lists(parents: DataFrame, position: str | None) -> DataFrame:
    """(sub, ps): every type's parents in order."""
    place = F.col(position) if position else F.lit(0)
    own = parents.groupBy("sub").agg(F.array_sort(F.collect_set(F.struct(place.alias("at"), F.col("sup")))).alias("ps"))
    return own.select("sub", F.transform("ps", lambda p: p["sup"]).alias("ps"))


def _ranked(lines: DataFrame) -> DataFrame:
    return lines.select("sub", F.posexplode("line").alias("weight", "sup")).where("weight > 0").select("sub", "sup", "weight")


def _lines(waiting: DataFrame, done: DataFrame, levels: int) -> DataFrame:
    """(sub, line): the linear orders of the types of ``waiting`` (sub, ps), from those of ``done`` (sub, line) downwards."""
    merged = F.pandas_udf(lambda lines, parents: pd.Series([linear_order([*x, p]) for x, p in zip(lines, parents)]), "array<string>")
    several = not waiting.where(F.size("ps") > 1).isEmpty()
    last, made = done, None
    for _ in range(levels):
        # a type is ready once all its parents have a line; it then has one that is new
        line_of = lambda df: df.select(F.col("sub").alias("__p"), "line")
        one = waiting.where(F.size("ps") == 1).withColumn("__p", F.col("ps")[0]).join(line_of(last), "__p")
        ready = one.select("sub", F.concat(F.array("sub"), "line").alias("line"))
        if several:
            each = waiting.where(F.size("ps") > 1).select("sub", "ps", F.posexplode("ps").alias("at", "__p")).join(line_of(done), "__p")
            full = each.groupBy("sub").agg(F.first("ps").alias("ps"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines")).where(F.size("lines") == F.size("ps"))
            whole = full.join(done, "sub", "left_anti").select("sub", merged(F.transform("lines", lambda x: x["line"]), "ps").alias("line"))
            ready = ready.unionByName(whole.select("sub", F.concat(F.array("sub"), "line").alias("line")))
        last = checkpointed(ready)
        if last.isEmpty():
            return last if made is None else made
        made = last if made is None else made.unionByName(last)
        done = done.unionByName(last)
    raise ValueError(f"types have ancestors more than {levels} levels up")


def types_below(closure: DataFrame, changed: DataFrame) -> DataFrame:
    """(sub): the types of ``changed`` (sub) and all that have one of them as an ancestor."""
    below = closure.join(changed.select(F.col("sub").alias("sup")), "sup", "left_semi").select("sub")
    return changed.select("sub").unionByName(below).distinct()


def update_closure(closure: DataFrame, parents: DataFrame, changed: DataFrame, position: str | None = None, levels: int = 100) -> DataFrame:
    """The closure of ``parents`` from that of earlier ones, when just the types of ``changed`` (sub) have got, or lost, parents.

    A type's order depends on what is above it alone, so only the changed types and those below them are ordered
    anew, from the orders of their other parents that are there; all other rows are kept as they are.
    """
    touched = checkpointed(types_below(closure, changed))
    waiting = checkpointed(_parent_lists(parents.join(touched, "sub", "left_semi"), position))
    above = waiting.select(F.explode("ps").alias("sub")).distinct().join(touched, "sub", "left_anti")
    known = closure.join(above, "sub", "left_semi").groupBy("sub").agg(F.array_sort(F.collect_list(F.struct("weight", "sup"))).alias("ups"))
    line = F.concat(F.array("sub"), F.coalesce(F.transform("ups", lambda u: u["sup"]), F.array().cast("array<string>")))
    roots = touched.join(waiting, "sub", "left_anti").select("sub", F.array("sub").alias("line"))  # those that have no parents now
    lines = above.join(known, "sub", "left").select("sub", line.alias("line")).unionByName(roots)
    made = _ranked(_lines(waiting, checkpointed(lines), levels))
    return closure.join(touched, "sub", "left_anti").select("sub", "sup", "weight").unionByName(made)


def expand_scopes(scope: Column) -> Column:
    """All dotted prefixes of a scope."""
    parts = F.split(scope, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def parent_scope(scope: Column) -> Column:
    parts = F.split(scope, "[.]")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), ".")


def visible_scopes(seen: DataFrame, registered: DataFrame) -> DataFrame:
    """Scopes (one column each) that are both seen and registered."""
    return seen.intersect(registered)


def visible_to_callers(seen: DataFrame, registered: DataFrame, caller: str, scope: str) -> DataFrame:
    """(caller, scope): for each of many callers the scopes that it sees and that some converter, or one below them, lives in.

    Scopes have a handful of prefixes, so both sides are expanded and joined by equality, which Spark deals over tasks; an
    interval of tree positions would need a join by range.
    """
    wide = lambda df, *keys: df.select(*keys, F.explode(expand_scopes(F.col(scope))).alias(scope)).distinct()
    return wide(seen, caller).join(wide(registered), scope, "left_semi").select(caller, scope)


def edges_in_scope(edges: DataFrame, visible: DataFrame, on: str) -> DataFrame:
    return edges.join(visible, on, "left_semi")


def lift_scope(scope: Column, origin: str, ancestor: str) -> Column:
    """The scope, with ``origin`` itself moved to its ancestor."""
    return F.when(scope == origin, F.lit(ancestor)).otherwise(scope)


def rank_candidates(edges: DataFrame, key: list[str], cost: Column, foreign: Column, depth: Column, order: list[str]) -> DataFrame:
    """The best edge of each key: least cost, local before foreign, deeper scope first, then ``order``."""
    return _first(edges, key, F.struct(cost.alias("cost"), foreign.alias("foreign"), (-depth).alias("depth"), *order))


def nearest_ancestor(ancestry: DataFrame, nodes: DataFrame, key: str, ancestor: str, depth: str) -> DataFrame:
    """For each key its nearest ancestor that is a node of the graph; of equally near ones the least."""
    found = ancestry.join(nodes, ancestor, "left_semi").groupBy(key)
    return found.agg(F.min(F.struct(depth, ancestor)).alias("__near")).select(key, F.col(f"__near.{ancestor}").alias(ancestor))
