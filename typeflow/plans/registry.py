"""The converter registry: a scoped, weighted graph over type names.

A converter is a builder from Column to Column, so a planned chain compiles to one expression.
Edges are keyed by origin, target and scope: two scopes may each have a converter for a pair,
and the planner ranks them.  Types may declare parents; registering a converter adds identity
edges from its types to all their ancestors, weighted by their place in the type's linear order.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert
from ..functions.linear import linear_order
from . import scopes

Build = Callable[[Column], Column]
CORE = "typeflow"


def identity(value: Column) -> Column:
    return value


@dataclass(frozen=True)
class Edge:
    src: str
    dst: str
    weight: int
    scope: str
    seq: int
    build: Build
    #: True if ``build`` takes the resolving context too, to convert what is inside the value.
    nested: bool = False

    @property
    def name(self) -> str:
        return getattr(self.build, "__qualname__", repr(self.build))


class Registry:
    """Types with their parents, and the conversion edges between them."""

    def __init__(self):
        self._parents: dict[str, tuple[str, ...]] = {}
        self._edges: dict[tuple[str, str, str], Edge] = {}
        self._stored: dict[str, str] = {}
        self.version = 0

    def declare(self, name: str, *parents: str, suffix: str | None = None, stored: str | None = None) -> str:
        """A type with its direct parents.

        One with ``suffix`` also gets a checked converter from ``path``; if it is a proxy, that makes an
        asset and another one makes its parameter.  ``stored`` is a pattern of the Spark types that hold it.
        """
        for p in parents:
            self._parents.setdefault(p, ())
        self._parents[name] = parents
        if stored is not None:
            self._stored[name] = stored
        self.version += 1
        if suffix is not None and "proxy" in self.ancestors(name):
            self.add("path", name, lambda value: convert.asset(convert.checked_path(value, suffix), name, suffix, False), scope=CORE)
            self.add(name, "param", lambda value: convert.param_struct(value["path"], name, F.coalesce(value["managed"], F.lit(False))), scope=CORE)
        elif suffix is not None:
            self.add("path", name, lambda value: convert.checked_path(value, suffix), scope=CORE)
        return name

    def checked(self, value: Column, name: str, what: str) -> Column:
        """``value``, or an error if its Spark type is none that holds ``name``.

        The type is known when a query is analysed, so a check that holds folds away.
        """
        pattern = next((self._stored[t] for t in self.ancestors(name) if t in self._stored), None)
        if pattern is None:
            return value
        kind = F.typeof(value)
        message = F.concat(F.lit(f"{what}: {name} expected, not "), kind)
        return F.when(kind.rlike(rf"\A(?:{pattern})\z"), value).otherwise(F.raise_error(message))

    def ancestors(self, name: str) -> list[str]:
        """The type and its ancestors in linear order, each once; every type ends in ``object``."""
        if name == "object":
            return ["object"]
        parents = [p for p in self._parents.get(name, ()) if p != "object"]
        return [name, *linear_order([*(self.ancestors(p) for p in parents), parents, ["object"]])]

    def add(self, src: str, dst: str, build: Build, scope: str, nested: bool = False) -> None:
        """One converter.  In a scope the first converter of a pair stays, and another one is warned of."""
        key = (src, dst, scope)
        known = self._edges.get(key)
        if known is not None and known.build is not identity:
            if known.build is not build:
                warnings.warn(f"{src} -> {dst} already has a converter in {scope}; the first is kept", stacklevel=2)
            return
        self._edges[key] = Edge(src, dst, 0, scope, len(self._edges), build, nested)
        for t in (src, dst):
            for distance, ancestor in enumerate(self.ancestors(t)):
                # an explicit converter to an ancestor is never replaced by the identity
                if distance and (t, ancestor, CORE) not in self._edges:
                    self._edges[(t, ancestor, CORE)] = Edge(t, ancestor, distance, CORE, len(self._edges), identity)
        self.version += 1

    def converter(self, src: str, dst: str, scope: str, nested: bool = False) -> Callable[[Build], Build]:
        """Decorator that registers a builder."""

        def register(build: Build) -> Build:
            self.add(src, dst, build, scope, nested)
            return build

        return register

    def lift(self, scope: str, ancestor: str) -> None:
        """Move the converters of just ``scope`` (not of scopes below it) up to one of its ancestors."""
        if not scopes.within(scope, ancestor):
            raise ValueError(f"{ancestor} is no ancestor of {scope}")
        moved = {}
        for (src, dst, s), edge in self._edges.items():
            key = (src, dst, ancestor if s == scope else s)
            moved.setdefault(key, replace(edge, scope=key[2]))
        self._edges = moved
        self.version += 1

    def edges(self) -> list[Edge]:
        return list(self._edges.values())

    def scopes(self) -> set[str]:
        return {e.scope for e in self._edges.values()}

    def table(self, spark: SparkSession) -> DataFrame:
        """The edges as rows for the set-based graph operators."""
        rows = [(e.src, e.dst, e.weight, e.scope, e.name, e.seq) for e in self.edges()]
        return spark.createDataFrame(rows, "src string, dst string, weight int, module string, resolver string, seq long")
