"""Planning of conversion chains, and their compilation to one Column.

The graph is tiny (types, not rows), so the search runs on the driver: the cheapest chain by
summed weight, ties going to an edge inside the caller's scope, then to the deeper scope, then to
the earlier registration; a node's way is fixed when it leaves the queue.
"""

from __future__ import annotations

import functools
import heapq
import inspect
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column

from . import scopes
from .registry import CORE, Edge, Registry


class NodeNotFound(LookupError):
    """An end of the wanted chain is no node of the visible graph."""


class NoPath(LookupError):
    """No chain of visible converters leads to the target."""


def rank(edge: Edge, caller: str) -> tuple[bool, int, int]:
    """Order among edges of equal cost: local first, then deeper scopes, then earlier ones."""
    return (not scopes.within(edge.scope, caller), -scopes.depth(edge.scope), edge.seq)


def shortest_path(edges: Iterable[Edge], origin: str, target: str, via: str | None = None, caller: str = "") -> list[Edge]:
    """The chain from ``origin`` to ``target``; with ``via`` two chains that meet there, which may pass a node twice."""
    if via is not None:
        edges = list(edges)
        return shortest_path(edges, origin, via, caller=caller) + shortest_path(edges, via, target, caller=caller)
    out: dict[str, list[Edge]] = {}
    nodes = set()
    for e in edges:
        out.setdefault(e.src, []).append(e)
        nodes |= {e.src, e.dst}
    for end in (origin, target):
        if end not in nodes:
            raise NodeNotFound(end)
    came: dict[str, Edge | None] = {}
    queue: list[tuple] = [((0, False, 0, -1), origin, None)]
    while queue:
        (cost, *_), node, edge = heapq.heappop(queue)
        if node in came:
            continue
        came[node] = edge
        if node == target:
            chain = []
            while (edge := came[node]) is not None:
                chain.append(edge)
                node = edge.src
            return chain[::-1]
        for e in out.get(node, ()):
            if e.dst not in came:
                heapq.heappush(queue, ((cost + e.weight, *rank(e, caller)), e.dst, e))
    raise NoPath(f"{origin} -> {target}")


@dataclass(frozen=True)
class Context:
    """What a resolution sees; nested resolutions inherit it."""

    registry: Registry
    seen: frozenset[str] = frozenset({CORE})
    caller: str = ""
    #: The type of the elements of the tuple that is being resolved.
    element: str = "float"
    #: How an element becomes text where its type is known at run time only.
    elements: Callable[[Column], Column] | None = field(default=None, compare=False, repr=False)
    _memo: dict = field(default_factory=dict, compare=False, repr=False)

    def inside(self, scope: str) -> Context:
        """The context of code in ``scope``, which sees that scope too."""
        return Context(self.registry, self.seen | {scope, CORE}, scope)

    def plan(self, origin: str, target: str, via: str | None = None) -> list[Edge]:
        """The steps from one type to another; none if they are the same, whatever ``via`` is."""
        if origin == target:
            return []
        key = (self.registry.version, origin, target, via)
        if key not in self._memo:
            wide = scopes.visible(self.seen, self.registry.scopes())
            edges = [e for e in self.registry.edges() if e.scope in wide]
            nodes = {e.src for e in edges} | {e.dst for e in edges}
            start = next((t for t in self.registry.ancestors(origin) if t in nodes), origin)
            self._memo[key] = shortest_path(edges, start, target, via, self.caller)
        return self._memo[key]

    def resolve(self, value: Column | list, origin: str, target: str, via: str | None = None) -> Column:
        """``value`` converted by the planned steps, as one expression; its Spark type is checked at both ends.

        A tuple is an array, whose elements' type may be named (``tuple[bool]``), or a list of (Column, type).
        """
        origin, _, element = origin.partition("[")
        inner = replace(self, element=element.removesuffix("]")) if element else self
        steps = self.plan(origin, target, via)
        if isinstance(value, Column):
            value = self.registry.checked(value, origin, "value")
        for step in steps:
            value = step.build(value, inner) if step.nested else step.build(value)
        return self.registry.checked(value, target, "result") if steps else value

    def describe(self, origin: str, target: str, via: str | None = None) -> str:
        """The planned steps as text."""
        steps = self.plan(origin, target, via)
        return "\n".join(f"{e.src} -> {e.dst} by {e.name} in {e.scope}" for e in steps) or f"{origin}: passed on"


@dataclass(frozen=True)
class Resolve:
    """Annotation of a parameter: convert to ``target``, by way of ``via``."""

    target: str
    via: str | None = None


def resolve_params(context: Context) -> Callable:
    """Decorator: parameters annotated with a Resolve take (Column, type name) pairs and get converted Columns."""

    def decorate(function: Callable) -> Callable:
        signature = inspect.signature(function, eval_str=True)

        @functools.wraps(function)
        def wrapped(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            for name, value in bound.arguments.items():
                wanted = signature.parameters[name].annotation
                if isinstance(wanted, Resolve):
                    column, origin = value
                    bound.arguments[name] = context.resolve(column, origin, wanted.target, wanted.via)
            return function(*bound.args, **bound.kwargs)

        return wrapped

    return decorate
