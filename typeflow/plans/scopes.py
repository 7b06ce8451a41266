"""Dotted scopes on the driver: expansion, parents, visibility and locality."""

from __future__ import annotations

from collections.abc import Iterable


def expand(scope: str) -> set[str]:
    """Every dotted prefix of a scope, itself included: a.b.c gives a, a.b and a.b.c."""
    parts = scope.split(".")
    return {".".join(parts[: n + 1]) for n in range(len(parts))}


def parent(scope: str, steps: int = 1) -> str:
    """The scope without its last ``steps`` parts, and without a trailing local-scope mark."""
    parts = scope.split(".")
    parts = parts[: max(len(parts) - steps, 0)]
    if parts and parts[-1] == "<locals>":
        parts.pop()
    return ".".join(parts)


def visible(seen: Iterable[str], registered: Iterable[str]) -> frozenset[str]:
    """Scopes that a caller sees and that some converter, or a converter below them, lives in."""
    expand_all = lambda names: set().union(*map(expand, names))
    return frozenset(expand_all(seen) & expand_all(registered))


def within(scope: str, outer: str) -> bool:
    """True if ``outer`` is the scope or a dotted ancestor; a module-level caller is its module."""
    outer = outer.removesuffix(".<module>")
    return scope == outer or scope.startswith(outer + ".")


def depth(scope: str) -> int:
    return scope.count(".") + 1
