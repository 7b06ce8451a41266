"""The linear order of a type's ancestors."""

from __future__ import annotations

from collections.abc import Iterable


def linear_order(sequences: Iterable[Iterable[str]]) -> list[str]:
    """One order that keeps the order of every sequence (the C3 rule); an error if there is none.

    Each step takes the first sequence whose head stands in no other sequence's tail.
    """
    left = [s for s in map(list, sequences) if s]
    order: list[str] = []
    while left:
        head = next((s[0] for s in left if not any(s[0] in t[1:] for t in left)), None)
        if head is None:
            raise ValueError(f"no linear order of {sorted({s[0] for s in left})}")
        order.append(head)
        left = [t for t in ([x for x in s if x != head] for s in left) if t]
    return order
