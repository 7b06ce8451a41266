"""One presentation function for each kind of file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

_SHOWN: dict[str, Callable[[DataFrame], object]] = {}


def visualizer(suffix: str) -> Callable:
    """Decorator that registers the function for a suffix; a suffix has one only."""

    def register(function: Callable[[DataFrame], object]) -> Callable[[DataFrame], object]:
        if suffix in _SHOWN:
            raise ValueError(f"{suffix} already has a visualizer")
        _SHOWN[suffix] = function
        return function

    return register


def show(df: DataFrame, suffix: str) -> object:
    if suffix not in _SHOWN:
        raise LookupError(f"no visualizer for {suffix}")
    return _SHOWN[suffix](df)
