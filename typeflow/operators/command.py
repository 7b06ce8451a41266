"""Command lines from typed rows.

A spec lists a program's parameters; rendering gives an ``array<string>`` per row.  Positional
parameters become ``-name value`` and keyword ones ``--name value``; keyword booleans are flags;
null arguments are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.convert import to_string

REQUIRED = object()


@dataclass(frozen=True)
class Output:
    """A default that asks for a new managed file of a type."""

    type_name: str
    suffix: str


@dataclass(frozen=True)
class Param:
    """A parameter: ``kind`` is 'positional', 'keyword' or 'flag'."""

    name: str
    kind: str = "positional"
    default: object = REQUIRED
    #: Name on the command line, if it differs.
    label: str | None = None
    #: Pattern that the argument's whole text must match.
    pattern: str | None = None

    def __post_init__(self):
        if self.kind not in ("positional", "keyword", "flag"):
            raise ValueError(f"{self.name}: unknown kind {self.kind}")
        if self.kind == "flag" and self.pattern is not None:
            raise ValueError(f"{self.name}: a flag has no text to match")
        if self.kind == "positional" and isinstance(self.default, bool):
            raise ValueError(f"{self.name}: booleans are keyword flags")


def bind_defaults(params: list[Param], given: Mapping[str, Column]) -> dict[str, Column]:
    """Arguments in declared order; a null or absent one takes its default."""
    unknown = set(given) - {p.name for p in params}
    if unknown:
        raise ValueError(f"unknown arguments: {sorted(unknown)}")
    bound = {}
    for p in params:
        if p.name not in given and (p.default is REQUIRED or isinstance(p.default, Output)):
            raise ValueError(f"missing argument: {p.name}")
        default = None if p.default is REQUIRED or isinstance(p.default, Output) else F.lit(p.default)
        value = given.get(p.name)
        bound[p.name] = default if value is None else value if default is None else F.coalesce(value, default)
    return bound


def rename(name: Column, names: Mapping[str, str]) -> Column:
    """The program's name of an argument; one that is not mapped keeps its own."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(pairs, name), name)


def flag(label: str, value: Column) -> Column:
    """The flag's tokens: its label if the value is true, none if it is false or null."""
    return F.when(F.coalesce(value.cast("boolean"), F.lit(False)), F.array(F.lit(label))).otherwise(F.array().cast("array<string>"))


def labelled(label: str, value: Column) -> Column:
    """A label and its value's text as tokens; an array is one token by its text form, a null value gives none at all."""
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit(label), to_string(value)))


def drop_nulls(values: Column) -> Column:
    return F.array_compact(values)


def matches(value: Column, pattern: str) -> Column:
    """True if the pattern matches the whole text; null for null."""
    return to_string(value).rlike(rf"\A(?:{pattern})\z")


@dataclass(frozen=True)
class Command:
    """A program under a launcher; ``postprocess`` may rearrange the array of [label, value] arrays."""

    program: str
    params: list[Param]
    launcher: tuple[str, ...] = ()
    postprocess: Callable[[Column], Column] | None = field(default=None)

    def __post_init__(self):
        names = [p.name for p in self.params]
        if len(set(names)) < len(names):
            raise ValueError(f"{self.program}: a parameter is declared twice")

    def invalid(self, given: Mapping[str, Column]) -> Column:
        """The names of arguments whose text does not match, as an array."""
        bound = bind_defaults(self.params, given)
        checks = [F.when(~F.coalesce(matches(bound[p.name], p.pattern), F.lit(True)), F.lit(p.name)) for p in self.params if p.pattern]
        return drop_nulls(F.array(*checks)) if checks else F.array().cast("array<string>")

    def arguments(self, given: Mapping[str, Column]) -> Column:
        """The tokens of all arguments, after ``postprocess``."""
        bound = bind_defaults(self.params, given)
        pairs = []
        for p in self.params:
            label = ("-" if p.kind == "positional" else "--") + (p.label or p.name)
            pairs.append(flag(label, bound[p.name]) if p.kind == "flag" else labelled(label, bound[p.name]))
        groups = F.filter(F.array(*pairs), lambda g: F.size(g) > 0)
        if self.postprocess is not None:
            groups = self.postprocess(groups)
        return F.flatten(groups)

    def argv(self, given: Mapping[str, Column], strict: bool = True) -> Column:
        """The tokens to run; with ``strict`` a row with an invalid argument is an error."""
        tokens = F.concat(F.array(*[F.lit(t) for t in (*self.launcher, self.program)]), self.arguments(given))
        if not strict or not any(p.pattern for p in self.params):
            return tokens
        bad = self.invalid(given)
        message = F.concat(F.lit(f"{self.program}: invalid "), F.array_join(bad, ", "))
        return F.when(F.size(bad) == 0, tokens).otherwise(F.raise_error(message).cast("array<string>"))

    def text(self, given: Mapping[str, Column], strict: bool = True) -> Column:
        """The tokens joined by spaces, for reading only: it is never run."""
        return F.array_join(self.argv(given, strict), " ")


def bound_programs(launcher: tuple[str, ...] = (), prefix: str = "") -> dict[str, Command]:
    """The commands of the three bound programs; where they are installed decides launcher and prefix."""
    volume = r".+\.vol"
    # fixed values: the programs' own parameter names
    return {
        "volume_from_pdb": Command(
            prefix + "volume_from_pdb",
            [
                Param("inputs", label="i"),
                Param("outputs", label="o"),
                Param("center_pdb", "keyword", label="centerPDB"),
                Param("sampling", "keyword"),
                Param("size", "keyword"),
            ],
            launcher,
        ),
        "volume_align": Command(
            prefix + "volume_align",
            [
                Param("reference_map", "keyword", label="i1"),
                Param("volume", "keyword", label="i2"),
                Param("local", "flag"),
                Param("apply", "keyword", pattern=volume),
            ],
            launcher,
        ),
        "transform_threshold": Command(
            prefix + "transform_threshold",
            [
                Param("inputs", label="i", pattern=volume),
                Param("outputs", label="o", pattern=volume),
                Param("select", "keyword"),
                Param("substitute", "keyword"),
            ],
            launcher,
        ),
    }
