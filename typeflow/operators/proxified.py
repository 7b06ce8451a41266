"""Commands whose arguments are typed values: resolved, bound, rendered, and answered with output assets."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.convert import asset
from ..plans.planner import Context
from .command import REQUIRED, Command, Output

_LITERALS = {bool: "bool", int: "int", float: "float", str: "str"}


@dataclass(frozen=True)
class ProxyCommand:
    """A command over typed values; ``via`` names the type that a parameter's value must pass through.

    Flags and nulls reach the command as they are; every other argument is resolved to a parameter, whose
    text the command takes.  A parameter with an Output default that is not given gets a new managed
    file; given or not, its asset is an output.
    """

    command: Command
    via: Mapping[str, str] = field(default_factory=dict)

    def outputs(self) -> list[str]:
        return [p.name for p in self.command.params if isinstance(p.default, Output)]

    def apply(self, df: DataFrame, key: str, given: Mapping[str, tuple[Column, str]], context: Context, folder: str) -> DataFrame:
        """``df`` with ``argv`` and a column for each output: a struct of path, type and managed.

        New files are named after the row's ``key``, so a repeated task names the same file.
        """
        unknown = set(given) - {p.name for p in self.command.params}
        if unknown:
            raise ValueError(f"unknown arguments: {sorted(unknown)}")
        texts, made = {}, {}
        for p in self.command.params:
            if p.name in given:
                value, origin = given[p.name]
            elif isinstance(p.default, Output):
                path = F.concat(F.lit(f"{folder}/{p.name}-"), F.col(key).cast("string"), F.lit(p.default.suffix))
                value, origin = asset(path, p.default.type_name, p.default.suffix, True), p.default.type_name
            elif p.default is REQUIRED:
                raise ValueError(f"missing argument: {p.name}")
            elif p.default is None:
                continue
            else:
                value, origin = F.lit(p.default), _LITERALS[type(p.default)]
            if p.kind == "flag":
                texts[p.name] = value
                continue
            param = context.resolve(value, origin, "param", self.via.get(p.name))
            texts[p.name] = F.when(value.isNotNull(), param["str_rep"])
            if isinstance(p.default, Output):
                made[p.name] = F.struct(param["str_rep"].alias("path"), param["dtype"].alias("type"), param["managed"].alias("managed"))
        optional = {p.name: F.lit(None).cast("string") for p in self.command.params if p.name not in texts}
        return df.withColumns({**made, "argv": self.command.argv({**texts, **optional})})
