"""Columns that are carried through an operator, under names that do not clash with its results."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType


def quoted(name: str) -> Column:
    """A column by its exact name, also with dots in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_numbers(rows: DataFrame, *names: str) -> None:
    """Refuse ids that are no whole numbers before anything runs, as they would be lost in a cast."""
    for name in names:
        kind = rows.select(quoted(name)).schema[0].dataType
        if not isinstance(kind, IntegralType | NullType):
            raise TypeError(f"{name} must hold whole numbers, not {kind.simpleString()}; number the rows first, such as by xxhash64")


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, with ``_in`` behind it as often as it takes to differ from ``taken`` (in any case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_in"
    return name


class Carried:
    """``names`` in one struct on the way; one that bears a result's name comes out with ``_in`` behind it."""

    def __init__(self, names: Sequence[str], results: Sequence[str]):
        self.pairs: list[tuple[str, str]] = []
        for name in names:
            self.pairs.append((name, free(name, [*results, *(new for _, new in self.pairs)])))

    def struct(self) -> Column:
        return F.struct(*[quoted(name).alias(f"c{i}") for i, (name, _) in enumerate(self.pairs)], F.lit(0).alias("_"))

    def columns(self, rest: str) -> list[Column]:
        return [F.col(f"{rest}.c{i}").alias(new) for i, (_, new) in enumerate(self.pairs)]


def with_result(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` and ``value`` as ``name``; a column that has this name is kept with ``_in`` behind it."""
    others = [c for c in rows.columns if c.lower() != name.lower()]
    old = [quoted(c).alias(free(c, [*others, name])) if c.lower() == name.lower() else quoted(c) for c in rows.columns]
    return rows.select(*old, value.alias(name))
