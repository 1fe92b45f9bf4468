"""Binary targets: a column compared with a value."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import missing

#: The operators that a target's name may have. For each, whether a lesser, an equal and a greater value count.
OPERATORS = {">": (0, 0, 1), "<": (1, 0, 0), ">=": (0, 1, 1), "<=": (1, 1, 0), "==": (0, 1, 0), "!=": (1, 0, 1)}


def compared(x: Column, op: str, value: float | int) -> Column:
    """0 or 1. A missing value (null or NaN) is neither less, equal nor greater: only what differs from the value holds for it."""
    if op not in OPERATORS:
        raise ValueError(f"{op!r} compares nothing; operators are {' '.join(OPERATORS)}")
    less, equal, greater = OPERATORS[op]
    v = F.lit(value)
    return F.when(missing(x), F.lit(int(less and greater))).when(x < v, F.lit(less)).when(x == v, F.lit(equal)).otherwise(F.lit(greater))


class Threshold(NamedTuple):
    """What a target is compared with, and how."""

    value: float | int
    op: str

    def name(self, column: str) -> str:
        """Such as PINCP>50000; needs back-ticks in expressions."""
        return f"{column}{self.op}{self.value}"

    def of(self, x: Column) -> Column:
        return compared(x, self.op, self.value)

    def add(self, df: DataFrame, column: str) -> DataFrame:
        """Adds the derived column, unless it is there already."""
        name = self.name(column)
        return df if name in df.columns else df.withColumn(name, self.of(F.col(f"`{column}`")))
