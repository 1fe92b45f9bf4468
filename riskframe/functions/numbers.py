"""Numbers: validity, division, rounding, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(x: Column) -> Column:
    """Neither null nor NaN; text that isn't a number is valid."""
    return x.isNotNull() & ~F.coalesce(F.isnan(x.try_cast("double")), F.lit(False))


def missing(x: Column) -> Column:
    return ~valid(x)


def safe_division(a: Column, b: Column, worst: float) -> Column:
    """a / b, or the worst value where that isn't a number."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return F.when(q.isNull() | F.isnan(q), F.lit(float(worst))).otherwise(q)


def clip01(x: Column) -> Column:
    """Null and NaN are no scores: both give null."""
    return F.when(valid(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def both_classes(score: Column) -> Column:
    """The probabilities of the labels 0 and 1."""
    return F.array(1 - score, score)


def positive_class(scores: Column) -> Column:
    """Of one or two columns of scores the last."""
    return F.element_at(scores, -1)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def is_close(a: Column, b: Column, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def ceil_div(a: Column, b: int | float) -> Column:
    return F.ceil(a / b)


def hash_key(*parts: Column | str | int) -> Column:
    """Hexadecimal MD5 of the parts, joined by colons: an order that looks random but is the same in each run and engine."""
    columns = [F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *columns))


def hash_int(key: Column) -> Column:
    """The first 32 bits of a hash_key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def hash_long(key: Column) -> Column:
    """The first 60 bits of a hash_key."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """A multiple of 1/10000 in [0, 1)."""
    return (hash_int(hash_key(*parts)) % 10000) / 10000.0

