"""Gapless positions and running sums over a whole table, without ordering it in one task.

Rows are dealt into ranges of the order; a small table of one row a range gives each range's start, and the rest is
ordered within ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_position(df: DataFrame, name: str, key: Column, *ties: str, by: tuple[str, ...] = (), digits: int = 3) -> DataFrame:
    """Adds the 1-based position in the order of a hexadecimal hash key, then ties, within groups of `by`. 16 ** digits ranges a group."""
    keyed = df.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, digits))
    counts = keyed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*by, "_range").orderBy("_key", *ties)
    ranked = keyed.withColumn("_in", F.row_number().over(inside)).join(starts, [*by, "_range"])
    return ranked.withColumn(name, F.col("_start") + F.col("_in")).drop("_key", "_range", "_in", "_start")


#: Ranges in which a score, or what it lacks to 1, doubles; and how often it does before the farthest range. Where there are many groups, few ranges of each are many enough.
STEPS, GROUP_STEPS = 256, 16
DOUBLINGS = 64


def range_of(score: Column, steps: int = STEPS) -> Column:
    """A whole number that never falls as the score rises from 0 to 1. Ranges get narrower towards both ends, where the scores of models pile up."""
    far = steps * DOUBLINGS
    odds = F.when(score < 0.5, F.log2(score) + 1).otherwise(-(F.log2(1 - score) + 1))
    ends = F.when(score < 0.5, F.lit(-far)).otherwise(F.lit(far))
    return F.when(odds.isNull(), ends).otherwise(F.greatest(F.lit(-far), F.least(F.lit(far), F.floor(odds * steps)))).cast("int")


def running(df: DataFrame, score: str, sums: dict[str, str], by: tuple[str, ...] = (), ascending: bool = False, totals: dict[str, str] | None = None, steps: int = STEPS) -> DataFrame:
    """Adds sums of columns from the first row to this one, in the order of a score with one row a value. sums: new name to column; totals: new name to column, over all rows.

    Both the rows and the starts of ranges come from df. Where it is an aggregate, and all its columns are used later on, Spark computes and exchanges it once for both.
    """
    totals = totals or {}
    ranged = df.withColumn("_range", range_of(F.col(score).cast("double"), steps))
    order = (lambda c: F.asc(c)) if ascending else (lambda c: F.desc(c))
    ends = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sorted({*sums.values(), *totals.values()})])
    before, every = Window.partitionBy(*by).orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    starts = ends.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_s_{n}") for n, c in sums.items()], *[F.sum(f"_t_{c}").over(every).alias(n) for n, c in totals.items()])
    inside = Window.partitionBy(*by, "_range").orderBy(order(score)).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select("*", *[F.sum(c).over(inside).alias(f"_i_{n}") for n, c in sums.items()]).join(starts, [*by, "_range"])
    for n in sums:
        out = out.withColumn(n, F.col(f"_s_{n}") + F.col(f"_i_{n}"))
    return out.drop("_range", *[f"_{x}_{n}" for n in sums for x in "si"])


def percentiles(df: DataFrame, column: str, shares: list[float], weight: str | None = None, by: tuple[str, ...] = (), steps: int = STEPS) -> DataFrame:
    """share and value: linearly interpolated percentiles of a column between 0 and 1, exact, from one row a distinct value. weight: how many rows each stands for."""
    counts = df.groupBy(*by, column).agg(F.sum(weight).alias("_n") if weight else F.count(F.lit(1)).alias("_n"))
    ends = running(counts, column, {"_end": "_n"}, by, ascending=True, totals={"_all": "_n"}, steps=steps)
    wanted = F.array(*[F.struct(F.lit(q).alias("share"), (F.lit(q) * (F.col("_all") - 1)).alias("_at")) for q in shares])
    # Each wanted rank meets the rows that hold it, or the rank above it; rows that hold none go before they are multiplied.
    first = F.col("_end") - F.col("_n")
    holds = F.filter(wanted, lambda w: (F.ceil(w["_at"]) >= first) & (F.floor(w["_at"]) < F.col("_end")))
    rows = ends.select(*by, column, "_n", "_end", F.explode(holds).alias("_w")).select(*by, column, "_n", "_end", "_w.*")
    low = (F.floor("_at") >= F.col("_end") - F.col("_n")) & (F.floor("_at") < F.col("_end"))
    high = (F.ceil("_at") >= F.col("_end") - F.col("_n")) & (F.ceil("_at") < F.col("_end"))
    found = rows.where(low | high).groupBy(*by, "share", "_at").agg(F.max(F.when(low, F.col(column))).alias("_lo"), F.max(F.when(high, F.col(column))).alias("_hi"))
    return found.select(*by, "share", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))).alias("value"))
