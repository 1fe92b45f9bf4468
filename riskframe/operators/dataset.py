"""Tables of records: checks, filters, splits and samples that depend on row ids and a seed only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import hash_key
from .positions import with_position


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require(df: DataFrame, required: list[str]) -> DataFrame:
    if gone := missing_columns(df, required):
        raise ValueError(f"columns are missing: {gone}")
    return df


def filtered(df: DataFrame, population: dict[str, object]) -> DataFrame:
    """Rows that have all the given values."""
    require(df, list(population))
    return df.where(reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.lit(v) for k, v in population.items()], F.lit(True)))


def split(df: DataFrame, *, test: float, val: float = 0.0, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Adds split (train, test or val) and split_rank (from 1). Sizes are exact: train has int(n * (1 - test - val)) rows, test goes
    on to int(n * (1 - val)), val has the rest; without val, the rest belongs to none and goes."""
    if not 0 < test + val < 1:
        raise ValueError("shares of test and val must leave some rows for training")
    placed = with_position(df, "_p", hash_key(row_id, seed), row_id)
    ends = df.agg(F.count(F.lit(1)).alias("_n")).select(F.expr(f"cast(floor(_n * {1 - test - val!r}D + 1e-9D) as bigint)").alias("_train"), F.expr(f"cast(floor(_n * {1 - val!r}D + 1e-9D) as bigint)").alias("_test"))
    p = F.col("_p")
    name = F.when(p <= F.col("_train"), "train").when(p <= F.col("_test"), "test").otherwise("val")
    rank = F.when(p <= F.col("_train"), p).when(p <= F.col("_test"), p - F.col("_train")).otherwise(p - F.col("_test"))
    out = placed.crossJoin(ends).withColumn("split", name).withColumn("split_rank", rank).drop("_p", "_train", "_test")
    return out if val > 0 else out.where("split <> 'val'")


def subsample(df: DataFrame, share: float, *, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """The first int(size * share + 0.5) rows of each split, in the split's own order. Rows are ranked anew, so that a filter after the split doesn't change the share."""
    sizes = df.groupBy("split").agg(F.floor(F.count(F.lit(1)) * F.lit(share) + 0.5).alias("_k"))
    ranked = with_position(df.drop("split_rank"), "split_rank", hash_key(row_id, seed), row_id, by=("split",))
    return ranked.join(sizes, "split").where("split_rank <= _k").drop("_k").select(*df.columns)


def rows_at(df: DataFrame, split: str, start: int, stop: int | None = None) -> DataFrame:
    """Rows of a split from one place (from 0) up to another, or to the end, in the split's order."""
    if split not in ("train", "test", "val"):
        raise ValueError(f"no split is called {split}")
    rank = F.col("split_rank")
    kept = (F.col("split") == split) & (rank > start)
    return df.where(kept if stop is None else kept & (rank <= stop))


def sample(df: DataFrame, n: int, *, seed: int = 42, draw: int = 0, row_id: str = "row_id") -> DataFrame:
    """n rows by the order of a hash; another draw, other rows."""
    return df.orderBy(hash_key(row_id, seed, draw), row_id).limit(n)


def balanced_counts(labels: list, n: int) -> dict:
    """As equal as can be; the first labels get what is left over."""
    ordered = sorted(labels)
    return {x: n // len(ordered) + (i < n % len(ordered)) for i, x in enumerate(ordered)}


def stratified(df: DataFrame, counts: dict, label: str, *, seed: int = 42, row_id: str = "row_id", check: bool = True) -> DataFrame:
    """So many rows of each label, in the order of a hash. Raises if a label has fewer."""
    wanted = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    if check:
        have = {r[0]: r[1] for r in df.where(F.col(label).isin(list(counts))).groupBy(label).count().collect()}
        if short := {k: have.get(k, 0) for k, v in counts.items() if have.get(k, 0) < v}:
            raise ValueError(f"labels with too few rows: {short}")
    placed = with_position(df.where(F.col(label).isin(list(counts))), "_p", hash_key(row_id, seed), row_id, by=(label,))
    return placed.where(F.col("_p") <= wanted[F.col(label)]).drop("_p")


def head_per_group(df: DataFrame, group: str, k: int, order: str) -> DataFrame:
    """The first k rows of each group. Spark keeps k rows of a group in each task before they meet."""
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return ranked.where(F.col("_k") <= k).drop("_k")


def permuted(df: DataFrame, column: str, *, seed: int, row_id: str = "row_id") -> DataFrame:
    """The column's values dealt anew over the rows: the row at position p by id gets the value at position p by hash."""
    a = with_position(df, "_p", F.md5(F.col(row_id).cast("string")), row_id)
    b = with_position(df.select(row_id, F.col(column).alias("_v")), "_p", hash_key(row_id, seed), row_id).select("_p", "_v")
    return a.join(b, "_p").withColumn(column, F.col("_v")).drop("_p", "_v")


def validity(df: DataFrame, columns: list[str]) -> Column:
    """Whether any of the columns is null."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
