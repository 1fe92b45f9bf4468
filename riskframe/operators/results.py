"""Results of many runs: flattening, deduplication, pairing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import base_name, pretty_name, without_owner


def flattened(df: DataFrame, nested: str = "config", drop: tuple[str, ...] = ("plots",)) -> DataFrame:
    """Fields of the nested column as nested_field; raises if another struct or map is left."""
    fields = df.schema[nested].dataType.fieldNames()
    out = df.select("*", *[F.col(nested)[f].alias(f"{nested}_{f}") for f in fields]).drop(nested, *drop)
    if left := [f.name for f in out.schema if isinstance(f.dataType, (T.StructType, T.MapType))]:
        raise ValueError(f"still nested: {left}")
    return out


def with_model_columns(df: DataFrame, model: str) -> DataFrame:
    name = without_owner(F.col(model))
    return df.withColumn(model, name).withColumn("base_name", base_name(F.col(model))).withColumn("name", pretty_name(F.col(model))).withColumn("is_inst", (F.col("base_name") != F.col(model)) | F.lower("name").contains("(it)"))


def first_of_each(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Raises if a key repeats."""
    if repeated_keys(df, *keys).limit(1).count():
        raise ValueError(f"{keys} repeat")
    return df


def stacked(*frames: DataFrame) -> DataFrame:
    """Rows of all; columns that one lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def side_by_side(left: DataFrame, right: DataFrame, key: str, suffix: str) -> DataFrame:
    """Left join; columns of the left that the right has too get the suffix. Keys must be unique on both sides (require_unique)."""
    common = [c for c in left.columns if c in right.columns and c != key]
    return left.withColumnsRenamed({c: c + suffix for c in common}).join(right, key, "left")


def base_pairs(df: DataFrame, model: str = "model", base: str = "base_name") -> DataFrame:
    """Each instruction-tuned model with its base model."""
    a = df.select(F.col(model).alias("tuned"), F.col(base).alias("_b"))
    return a.join(df.select(F.col(model).alias("base")), (F.col("_b") == F.col("base")) & (F.col("tuned") != F.col("base"))).select("tuned", "base")


def without_names(df: DataFrame, column: str, *parts: str) -> DataFrame:
    """Rows whose name has none of the parts, in either case; rows without a name stay."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    return df.where(reduce(lambda a, b: a & b, [~low.contains(p.lower()) for p in parts], F.lit(True)))


def feature_count(features: str) -> Column:
    """How many features a run was given; -1 stands for all."""
    return F.when(F.col(features).isNotNull(), F.size(features)).otherwise(F.lit(-1))


def by_feature_count(df: DataFrame, features: str, counts: list[int], *keys: str) -> DataFrame:
    """Runs with so many features, in the order of that number; num_features is added."""
    return df.withColumn("num_features", feature_count(features)).where(F.col("num_features").isin(counts)).orderBy("num_features", *keys)


def absent_combinations(df: DataFrame, a: str, b: str) -> DataFrame:
    """Combinations of the distinct values of two columns, few of each, that no row has."""
    return df.select(a).distinct().crossJoin(df.select(b).distinct()).join(df.select(a, b).distinct(), [a, b], "left_anti")


def unscored(df: DataFrame, cache: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows whose id the cache lacks."""
    return df.join(cache.select(row_id), row_id, "left_anti")


def added_features(df: DataFrame, features: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds what each row's features have beyond the row before."""
    before = F.lag(features).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("added", F.array_except(features, F.coalesce(before, F.array().cast("array<string>"))))


def pivoted_importances(df: DataFrame, key: str) -> DataFrame:
    """From key, feature, imp_mean, imp_std: one row a key, columns feature_imp_mean and feature_imp_std."""
    return df.groupBy(key).pivot("feature").agg(F.first("imp_mean").alias("imp_mean"), F.first("imp_std").alias("imp_std"))
