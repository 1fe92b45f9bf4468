"""Where queries and their SQL are kept, and what they have in common."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import uniform

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, label, risk_score, segment, nation: orders above a price, with scores that partly follow the label."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    label = (F.col("o_totalprice") > 250000).cast("int")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("row_id"), label.alias("label"), (0.3 * label + 0.7 * uniform("o_orderkey", 42)).alias("risk_score"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")
    )


#: In DuckDB.
HASH32 = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
SCORES = f"""scores AS (
  SELECT o_orderkey AS row_id, CAST(o_totalprice > 250000 AS INT) AS label,
         0.3e0 * CAST(o_totalprice > 250000 AS INT) + 0.7e0 * (({HASH32.format("CAST(o_orderkey AS VARCHAR) || ':42'")} % 10000) / 10000e0) AS risk_score,
         c_mktsegment AS segment, c_nationkey AS nation
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
COUNTS = "count(*) FILTER (label=0 AND p=0) AS tn, count(*) FILTER (label=0 AND p=1) AS fp, count(*) FILTER (label=1 AND p=0) AS fn, count(*) FILTER (label=1 AND p=1) AS tp"
RATES = """(tp+tn)/(tp+tn+fp+fn) AS accuracy, CASE WHEN tp+fn=0 THEN 0e0 ELSE tp/(tp+fn) END AS tpr, CASE WHEN tp+fn=0 THEN 1e0 ELSE fn/(tp+fn) END AS fnr,
  CASE WHEN fp+tn=0 THEN 1e0 ELSE fp/(fp+tn) END AS fpr, CASE WHEN fp+tn=0 THEN 0e0 ELSE tn/(fp+tn) END AS tnr,
  0.5e0*(CASE WHEN tp+fn=0 THEN 0e0 ELSE tp/(tp+fn) END + CASE WHEN fp+tn=0 THEN 0e0 ELSE tn/(fp+tn) END) AS balanced_accuracy,
  CASE WHEN tp+fp=0 THEN 0e0 ELSE tp/(tp+fp) END AS "precision", (tp+fp)/(tp+tn+fp+fn) AS ppr"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])
