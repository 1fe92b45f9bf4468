"""Scores a stream of rows; metrics are kept up from batch to batch by sums, which add up however rows arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import inference, metrics


def scored_stream(rows: DataFrame, prompt, make_backend: Callable[[], inference.Backend]) -> DataFrame:
    """rows: a streaming DataFrame. Adds prompt and risk_score; nothing is kept between batches."""
    return inference.scored(rows.withColumn("prompt", prompt), make_backend)


def windowed_counts(scored: DataFrame, time: str, width: str = "10 minutes", late: str = "10 minutes", threshold: float = 0.5, label: str = "label") -> DataFrame:
    """tn, fp, fn, tp and rates of each window of event time; rows later than the watermark are left out."""
    predicted = metrics.binarised(F.col("risk_score"), F.lit(threshold))
    grouped = scored.withWatermark(time, late).groupBy(F.window(time, width)).agg(*metrics.counts(F.col(label), predicted))
    return grouped.select("window", "tn", "fp", "fn", "tp", *[c.alias(n) for n, c in metrics.rates().items()])


def write_scores(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends Parquet, each row exactly once."""
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
