"""No task holds or sorts the prompts of all rows of a split."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import inference
from riskframe.plans.benchmark import Benchmark

from .test_benchmark import TASK


class Half:
    def __call__(self, prompts):
        return [0.5] * len(prompts)


def data(spark):
    return spark.range(60).coalesce(1).select(F.col("id").alias("row_id"), (F.col("id") % 9).alias("a"), (F.col("id") % 2).cast("int").alias("b"), (F.col("id") % 7).alias("y"))


def test_rows_are_dealt_to_tasks_before_they_become_texts(spark):
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "5"}
    before = {c: spark.conf.get(c) for c in changed}
    try:
        for c, v in changed.items():
            spark.conf.set(c, v)
        b = Benchmark(TASK, data(spark), Half)
        assert b.prompts(b.data).rdd.getNumPartitions() == 5
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_prompts_are_told_apart_without_sorting_them(spark, monkeypatch):
    asked, real = [], inference.scored
    monkeypatch.setattr(inference, "scored", lambda new, *a, **k: asked.append(new) or real(new, *a, **k))
    b = Benchmark(TASK, data(spark), Half)
    assert b.scored(b.data).count() == 60
    assert "SortAggregate" not in asked[0]._jdf.queryExecution().executedPlan().toString()
