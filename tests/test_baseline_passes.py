"""Boosted trees read one row for rows that are alike; a baseline makes its split once."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import boosting
from riskframe.plans import baselines


def rows(spark):
    own = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") % 5).cast("double").alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).cast("double").alias("b"), (F.col("id") % 5 + F.col("id") % 3 > 3).cast("int").alias("label"))
    return own.withColumn("split", F.when(F.col("row_id") % 10 < 7, "train").otherwise("test"))


def test_trees_grow_from_one_row_for_equal_bins(spark, monkeypatch):
    read, real = [], boosting._grow
    monkeypatch.setattr(boosting, "_grow", lambda table, *a: read.append((table.count(), table.agg(F.sum("h")).first()[0])) or real(table, *a))
    model = boosting.fit(rows(spark), ["a", "b"], trees=1, depth=2)
    assert len(model.trees) == 1 and read[0][0] <= 2 * 5 * 4
    share = rows(spark).agg(F.avg("label")).first()[0]
    assert abs(read[0][1] / boosting.UNIT - 2000 * share * (1 - share)) < 0.01  # all rows count


def test_split_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = rows(spark).select("row_id", "a", "b", "label", "split")
    counted = df.mapInArrow(seen, df.schema)
    for model, settings in (("XGBoost", {"trees": 2, "depth": 2}), ("LR", {})):
        before = made.value
        found = baselines.fit_and_evaluate(counted, ["a", "b"], model, **settings).collect()
        assert found[0]["n_samples"] == 600 and made.value - before == 2000
