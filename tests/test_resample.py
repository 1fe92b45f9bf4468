"""Exact resamples: the draws are those of the hashes one by one, and aren't exchanged as rows."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskframe.operators import metrics


def number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def exchanged(plan) -> int:
    """Rows that the exchanges of an executed plan wrote."""
    m = plan.metrics().get("shuffleRecordsWritten")
    return (m.get().value() if m.isDefined() else 0) + sum(exchanged(plan.children().apply(i)) for i in range(plan.children().size()))


def test_draws_are_not_exchanged_one_by_one(spark):
    n, k = 3000, 50
    rows = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 20 / 20).alias("risk_score"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    # As on a large table: what isn't small by nature isn't broadcast.
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {c: spark.conf.get(c) for c in changed}
    try:
        for c, v in changed.items():
            spark.conf.set(c, v)
        out = metrics.bootstrap(rows, k=k)
        assert len(out.collect()) == 13
        assert exchanged(out._jdf.queryExecution().executedPlan()) < n * k / 2
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


@pytest.mark.parametrize("size", [1 << 17, 100])
def test_counts_are_those_of_the_draws(spark, size):
    """In many small blocks and slices, too; with a score that most rows share, and labels that are missing."""
    from riskframe.operators import resample

    own = {"k": 5, "seed": 42, "row_id": "row_id", "score": "risk_score", "label": "label", "size": size, "most": 3 * size}
    rows = [(i, 0.5 if i % 2 else (i % 40) / 40, None if i % 11 == 0 else int(i % 3 == 0)) for i in range(1234)]
    df = spark.createDataFrame(rows, "row_id long, risk_score double, label int")
    found = {(r["rep"], r["risk_score"]): (r["pos"], r["neg"]) for r in resample.resampled_cells(df, **own).collect()}
    placed = sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
    drawn = Counter((rep, *placed[number(f"{rep}:{j}:42") % len(rows)][1:]) for rep in range(5) for j in range(len(rows)))
    assert found == {(rep, s): (drawn[rep, s, 1], drawn[rep, s, 0]) for rep, s, y in drawn if y is not None}
    assert resample.resampled_cells(df.limit(0), **own).collect() == []


def test_hashes_are_those_of_md5():
    from riskframe.operators.resample import hashes

    for first, last in ((0, 10_050), (99_995, 100_005), (10**12 - 5, 10**12 + 5)):
        for head, tail in (("0:", ":42"), ("199:", ":-7"), ("", "")):
            assert hashes(head, tail, first, last).tolist() == [number(f"{head}{j}{tail}") for j in range(first, last)]
    with pytest.raises(ValueError):
        hashes("x" * 60, "", 0, 1)
