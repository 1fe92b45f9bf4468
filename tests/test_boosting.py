"""Boosted trees against the same search in numpy, and odd tables."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import boosting
from riskframe.plans.catalogue import QUERIES


def brute(bins, y, trees, depth, rate, penalty, least):
    """Margins after each tree, by trying every split of every node; bins: rows x features, -1 for missing."""
    share = y.mean()
    margin = np.full(len(y), math.log(share / (1 - share)))
    u = boosting.UNIT

    def split(rows, g, h, left):
        if left == 0:
            return None
        found = None
        for f in range(bins.shape[1]):
            b = bins[rows, f]
            for cut in sorted(set(b[b >= 0])):
                for missing_left in (False, True):
                    side = np.where(b < 0, missing_left, b <= cut)
                    gl, hl, ga, ha = g[rows][side].sum(), h[rows][side].sum(), g[rows].sum(), h[rows].sum()
                    if hl < least * u or ha - hl < least * u:
                        continue
                    worth = lambda a, b: (a / u) * (a / u) / (b / u + penalty)
                    gain = (worth(gl, hl) + worth(ga - gl, ha - hl) - worth(ga, ha)) / 2
                    if gain > 0 and (found is None or gain > found[0]):
                        found = (gain, rows[side], rows[~side])
        return found

    def grow(rows, g, h, left, out):
        s = split(rows, g, h, left)
        if s is None:
            out[rows] = -rate * (g[rows].sum() / u) / (h[rows].sum() / u + penalty) if left < depth else 0.0
            return
        for part in s[1:]:
            grow(part, g, h, left - 1, out)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        # As Spark rounds: halves away from 0.
        whole = lambda x: (np.sign(x) * np.floor(np.abs(x) * u + 0.5)).astype(np.int64)
        out = np.zeros(len(y))
        grow(np.arange(len(y)), whole(p - y), whole(p * (1 - p)), depth, out)
        margin = margin + out
    return 1 / (1 + np.exp(-margin))


def data(n=400, seed=5):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 12, n).astype(float), rng.random(n).round(2), rng.integers(0, 3, n).astype(float)
    logit = 0.4 * (a - 6) + 2 * (b > 0.5) - (c == 1)
    gone = rng.random(n) < 0.25
    y = (rng.random(n) < 1 / (1 + np.exp(-logit - 2 * gone))).astype(int)
    return [(i, None if gone[i] else float(a[i]), float("nan") if i % 17 == 0 else float(b[i]), float(c[i]), int(y[i])) for i in range(n)]


SCHEMA = "row_id int, a double, b double, c double, label int"


@pytest.mark.parametrize("parts", [1, 7])
def test_same_trees_as_in_numpy(spark, parts):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    features = ["a", "b", "c"]
    ends = boosting.edges(df, features, 16)
    bins = np.array([[-1 if v is None or v != v else sum(e < v for e in ends[f]) for f, v in zip(features, r[1:4])] for r in rows])
    want = brute(bins, np.array([r[4] for r in rows]), 7, 3, 0.3, 1.0, 1.0)
    model = boosting.fit(df, features, trees=7, depth=3, bins=16)
    assert len(model.trees) == 7  # more than PENDING, so margins were written once
    got = [r["p"] for r in df.select("row_id", model.probability().alias("p")).orderBy("row_id").collect()]
    assert np.abs(np.array(got) - want).max() < 1e-9
    again = boosting.Boosted.of(json.loads(json.dumps(model.record())))
    assert again == model


def test_missing_values_have_a_learned_side(spark):
    """Only whether a value is missing tells the label; no filled value could stand for both ends."""
    rows = [(i, None if i % 3 == 0 else float(i % 10), 0.0, 0.0, int(i % 3 == 0 or i % 10 == 9)) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = boosting.fit(df, ["a"], trees=10, depth=2)
    worst = df.select(F.max(F.abs(F.col("label") - model.probability())).alias("d")).first()["d"]
    assert worst < 0.2
    first = model.trees[0]
    assert first.feature == "a" and not first.missing_left  # with the high values, whose label they share
    assert "Exchange" not in df.select(model.probability())._jdf.queryExecution().executedPlan().toString()


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        boosting.fit(empty, ["a"])
    with pytest.raises(ValueError):
        boosting.fit(empty, ["a", "a"])
    one = spark.createDataFrame([(i, float(i), None, 1.0, 1) for i in range(50)] + [(99, 1.0, 1.0, 1.0, None)], SCHEMA)
    model = boosting.fit(one, ["a", "b", "c"])  # one label; a feature that is always missing; a constant one
    assert model.trees == () and one.select(F.min(model.probability()).alias("p")).first()["p"] > 0.999
    clash = one.withColumnsRenamed({"b": "y", "c": "margin", "a": "b0"}).withColumn("node", F.lit(3)).withColumn("label", (F.col("b0") > 20).cast("int"))
    found = boosting.fit(clash, ["b0", "y", "margin", "node"], trees=3)
    assert found.trees and all(t.feature == "b0" for t in found.trees)


def test_baseline(spark, sf):
    assert QUERIES["ml_baseline_boosted"](spark, sf).first()["roc_auc"] > 0.65
