"""Metrics against definitions, by brute force on small tables."""

from __future__ import annotations

import itertools
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import dataset, metrics
from riskframe.operators.positions import percentiles, with_position
from riskframe.operators.threshold import Threshold


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(300):
        y = rng.random() < 0.4
        out.append((i, int(y), round(min(1, max(0, 0.3 * y + rng.random() * 0.7)), 2), i % 3))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "row_id long, label int, risk_score double, g int").cache()


def test_auc_counts_pairs(df, rows):
    pos, neg = [r[2] for r in rows if r[1]], [r[2] for r in rows if not r[1]]
    brute = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first()[0] == pytest.approx(brute)


def test_auc_without_a_class_is_null(spark):
    one = spark.createDataFrame([(1, 0.2), (1, 0.4)], "label int, risk_score double")
    assert metrics.roc_auc(one).first()[0] is None


def test_best_threshold_tries_all(df, rows):
    p, n = sum(r[1] for r in rows), sum(1 - r[1] for r in rows)
    best = min((2 * sum(1 - y for _, y, s, _ in rows if s >= t) * p + 3 * sum(y for _, y, s, _ in rows if s < t) * n, -t) for t in {r[2] for r in rows} | {2.0})
    found = metrics.best_threshold(df, fp_cost=2, fn_cost=3).first()
    assert (found["cost"], found["threshold"]) == (best[0], min(1.0, -best[1]))


def test_best_threshold_may_predict_none(spark):
    bad = spark.createDataFrame([(0, 0.9), (0, 0.8), (1, 0.1)], "label int, risk_score double")
    assert metrics.best_threshold(bad).first()["threshold"] == 1.0


def test_rates_of_nothing_have_worst_values(spark):
    r = metrics.confusion(spark.createDataFrame([(0, 0.1)], "label int, risk_score double")).first()
    assert (r["tpr"], r["fnr"], r["fpr"], r["tnr"], r["precision"], r["accuracy"]) == (0, 1, 0, 1, 0, 1)


def test_rates_add_up(df):
    r = metrics.confusion(df).first()
    assert r["tpr"] + r["fnr"] == pytest.approx(1) and r["tnr"] + r["fpr"] == pytest.approx(1)
    assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == 300


def test_percentiles_interpolate(df, rows):
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    found = {r["share"]: r["value"] for r in percentiles(df, "risk_score", shares).collect()}
    for q in shares:
        assert found[q] == pytest.approx(np.percentile([r[2] for r in rows], 100 * q))


def test_calibration_bins_hold_all(df):
    assert sum(r["n"] for r in metrics.calibration_curve(df, 5).collect()) == 300
    assert sum(r["n"] for r in metrics.histogram(df, 10).collect()) == 300
    assert sum(r["percent"] for r in metrics.histogram(df, 10).collect()) == pytest.approx(100)


def test_log_loss_of_sure_scores_is_finite(spark):
    r = metrics.losses(spark.createDataFrame([(1, 1.0), (0, 1.0)], "label int, risk_score double")).first()
    assert math.isfinite(r["log_loss"]) and r["brier_score"] == 0.5


def test_fairness_without_large_groups_is_null(spark):
    small = spark.createDataFrame([(i % 2, 0.5, i) for i in range(100)], "label int, risk_score double, g int")
    assert metrics.fairness(small, "g").first()["tpr_ratio"] is None


def test_bootstrap_centres_on_the_estimate(df):
    base = metrics.confusion(df).first()["accuracy"]
    for f in (metrics.bootstrap, metrics.poisson_bootstrap):
        r = {x["metric"]: x for x in f(df, k=40).collect()}["accuracy"]
        assert r["low"] <= base <= r["high"] and abs(r["mean"] - base) < 0.03


def test_importance_finds_the_feature_that_matters(spark, rows):
    t = spark.createDataFrame([(i, y, s, (i * 37 % 100) / 100) for i, y, s, _ in rows], "row_id long, label int, a double, b double")
    r = {x["feature"]: x["imp_mean"] for x in metrics.importance(t, ["a", "b"], lambda d: F.col("a") + 0 * F.col("b"), repeats=2).collect()}
    assert r["a"] > 0.1 and r["b"] == pytest.approx(0)


def test_signed_bias_is_the_gap_of_means(df, rows):
    gap = sum(r[2] for r in rows) / 300 - sum(r[1] for r in rows) / 300
    assert metrics.bias(df, signed=True).first()[0] == pytest.approx(gap)


def test_evaluate_with_best_threshold(df):
    r = metrics.evaluate(df, threshold="best", group="g").first()
    assert r["n_samples"] == 300 and 0 <= r["threshold"] <= 1 and 0 <= r["ece"] <= 1 and r["tpr_ratio"] is not None


def test_split_is_exact_and_disjoint(spark):
    ids = spark.range(101).withColumnRenamed("id", "row_id")
    out = dataset.split(ids, test=0.2, val=0.1)
    assert {r[0]: r[1] for r in out.groupBy("split").count().collect()} == {"train": 70, "test": 20, "val": 11}
    assert out.select("row_id").distinct().count() == 101
    assert [r[0] for r in out.where("split='test'").select("split_rank").orderBy("split_rank").collect()] == list(range(1, 21))
    assert dataset.split(ids, test=0.2).count() == 101
    a, b = (dataset.split(ids, test=0.5, seed=s).where("split='test'").select("row_id") for s in (1, 2))
    assert a.exceptAll(b).count() > 0
    with pytest.raises(ValueError):
        dataset.split(ids, test=1.2)


def test_positions_are_gapless(spark):
    out = with_position(spark.range(50).withColumnRenamed("id", "i"), "p", F.md5(F.col("i").cast("string")), "i")
    assert sorted(r["p"] for r in out.collect()) == list(range(1, 51))


def test_stratified(spark):
    t = spark.range(20).select(F.col("id").alias("row_id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    assert dataset.balanced_counts([1, 0], 5) == {0: 3, 1: 2}
    assert {r[0]: r[1] for r in dataset.stratified(t, {0: 3, 1: 2}, "y").groupBy("y").count().collect()} == {0: 3, 1: 2}
    with pytest.raises(ValueError):
        dataset.stratified(t, {1: 6}, "y")


def test_filters_and_checks(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert dataset.filtered(t, {"v": "a"}).count() == 1 and dataset.filtered(t, {}).count() == 2
    with pytest.raises(ValueError):
        dataset.filtered(t, {"w": 1})


def test_threshold_of_missing_values(spark):
    t = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (7.0,)], "x double")
    for op, want in {">": [0, 0, 0, 1], "!=": [1, 1, 1, 1], "==": [0, 0, 0, 0], "<=": [1, 0, 0, 0]}.items():
        assert [r[0] for r in t.select(Threshold(5, op).of(F.col("x"))).collect()] == want
    with pytest.raises(ValueError):
        Threshold(1, "~").of(F.col("x"))


def test_ranges_never_fall_as_scores_rise(spark):
    from riskframe.operators.positions import range_of, running

    xs = sorted({0.0, 1.0, 0.5, 1e-300, 1e-12, 1 - 1e-12, 1 - 1e-16, *(random.Random(2).random() for _ in range(3000)), *(random.Random(3).random() * 1e-6 for _ in range(3000)), *(1 - random.Random(5).random() * 1e-6 for _ in range(3000))})
    df = spark.createDataFrame([(x, 1) for x in xs], "s double, w int")
    got = [r[0] for r in df.orderBy("s").select(range_of(F.col("s"))).collect()]
    assert got == sorted(got) and max(np.unique(got, return_counts=True)[1]) < 40
    assert [r["c"] for r in running(df, "s", {"c": "w"}, ascending=True).orderBy("s").collect()] == list(range(1, len(xs) + 1))


def test_evaluate_agrees_with_each_metric(df):
    whole = metrics.evaluate(df, group="g").first().asDict()
    for part in (metrics.losses(df), metrics.confusion(df), metrics.roc_auc(df), metrics.ece(df), metrics.ece_quantile(df), metrics.fairness(df, "g")):
        for k, v in part.first().asDict().items():
            assert whole[k] == pytest.approx(v), k


def test_resamples_vary_as_they_should(spark):
    """Poisson weights have mean and variance one, independent between rows and between resamples."""
    rows = spark.range(4000).select(F.col("id").alias("row_id"), (F.col("id") / 4000).alias("risk_score"), (F.col("id") % 2).cast("int").alias("label"))
    w = metrics.poisson_cells(rows, k=30, seed=1, row_id="row_id", score="risk_score", label="label").withColumn("w", F.col("pos") + F.col("neg")).toPandas().pivot(index="risk_score", columns="rep", values="w").reindex([i / 4000 for i in range(4000)]).fillna(0).to_numpy()
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03 and w.max() >= 6
    c = np.corrcoef(w.T) - np.eye(30)
    assert np.abs(c).max() < 0.08
    found = {r["metric"]: r for r in metrics.poisson_bootstrap(rows, k=200).collect()}
    assert found["prevalence"]["std"] == pytest.approx(math.sqrt(0.25 / 4000), rel=0.25) and found["prevalence"]["low"] < 0.5 < found["prevalence"]["high"]


def test_resamples_of_hot_scores_and_null_groups(spark):
    """Rows of a score that half of all rows share are dealt over many tasks; sums by resample are those of the rows one by one."""
    rows = [(i, 0.5 if i % 2 else (i % 40) / 40, i % 3 == 0, None if i % 5 == 0 else f"g{i % 2}") for i in range(600)]
    df = spark.createDataFrame([(i, s, int(y), g) for i, s, y, g in rows], "row_id long, risk_score double, label int, g string")
    found = {(r["rep"], r["risk_score"], r["g"]): (r["pos"], r["neg"]) for r in metrics.poisson_cells(df, k=7, seed=3, row_id="row_id", score="risk_score", label="label", by=("g",)).collect()}
    expected: dict = {}
    ends = metrics.poisson_ends()
    for i, s, y, g in rows:
        h = hashlib.md5(f"{i}:3".encode()).hexdigest()
        x, z = int(h[:15], 16) % metrics.PRIME, int(h[15:30], 16) % metrics.PRIME
        for rep, (a, b, c) in enumerate(metrics.replicate_factors(7, 3)):
            n = sum((a * x % metrics.PRIME + b * z % metrics.PRIME + c) % metrics.PRIME >= e for e in ends)
            if n:
                pos, neg = expected.get((rep, s, g), (0, 0))
                expected[rep, s, g] = (pos + n * y, neg + n * (not y))
    assert found == expected


def test_all_metrics_of_an_evaluation_have_intervals(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), ((F.col("id") * 37 % 101) / 101).alias("risk_score"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 2).alias("g"))
    one = metrics.evaluate(df, group="g").first().asDict()
    found = {r["metric"]: r for r in metrics.poisson_bootstrap(df, k=40, group="g").collect()}
    assert set(one) - set(found) == {"n_unscored", "n_samples", "n_positives", "n_negatives", "tn", "fp", "fn", "tp", "threshold"}
    for m in ("accuracy", "roc_auc", "log_loss", "brier_score", "tpr"):
        assert found[m]["low"] <= one[m] <= found[m]["high"]


def test_logistic_regression_finds_the_optimum(spark, sf):
    """Loss on the test rows as of Newton's method in numpy."""
    from riskframe.plans.baselines import fit_and_score
    from riskframe.plans.catalogue import QUERIES

    rng = np.random.default_rng(3)
    x = rng.random((400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(3 - 5 * x[:, 0]))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c), "train" if i < 300 else "test") for i, ((a, b), c) in enumerate(zip(x, y))], "row_id int, a double, b double, label int, split string")
    design, w = np.c_[np.ones(300), x[:300]], np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ w))
        w += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]), design.T @ (y[:300] - p))
    want = 1 / (1 + np.exp(-np.c_[np.ones(100), x[300:]] @ w))
    got = [r["risk_score"] for r in fit_and_score(df, ["a", "b"]).orderBy("row_id").collect()]
    assert np.abs(np.array(got) - want).max() < 1e-3
    assert QUERIES["ml_baseline_lr"](spark, sf).first()["roc_auc"] > 0.5


class Recorder:
    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        return lambda *a, **k: self.calls.append((name, a, k))


def test_figures_draw_what_the_tables_say(df, tmp_path):
    from riskframe.sources import figures

    figure, ax = Recorder(), Recorder()
    figures.roc_figure(metrics.roc(df), (figure, ax))
    name, (x, y), _ = ax.calls[0]
    assert name == "plot" and x[0] == y[0] == 0 and x[-1] == y[-1] == 1 and x == sorted(x)
    figures.calibration_figure(metrics.calibration_curve(df, by=("g",)), "g", (figure, Recorder()))
    figures.histogram_figure(metrics.histogram(df), axes=(figure, bars := Recorder()))
    assert sum(bars.calls[0][1][1]) == pytest.approx(100)
    assert figures.save(figure, "roc", str(tmp_path / "f")).endswith("f/roc.pdf") and figure.calls[-1][2]["dpi"] == 300
