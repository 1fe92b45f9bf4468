"""Metrics of scores: counts in one pass, curves from one row a distinct score. Scores lie between 0 and 1, labels are 0 or 1.

A row without a score (null or NaN) counts in no metric; evaluate() says how many there are.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import hash_key, hash_long, safe_division, valid
from .positions import GROUP_STEPS, STEPS, percentiles, range_of, running

EPSILON = 2.220446049250313e-16
#: Rates by group that fairness compares.
RATES = ("accuracy", "tpr", "fnr", "fpr", "tnr", "balanced_accuracy", "precision", "ppr")


def with_scores(df: DataFrame, score: str) -> DataFrame:
    return df.where(valid(F.col(score)))


def binarised(score: Column, threshold: Column | float) -> Column:
    return (score >= threshold).cast("int")


def counts(label: Column, predicted: Column) -> list[Column]:
    return [F.count_if((label == y) & (predicted == p)).alias(n) for n, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]


def rates() -> dict[str, Column]:
    """From tn, fp, fn, tp; a rate of nothing has its worst value."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    out = {
        "accuracy": (tp + tn) / (tn + fp + fn + tp),
        "tpr": safe_division(tp, tp + fn, 0),
        "fnr": safe_division(fn, tp + fn, 1),
        "fpr": safe_division(fp, fp + tn, 1),
        "tnr": safe_division(tn, fp + tn, 0),
        "precision": safe_division(tp, tp + fp, 0),
        "ppr": safe_division(tp + fp, tn + fp + fn + tp, 0),
    }
    out["balanced_accuracy"] = 0.5 * (out["tpr"] + out["tnr"])
    return {k: out[k] for k in RATES}


def confusion(df: DataFrame, threshold: float | Column = 0.5, *, score: str = "risk_score", label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    predicted = binarised(F.col(score), F.lit(threshold) if isinstance(threshold, (int, float)) else threshold)
    grouped = with_scores(df, score).groupBy(*by).agg(*counts(F.col(label), predicted))
    return grouped.select("*", *[c.alias(n) for n, c in rates().items()])


def log_loss(score: Column, label: Column) -> Column:
    p = F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), score))
    return F.avg(-(label * F.log(p) + (1 - label) * F.log(1 - p)))


def brier(score: Column, label: Column) -> Column:
    return F.avg((score - label) * (score - label))


def losses(df: DataFrame, *, score: str = "risk_score", label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    s, y = F.col(score), F.col(label)
    return with_scores(df, score).groupBy(*by).agg(F.count(F.lit(1)).alias("n_samples"), F.sum(y).alias("n_positives"), F.sum(1 - y).alias("n_negatives"), log_loss(s, y).alias("log_loss"), brier(s, y).alias("brier_score"))


def distinct_scores(df: DataFrame, *, score: str = "risk_score", label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    return with_scores(df, score).groupBy(*by, score).agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))


def roc(df: DataFrame, *, score: str = "risk_score", label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """threshold, tp, fp, p, n, tpr, fpr for each distinct score, from the highest; without the point that predicts none. Rows are read and exchanged once."""
    points = _points(distinct_scores(df, score=score, label=label, by=by), score, by)
    return points.select(*by, F.col(score).alias("threshold"), "pos", "neg", "tp", "fp", "p", "n", safe_division(F.col("tp"), F.col("p"), 0).alias("tpr"), safe_division(F.col("fp"), F.col("n"), 1).alias("fpr"))


def _points(cells: DataFrame, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp and the totals p, n, from one row a score with pos and neg."""
    return running(cells, score, {"tp": "pos", "fp": "neg"}, by, totals={"p": "pos", "n": "neg"})


def _auc() -> Column:
    """Of points: pairs in the right order, ties as halves, by all. Counted from both classes, so that all columns of the points' aggregate are used, in all its branches."""
    pairs = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0) + F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / 2.0)) / 2
    return F.try_divide(pairs, (F.max("p") * F.max("n")).cast("double"))


def roc_auc(df: DataFrame, *, score: str = "risk_score", label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """Ties count half; null where a class is missing. Rows are read and exchanged once."""
    return _points(distinct_scores(df, score=score, label=label, by=by), score, by).groupBy(*by).agg(_auc().alias("roc_auc"))


def _best(fp_cost: float, fn_cost: float, threshold: Column) -> tuple[Column, Column]:
    """Of points: the best threshold, and its cost."""
    # A common denominator: costs of whole weights are whole, and ties exact.
    cost = F.lit(fp_cost) * F.col("fp") * F.col("p") + F.lit(fn_cost) * (F.col("p") - F.col("tp")) * F.col("n")
    least, none = F.min(F.struct(cost.alias("cost"), (-threshold).alias("less"))), F.lit(fn_cost) * F.max("p") * F.max("n")
    return F.when(none <= least["cost"], F.lit(1.0)).otherwise(F.least(-least["less"], F.lit(1.0))), F.least(none, least["cost"])


def best_threshold(df: DataFrame, *, fp_cost: float = 1, fn_cost: float = 1, score: str = "risk_score", label: str = "label") -> DataFrame:
    """The threshold of least fp_cost * fpr + fn_cost * (1 - tpr); of equals the highest. Predicting none is one of them, as threshold 1. Rows are read and exchanged once."""
    threshold, cost = _best(fp_cost, fn_cost, F.col(score))
    points = _points(distinct_scores(df, score=score, label=label), score)
    return points.agg(threshold.alias("threshold"), cost.alias("cost")).where("cost IS NOT NULL")


def accuracy_at(df: DataFrame, thresholds: DataFrame, *, score: str = "risk_score", label: str = "label") -> DataFrame:
    """The one row of thresholds, and for each of its columns accuracy_<column>; from one row a distinct score."""
    names = thresholds.columns
    right = lambda t: F.sum(F.when(F.col(score) >= F.col(t), F.col("pos")).otherwise(F.col("neg"))) / F.sum(F.col("pos") + F.col("neg"))
    return distinct_scores(df, score=score, label=label).crossJoin(F.broadcast(thresholds)).groupBy(*names).agg(*[right(t).alias(f"accuracy_{t}") for t in names])


def _confidence(score: Column, label: Column) -> tuple[Column, Column]:
    """Of the likelier label: its probability, and whether it is right."""
    return F.greatest(score, 1 - score), ((score >= 0.5).cast("int") == label).cast("int")


def calibration_error(binned: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """From x, y and bin: the mean gap of the bins' averages, weighted by their rows."""
    bins = binned.groupBy(*by, "bin").agg(F.avg("x").alias("ax"), F.avg("y").alias("ay"), F.count(F.lit(1)).alias("n"))
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("ax") - F.col("ay"))) / F.sum("n")).alias("ece"))


def equal_width(x: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.floor(x * bins)).cast("int")


def _xy(df: DataFrame, score: str, label: str, positive: bool) -> DataFrame:
    x, y = (F.col(score), F.col(label)) if positive else _confidence(F.col(score), F.col(label))
    return with_scores(df, score).select("*", x.alias("x"), y.alias("y"))


def ece(df: DataFrame, bins: int = 10, *, positive: bool = False, score: str = "risk_score", label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """Bins of equal width of the likelier label's probability, or of the score itself."""
    return calibration_error(_xy(df, score, label, positive).withColumn("bin", equal_width(F.col("x"), bins)), by)


def quantile_bins(df: DataFrame, x: str, bins: int, into: str = "bin", weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the bin, (lower, upper], between interpolated quantiles; the lowest includes its lower edge. weight: how many rows each stands for. by: each group between its own
    quantiles; the edges, one row a group, are small where groups are few, as resamples are."""
    edges = percentiles(df, x, [i / bins for i in range(1, bins)], weight, by, GROUP_STEPS if by else STEPS)
    listed = edges.groupBy(*by).agg(F.array_sort(F.collect_list("value")).alias("_edges"))
    met = df.join(listed, list(by)) if by else df.crossJoin(F.broadcast(listed))
    return met.withColumn(into, F.size(F.filter("_edges", lambda e: e < F.col(x)))).drop("_edges")


def ece_quantile(df: DataFrame, bins: int = 10, *, positive: bool = False, score: str = "risk_score", label: str = "label") -> DataFrame:
    return calibration_error(quantile_bins(_xy(df, score, label, positive), "x", bins)).withColumnRenamed("ece", "ece_quantile")


def calibration_curve(df: DataFrame, bins: int = 5, *, score: str = "risk_score", label: str = "label", by: tuple[str, ...] = (), min_share: float = 0.0) -> DataFrame:
    """bin, mean_score, share_positive, n; bins by quantiles of all rows. Groups below the share of rows go."""
    binned = quantile_bins(with_scores(df, score), score, bins)
    out = binned.groupBy(*by, "bin").agg(F.avg(score).alias("mean_score"), F.avg(label).alias("share_positive"), F.count(F.lit(1)).alias("n"))
    if by and min_share:
        w = Window.partitionBy(*by)
        out = out.withColumn("_g", F.sum("n").over(w)).withColumn("_all", F.sum("n").over(Window.partitionBy())).where(F.col("_g") >= min_share * F.col("_all")).drop("_g", "_all")
    return out


def histogram(df: DataFrame, bins: int = 20, *, score: str = "risk_score", by: tuple[str, ...] = ()) -> DataFrame:
    """bin, n and percent (of the group); empty bins don't show."""
    out = with_scores(df, score).groupBy(*by, equal_width(F.col(score), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def density(df: DataFrame, *, points: int = 21, bandwidth: float = 0.05, score: str = "risk_score", label: str = "label") -> DataFrame:
    """x, label, share: Gaussian kernel densities at points from 0 to 1, each label's as a share of all at that point; from one row a distinct score."""
    n = distinct_scores(df, score=score, label=label)
    grid = F.array(*[F.lit(i / (points - 1)) for i in range(points)])
    near = n.select(score, "pos", "neg", F.explode(grid).alias("x"))
    kernel = F.exp(-((F.col("x") - F.col(score)) / bandwidth) * ((F.col("x") - F.col(score)) / bandwidth) / 2)
    sums = near.groupBy("x").agg(F.sum(kernel * F.col("pos")).alias("a"), F.sum(kernel * F.col("neg")).alias("b"))
    return sums.select("x", F.explode(F.create_map(F.lit(1), F.try_divide("a", F.col("a") + F.col("b")), F.lit(0), F.try_divide("b", F.col("a") + F.col("b"))))).toDF("x", label, "share")


def group_rates(df: DataFrame, group: str, threshold: float = 0.5, *, min_share: float = 0.04, score: str = "risk_score", label: str = "label") -> DataFrame:
    """Counts and rates of each group that has the share of rows or more."""
    return _large_groups(confusion(df, threshold, score=score, label=label, by=(group,)), min_share)


def _large_groups(out: DataFrame, min_share: float, by: tuple[str, ...] = ()) -> DataFrame:
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return out.withColumn("n", n).withColumn("_all", F.sum("n").over(Window.partitionBy(*by))).where(F.col("n") >= min_share * F.col("_all")).drop("_all")


def fairness(df: DataFrame, group: str, threshold: float = 0.5, *, min_share: float = 0.04, score: str = "risk_score", label: str = "label") -> DataFrame:
    """One row: ratio (least by greatest; 0 if that is 0) and difference of each rate over groups, and equalized odds; null without groups."""
    return _fairness_of(group_rates(df, group, threshold, min_share=min_share, score=score, label=label))


def _fairness_of(g: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    ends = g.groupBy(*by).agg(*[f(m).alias(f"{n}_{m}") for m in RATES for n, f in (("lo", F.min), ("hi", F.max))])
    out = {}
    for m in RATES:
        lo, hi = F.col(f"lo_{m}"), F.col(f"hi_{m}")
        out[f"{m}_ratio"] = F.when(hi == 0, F.lit(0.0)).otherwise(F.try_divide(lo, hi))
        out[f"{m}_diff"] = hi - lo
    one = ends.select(*by, *[c.alias(n) for n, c in out.items()])
    return one.withColumn("equalized_odds_ratio", F.least("fnr_ratio", "fpr_ratio")).withColumn("equalized_odds_diff", F.greatest("tpr_diff", "fpr_diff"))


def evaluate(df: DataFrame, *, threshold: float | str = 0.5, group: str | None = None, score: str = "risk_score", label: str = "label", bins: int = 10) -> DataFrame:
    """One row with all metrics. threshold: a number, or 'best' for that of least cost.

    Rows are read and exchanged once, as one row for each group and score; all metrics come from sums over these. Rows without a score are counted, and weigh nothing in the rest.
    """
    if threshold == "best":
        threshold = best_threshold(df, score=score, label=label).first()["threshold"]
    by = (group,) if group else ()
    y = F.col(label)
    cells = df.groupBy(*by, F.when(valid(F.col(score)), F.col(score)).alias(score)).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    s, p, n, has = F.col(score), F.col("pos"), F.col("neg"), F.col(score).isNotNull()
    hit, clipped = s >= threshold, F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), s))
    of = lambda when, x: F.coalesce(F.sum(F.when(when, x)), F.lit(0))
    tallies = [of(has & ~hit, n).alias("tn"), of(has & hit, n).alias("fp"), of(has & ~hit, p).alias("fn"), of(has & hit, p).alias("tp")]
    sums = cells.agg(of(~has, p + n).alias("n_unscored"), of(has, p + n).alias("n_samples"), of(has, p).alias("n_positives"), of(has, n).alias("n_negatives"), F.sum(F.when(has, -(p * F.log(clipped) + n * F.log(1 - clipped)))).alias("_log"), F.sum(F.when(has, p * (1 - s) * (1 - s) + n * s * s)).alias("_brier"), *tallies)
    mean = lambda c: F.try_divide(F.col(c), F.col("n_samples").cast("double"))
    one = sums.select("n_unscored", "n_samples", "n_positives", "n_negatives", mean("_log").alias("log_loss"), mean("_brier").alias("brier_score"), "tn", "fp", "fn", "tp", *[c.alias(x) for x, c in rates().items()])
    # A filter would be pushed below the aggregate, and make another of it; so rows without a score stay, with nothing to count.
    scores = cells.groupBy(score).agg(of(has, p).alias("pos"), of(has, n).alias("neg"))
    sure, right = F.greatest(s, 1 - s), F.when(s >= 0.5, p).otherwise(n)
    sure_cells = scores.select(sure.alias("x"), right.alias("y"), (p + n).alias("w"))
    parts = [one, _points(scores, score).agg(_auc().alias("roc_auc")), _gap_of(sure_cells.withColumn("bin", equal_width(F.col("x"), bins)), "ece"), _gap_of(quantile_bins(sure_cells, "x", bins, weight="w"), "ece_quantile")]
    if group:
        parts.append(_fairness_of(_large_groups(cells.groupBy(group).agg(*tallies).select("*", *[c.alias(x) for x, c in rates().items()]), 0.04)))
    return reduce(lambda a, b: a.crossJoin(b), parts).withColumn("threshold", F.lit(float(threshold)))


def _gap_of(binned: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """From x, y (a sum), w and bin: the mean gap of the bins' averages, weighted by their rows."""
    gaps = binned.groupBy(*by, "bin").agg(F.abs(F.sum(F.col("x") * F.col("w")) - F.sum("y")).alias("gap"), F.sum("w").alias("w"))
    return gaps.groupBy(*by).agg(F.try_divide(F.sum("gap"), F.sum("w").cast("double")).alias(name))


def bootstrap(df: DataFrame, *, k: int = 200, confidence: float = 0.95, seed: int = 42, threshold: float = 0.5, row_id: str = "row_id", score: str = "risk_score", label: str = "label") -> DataFrame:
    """metric, mean, std (of the sample), low and high (percentiles): over k resamples of n rows, drawn with replacement by hashes. Exact: each of the n * k draws is hashed,
    which poisson_bootstrap() does once a row; they are exchanged as gaps between sorted places, a byte or two each."""
    from .resample import resampled_cells

    cells = resampled_cells(with_scores(df, score), k=k, seed=seed, row_id=row_id, score=score, label=label)
    return _summary(replicate_metrics(cells, threshold, score), confidence)


#: A prime, below which weights of resamples are hashed: products of two numbers below it fit into 64 bits.
PRIME = (1 << 31) - 1


def poisson_ends() -> list[int]:
    """The numbers below PRIME from which on a row is drawn once, twice, and so on; what is rarer than one of them doesn't come up."""
    out, p, total = [], math.exp(-1), math.exp(-1)
    while math.ceil(total * PRIME) < PRIME:
        out.append(math.ceil(total * PRIME))
        p /= len(out)
        total += p
    return out


def replicate_factors(k: int, seed: int) -> list[tuple[int, int, int]]:
    """For each resample three numbers below PRIME, from the MD5 of its number and the seed."""
    number = lambda r, i: int(hashlib.md5(f"{r}:{seed}:{i}".encode()).hexdigest()[:15], 16) % PRIME
    return [(1 + number(r, 0) % (PRIME - 1), 1 + number(r, 1) % (PRIME - 1), number(r, 2)) for r in range(k)]


#: A score (of one group) with more than a row in so many has its rows dealt over as many tasks.
HOT_SHARE = 64


def poisson_cells(df: DataFrame, *, k: int, seed: int, row_id: str, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rep, score, pos, neg: how often rows of that score, of either label, are in each resample, each row a Poisson(1) number of times.

    A row has one MD5; its weights in the resamples are linear functions of that modulo a prime, which are independent for any two rows. Rows are dealt by score before
    they are multiplied, so that k rows a distinct score are exchanged, not k rows a row; scores that many rows share are dealt over many tasks.
    """
    key = hash_key(row_id, seed)
    own = [*by, score]
    rows = with_scores(df, score).select(*own, F.col(label).cast("long").alias("_label"), (hash_long(key) % PRIME).alias("_x"), (F.conv(F.substring(key, 16, 15), 16, 10).cast("long") % PRIME).alias("_y"))
    counts = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.withColumn("_hot", F.lit(True)).join(F.broadcast(counts.agg((F.sum("_n") / HOT_SHARE).alias("_most"))), F.col("_n") > F.col("_most"))
    hot = F.broadcast(hot.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(own)], "_hot"))  # HOT_SHARE rows at most
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(own)])
    dealt = rows.join(hot, same, "left").withColumn("_salt", F.when(F.col("_hot"), F.col("_x") % HOT_SHARE).otherwise(0)).repartition(*own, "_salt")
    factors = F.array(*[F.struct(F.lit(r).alias("rep"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(c).cast("long").alias("c")) for r, (a, b, c) in enumerate(replicate_factors(k, seed))])
    u = (F.col("_f.a") * F.col("_x") % PRIME + F.col("_f.b") * F.col("_y") % PRIME + F.col("_f.c")) % PRIME
    weight = reduce(lambda a, b: a + b, [(F.col("_u") >= e).cast("long") for e in poisson_ends()])
    drawn = dealt.select(*own, "_label", "_x", "_y", F.explode(factors).alias("_f")).select(*own, "_label", "_f.rep", u.alias("_u")).where(F.col("_u") >= poisson_ends()[0])
    return drawn.select(*own, "rep", "_label", weight.alias("_w")).groupBy("rep", *own).agg(F.sum(F.col("_w") * F.col("_label")).alias("pos"), F.sum(F.col("_w") * (1 - F.col("_label"))).alias("neg"))


def poisson_bootstrap(df: DataFrame, *, k: int = 200, confidence: float = 0.95, seed: int = 42, threshold: float = 0.5, group: str | None = None, full: bool = False, row_id: str = "row_id", score: str = "risk_score", label: str = "label") -> DataFrame:
    """As bootstrap(), but each row joins each resample a Poisson(1) number of times: no join, and k rows a distinct score are exchanged. full: also of the error over
    quantile bins, which each resample has its own of; group: of fairness over groups, too, so that all metrics of evaluate() have intervals."""
    cells = poisson_cells(df, k=k, seed=seed, row_id=row_id, score=score, label=label, by=(group,) if group else ())
    return _summary(replicate_metrics(cells, threshold, score, group=group, full=full or bool(group)), confidence)


def replicate_metrics(cells: DataFrame, threshold: float, score: str, *, group: str | None = None, full: bool = False, bins: int = 10, min_share: float = 0.04) -> DataFrame:
    """rep and a column for each metric, from rep, group, score, pos and neg. Running sums are over ranges of scores of each resample, so that no task orders a whole one."""
    s, p, n = F.col(score), F.col("pos"), F.col("neg")
    hit = s >= threshold
    clipped = F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), s))
    one = cells.groupBy("rep", score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")) if group else cells
    sure, right = F.greatest(s, 1 - s), F.when(s >= 0.5, p).otherwise(n)
    # Ordered within ranges; then one row for each range and bin, whose sums over the ranges before are few to add up.
    falling = Window.partitionBy("rep", "_range").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("rep").orderBy(F.desc("_range")).rangeBetween(Window.unboundedPreceding, -1)
    ranged = one.withColumn("_range", range_of(s.cast("double"), GROUP_STEPS)).withColumn("_pairs", n * (F.sum("pos").over(falling) - p / 2.0)).withColumn("_bin", equal_width(sure, bins))
    parts = ranged.groupBy("rep", "_range", "_bin").agg(
        F.sum((p + n) * sure).alias("_sure"), F.sum(right).alias("_right"), F.sum(p + n).alias("_all"), F.sum("_pairs").alias("_pairs"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
        F.sum(F.when(hit, p).otherwise(0)).alias("tp"), F.sum(F.when(hit, n).otherwise(0)).alias("fp"), F.sum(-(p * F.log(clipped) + n * F.log(1 - clipped))).alias("_log"), F.sum(p * (1 - s) * (1 - s) + n * s * s).alias("_brier"),
    )
    parts = parts.withColumn("_pairs", F.col("_pairs") + F.col("_n") * F.coalesce(F.sum("_p").over(above), F.lit(0)))
    totals = [F.sum(c).alias(c) for c in ("_all", "_pairs", "_p", "_n", "tp", "fp", "_log", "_brier")]
    sums = parts.groupBy("rep", "_bin").agg(F.abs(F.sum("_sure") - F.sum("_right")).alias("_gap"), *totals).groupBy("rep").agg(F.sum("_gap").alias("_gap"), *totals)
    sums = sums.withColumn("fn", F.col("_p") - F.col("tp")).withColumn("tn", F.col("_n") - F.col("fp"))
    of_all = lambda c: F.col(c) / F.col("_all")
    out = sums.select(
        "rep", *[c.alias(x) for x, c in rates().items()], of_all("_log").alias("log_loss"), of_all("_brier").alias("brier_score"), of_all("_gap").alias("ece"), of_all("_p").alias("prevalence"),
        F.try_divide("_pairs", (F.col("_p") * F.col("_n")).cast("double")).alias("roc_auc"),
    )
    if full:
        sure_cells = one.select("rep", sure.alias("x"), right.alias("y"), (p + n).alias("w"))
        out = out.join(_gap_of(quantile_bins(sure_cells, "x", bins, weight="w", by=("rep",)), "ece_quantile", ("rep",)), "rep", "left")
    if group:
        tallies = [F.sum(F.when(h, x).otherwise(0)).alias(c) for c, h, x in (("tn", ~hit, n), ("fp", hit, n), ("fn", ~hit, p), ("tp", hit, p))]
        by_group = cells.groupBy("rep", group).agg(*tallies).select("*", *[c.alias(x) for x, c in rates().items()])
        out = out.join(_fairness_of(_large_groups(by_group, min_share, ("rep",)), ("rep",)), "rep", "left")
    return out


def _summary(reps: DataFrame, confidence: float) -> DataFrame:
    long = reps.unpivot("rep", [c for c in reps.columns if c != "rep"], "metric", "value")
    tail = (1 - confidence) / 2
    p = F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail)))
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), p[0].alias("low"), p[1].alias("high"))


def calibration_interval(df: DataFrame, group: str, *, bins: int = 5, k: int = 200, confidence: float = 0.95, seed: int = 42, row_id: str = "row_id", score: str = "risk_score", label: str = "label") -> DataFrame:
    """group, bin, mean_score, share_positive, n, low and high: calibration of each group over bins by quantiles of all rows, with bounds of the share of positives over k resamples."""
    binned = quantile_bins(with_scores(df, score), score, bins)
    curve = binned.groupBy(group, "bin").agg(F.avg(score).alias("mean_score"), F.avg(label).alias("share_positive"), F.count(F.lit(1)).alias("n"))
    cells = poisson_cells(binned.withColumn("_one", F.lit(0.0)), k=k, seed=seed, row_id=row_id, score="_one", label=label, by=(group, "bin"))
    shares = cells.select(group, "bin", "rep", (F.col("pos") / (F.col("pos") + F.col("neg"))).alias("_share"))
    tail = (1 - confidence) / 2
    p = F.percentile("_share", F.array(F.lit(tail), F.lit(1 - tail)))
    return curve.join(shares.groupBy(group, "bin").agg(p[0].alias("low"), p[1].alias("high")), [group, "bin"])


def shuffled_features(df: DataFrame, features: list[str], *, repeats: int, seed: int, row_id: str = "row_id") -> dict[tuple[str, int], DataFrame]:
    """For each feature and repeat the rows with that feature's values dealt anew; under ("", 0) the rows as they are."""
    from .dataset import permuted

    out = {("", 0): df}
    for k, f in enumerate(features):
        for r in range(repeats):
            out[f, r] = permuted(df, f, seed=seed + 1000 * k + r, row_id=row_id)
    return out


def tagged(variants: dict[tuple[str, int], DataFrame]) -> DataFrame:
    """All variants' rows, with feature and repeat."""
    return reduce(lambda a, b: a.unionByName(b), [rows.withColumns({"_feature": F.lit(f), "_repeat": F.lit(r)}) for (f, r), rows in variants.items()])


def lost_auc(scored: DataFrame, *, label: str = "label") -> DataFrame:
    """feature, mean and std (of the population) of what the AUC loses, from _feature, _repeat, risk_score and the label: one exchange for all variants."""
    aucs = roc_auc(scored, label=label, by=("_feature", "_repeat"))
    base = aucs.where("_feature = ''").select(F.col("roc_auc").alias("_base"))
    lost = aucs.where("_feature <> ''").crossJoin(F.broadcast(base)).withColumn("_lost", F.col("_base") - F.col("roc_auc"))
    return lost.groupBy(F.col("_feature").alias("feature")).agg(F.avg("_lost").alias("imp_mean"), F.stddev_pop("_lost").alias("imp_std"))


def importance(df: DataFrame, features: list[str], scorer, *, repeats: int = 5, seed: int = 42, row_id: str = "row_id", label: str = "label") -> DataFrame:
    """feature, mean and std (of the population): what the AUC loses when a feature's values are dealt anew over the rows. scorer: from a DataFrame to a Column of it."""
    variants = shuffled_features(df, features, repeats=repeats, seed=seed, row_id=row_id)
    return lost_auc(tagged({k: v.select(F.col(label), scorer(v).alias("risk_score")) for k, v in variants.items()}), label=label)


def bias(df: DataFrame, *, bins: int = 10, signed: bool = False, quantiles: bool = False, score: str = "risk_score", label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """Over- and under-confidence over bins of equal width between the least and the greatest score, or between quantiles of all rows, right-closed; signed: mean score less
    mean label."""
    df = with_scores(df, score)
    if quantiles:
        return _bias_of_bins(quantile_bins(df, score, bins), signed, score, label, by)
    ends = df.groupBy(*by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    rows = df.join(ends, list(by)) if by else df.crossJoin(F.broadcast(ends))
    place = F.when(F.col("_hi") == F.col("_lo"), F.lit(0.0)).otherwise(F.ceil(F.round((F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins, 9)) - 1)
    return _bias_of_bins(rows.withColumn("bin", F.greatest(F.lit(0), place.cast("int"))), signed, score, label, by)


def _bias_of_bins(binned: DataFrame, signed: bool, score: str, label: str, by: tuple[str, ...]) -> DataFrame:
    b = binned.groupBy(*by, "bin").agg(F.avg(score).alias("s"), F.avg(label).alias("y"), F.count(F.lit(1)).alias("n"))
    s, y = F.col("s"), F.col("y")
    term = s - y if signed else F.when(s < 0.5, (1 - s) - (1 - y)).otherwise(s - y)
    return b.groupBy(*by).agg((F.sum(F.col("n") * term) / F.sum("n")).alias("score_bias" if signed else "confidence_bias"))
