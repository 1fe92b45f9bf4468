"""Queries on metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import uniform
from ..operators import boosting, dataset, metrics
from .registry import COUNTS, HASH32, RATES, SCORES, query, rounded, scores, table

_R = list(metrics.RATES)
_ROUND_RATES = ", ".join(f'round("{r}", 6) AS "{r}"' for r in _R)


@query(f"WITH {SCORES}, c AS (SELECT {COUNTS} FROM (SELECT label, CAST(risk_score >= 0.5e0 AS INT) AS p FROM scores)), r AS (SELECT tn, fp, fn, tp, {RATES} FROM c) SELECT tn, fp, fn, tp, {_ROUND_RATES} FROM r")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.confusion(scores(spark, d)), *_R)


@query(f"WITH {SCORES} SELECT count(*) AS n_samples, sum(label)::BIGINT AS n_positives, sum(1-label)::BIGINT AS n_negatives, round(avg(-(label*ln(p)+(1-label)*ln(1-p))),6) AS log_loss, round(avg((risk_score-label)*(risk_score-label)),6) AS brier_score FROM (SELECT *, greatest(2.220446049250313e-16, least(1-2.220446049250313e-16, risk_score)) AS p FROM scores)")
def losses(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.losses(scores(spark, d)), "log_loss", "brier_score")


_ROC = "by_score AS (SELECT risk_score, sum(label) AS pos, sum(1-label) AS neg FROM scores GROUP BY 1), cum AS (SELECT risk_score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM by_score WINDOW w AS (ORDER BY risk_score DESC ROWS UNBOUNDED PRECEDING))"


@query(f"WITH {SCORES}, {_ROC} SELECT round(sum(neg * (tp - pos/2e0)) / (max(p)*max(n)), 6) AS roc_auc FROM cum")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.roc_auc(scores(spark, d)), "roc_auc")


@query(f"WITH {SCORES}, {_ROC} SELECT round(risk_score,6) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp/p,6) AS tpr, round(fp/n,6) AS fpr FROM cum")
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.roc(scores(spark, d)), "threshold", "tpr", "fpr").select("threshold", "tp", "fp", "tpr", "fpr")


@query(f"WITH {SCORES}, by_score AS (SELECT segment, risk_score, sum(label) AS pos, sum(1-label) AS neg FROM scores GROUP BY 1,2), cum AS (SELECT segment, pos, neg, sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY segment) AS p, sum(neg) OVER (PARTITION BY segment) AS n FROM by_score WINDOW w AS (PARTITION BY segment ORDER BY risk_score DESC ROWS UNBOUNDED PRECEDING)) SELECT segment, round(sum(neg * (tp - pos/2e0)) / (max(p)*max(n)), 6) AS roc_auc FROM cum GROUP BY segment")
def roc_auc_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.roc_auc(scores(spark, d), by=("segment",)), "roc_auc")


@query(f"WITH {SCORES}, {_ROC}, costs AS (SELECT risk_score AS threshold, fp*p + (p-tp)*n AS cost FROM cum UNION ALL (SELECT 'infinity'::DOUBLE, p*n FROM cum LIMIT 1)) SELECT round(least(threshold, 1e0),6) AS threshold, cost::BIGINT AS cost FROM costs ORDER BY costs.cost, costs.threshold DESC LIMIT 1")
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.best_threshold(scores(spark, d)), "threshold").withColumn("cost", F.col("cost").cast("long"))


_ECE = "SELECT round(sum(n*abs(ax-ay))/sum(n),6) AS ece FROM (SELECT avg(x) AS ax, avg(y) AS ay, count(*) AS n FROM (SELECT x, y, least(9, floor(x*10)) AS bin FROM xy) GROUP BY bin)"


@query(f"WITH {SCORES}, xy AS (SELECT greatest(risk_score,1-risk_score) AS x, CAST(CAST(risk_score>=0.5e0 AS INT)=label AS INT) AS y FROM scores) {_ECE}")
def ece_uniform(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.ece(scores(spark, d)), "ece")


@query(f"WITH {SCORES}, xy AS (SELECT risk_score AS x, label AS y FROM scores) {_ECE}")
def ece_positive(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.ece(scores(spark, d), positive=True), "ece")


@query(f"""WITH {SCORES}, xy AS (SELECT greatest(risk_score,1-risk_score) AS x, CAST(CAST(risk_score>=0.5e0 AS INT)=label AS INT) AS y FROM scores),
  e AS (SELECT quantile_cont(x, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS edges FROM xy), b AS (SELECT x, y, len(list_filter(edges, lambda v: v < x)) AS bin FROM xy, e)
  SELECT round(sum(n*abs(ax-ay))/sum(n),6) AS ece_quantile FROM (SELECT avg(x) AS ax, avg(y) AS ay, count(*) AS n FROM b GROUP BY bin)""")
def ece_quantile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.ece_quantile(scores(spark, d)), "ece_quantile")


_GROUPS = f"g AS (SELECT nation, {COUNTS} FROM (SELECT nation, label, CAST(risk_score >= 0.5e0 AS INT) AS p FROM scores) GROUP BY nation), kept AS (SELECT nation, tn, fp, fn, tp, tn+fp+fn+tp AS n, {RATES} FROM g WHERE tn+fp+fn+tp >= 0.04e0 * (SELECT count(*) FROM scores))"


@query(f"WITH {SCORES}, {_GROUPS} SELECT nation, tn, fp, fn, tp, n, {_ROUND_RATES} FROM kept")
def group_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.group_rates(scores(spark, d), "nation"), *_R)


_FAIR = ", ".join(f'round(CASE WHEN max("{r}")=0 THEN 0e0 ELSE min("{r}")/max("{r}") END,6) AS {r}_ratio, round(max("{r}")-min("{r}"),6) AS {r}_diff' for r in _R)
_FAIR_COLUMNS = [f"{r}_{x}" for r in _R for x in ("ratio", "diff")] + ["equalized_odds_ratio", "equalized_odds_diff"]


@query(f"WITH {SCORES}, {_GROUPS}, f AS (SELECT {_FAIR} FROM kept) SELECT *, least(fnr_ratio, fpr_ratio) AS equalized_odds_ratio, greatest(tpr_diff, fpr_diff) AS equalized_odds_diff FROM f")
def fairness_ratios(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.fairness(scores(spark, d), "nation"), *_FAIR_COLUMNS)


@query(f"""WITH {SCORES}, c AS (SELECT {COUNTS} FROM (SELECT label, CAST(risk_score >= 0.5e0 AS INT) AS p FROM scores)), r AS (SELECT tn, fp, fn, tp, {RATES} FROM c), {_ROC}, {_GROUPS},
  l AS (SELECT count(*) AS n_samples, sum(label)::BIGINT AS n_positives, sum(1-label)::BIGINT AS n_negatives, avg(-(label*ln(p)+(1-label)*ln(1-p))) AS log_loss, avg((risk_score-label)*(risk_score-label)) AS brier_score FROM (SELECT *, greatest(2.220446049250313e-16, least(1-2.220446049250313e-16, risk_score)) AS p FROM scores)),
  a AS (SELECT sum(neg * (tp - pos/2e0)) / (max(p)*max(n)) AS roc_auc FROM cum), f AS (SELECT {_FAIR} FROM kept)
  SELECT n_samples, n_positives, n_negatives, round(log_loss,6) AS log_loss, round(brier_score,6) AS brier_score, tn, fp, fn, tp, {_ROUND_RATES}, round(roc_auc,6) AS roc_auc, tpr_ratio, tpr_diff, least(fnr_ratio, fpr_ratio) AS equalized_odds_ratio, 0.5e0 AS threshold FROM l, r, a, f""")
def eval_record(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.evaluate(scores(spark, d), group="nation")
    names = ["n_samples", "n_positives", "n_negatives", "log_loss", "brier_score", "tn", "fp", "fn", "tp", *_R, "roc_auc", "tpr_ratio", "tpr_diff", "equalized_odds_ratio", "threshold"]
    return rounded(out.select(*names), "log_loss", "brier_score", *_R, "roc_auc", "tpr_ratio", "tpr_diff", "equalized_odds_ratio")


_REPLICATES = f"""one AS (SELECT rep, risk_score AS s, sum(w*label) AS pos, sum(w*(1-label)) AS neg FROM cells GROUP BY 1, 2),
  r AS (SELECT *, sum(pos) OVER (PARTITION BY rep ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS upto, least(9, floor(greatest(s,1-s)*10)) AS bin, greatest(2.220446049250313e-16, least(1-2.220446049250313e-16, s)) AS c FROM one),
  g AS (SELECT rep, sum(gap) AS gap FROM (SELECT rep, bin, abs(sum((pos+neg)*greatest(s,1-s)) - sum(CASE WHEN s>=0.5e0 THEN pos ELSE neg END)) AS gap FROM r GROUP BY 1, 2) GROUP BY 1),
  t AS (SELECT rep, sum(pos) AS p, sum(neg) AS n, sum(CASE WHEN s>=0.5e0 THEN pos ELSE 0 END) AS tp, sum(CASE WHEN s>=0.5e0 THEN neg ELSE 0 END) AS fp, sum(-(pos*ln(c)+neg*ln(1-c))) AS lg, sum(pos*(1-s)*(1-s)+neg*s*s) AS br, sum(neg*(upto-pos/2e0)) AS pairs FROM r GROUP BY rep),
  q AS (SELECT rep, n-fp AS tn, fp, p-tp AS fn, tp, p, n, lg, br, pairs, gap FROM t JOIN g USING (rep)),
  m AS (SELECT {RATES}, lg/(p+n) AS log_loss, br/(p+n) AS brier_score, gap/(p+n) AS ece, p/(p+n) AS prevalence, pairs/(p*n) AS roc_auc FROM q)
  SELECT metric, round(avg(value),6) AS mean, round(stddev_samp(value),6) AS std, round(quantile_cont(value,0.025),6) AS low, round(quantile_cont(value,0.975),6) AS high
  FROM (UNPIVOT m ON accuracy, tpr, fnr, fpr, tnr, balanced_accuracy, "precision", ppr, log_loss, brier_score, ece, prevalence, roc_auc INTO NAME metric VALUE value) GROUP BY metric"""
_HASH60 = "CAST('0x' || substr(md5({}), {}, 15) AS BIGINT)"


@query(f"""WITH {SCORES}, placed AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) AS pos, count(*) OVER () AS n FROM scores),
  drawn AS (SELECT rep, {_HASH60.format("CAST(rep AS VARCHAR) || ':' || CAST(pos-1 AS VARCHAR) || ':42'", 1)} % n + 1 AS pos FROM placed, range(200) t(rep)),
  cells AS (SELECT rep, risk_score, label, count(*) AS w FROM drawn JOIN placed USING (pos) GROUP BY 1, 2, 3), {_REPLICATES}""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.bootstrap(scores(spark, d)), "mean", "std", "low", "high")


_FACTOR = _HASH60.format("CAST(rep AS VARCHAR) || ':42:{}'", 1) + f" % {metrics.PRIME}"
_WEIGHT = " + ".join(f"CAST(u >= {e} AS INT)" for e in metrics.poisson_ends())
_WEIGHTS = f"""f AS (SELECT rep, 1 + ({_FACTOR.format(0)}) % {metrics.PRIME - 1} AS a, 1 + ({_FACTOR.format(1)}) % {metrics.PRIME - 1} AS b, {_FACTOR.format(2)} AS c FROM range(200) t(rep)),
  x AS (SELECT *, {_HASH60.format("CAST(row_id AS VARCHAR) || ':42'", 1)} % {metrics.PRIME} AS x, {_HASH60.format("CAST(row_id AS VARCHAR) || ':42'", 16)} % {metrics.PRIME} AS y FROM scores),
  u AS (SELECT x.*, rep, (a*x % {metrics.PRIME} + b*y % {metrics.PRIME} + c) % {metrics.PRIME} AS u FROM x, f), w AS (SELECT *, {_WEIGHT} AS w FROM u)"""


@query(f"WITH {SCORES}, {_WEIGHTS}, cells AS (SELECT rep, risk_score, label, sum(w) AS w FROM w WHERE w > 0 GROUP BY 1, 2, 3), {_REPLICATES}")
def bootstrap_poisson(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.poisson_bootstrap(scores(spark, d)), "mean", "std", "low", "high")


_ALL_METRICS = ["log_loss", "brier_score", "ece", "prevalence", "roc_auc", "ece_quantile", *_R, *_FAIR_COLUMNS]
_EDGES = "[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]"


@query(f"""WITH {SCORES}, {_WEIGHTS}, cells AS (SELECT rep, nation, risk_score, label, sum(w) AS w FROM w WHERE w > 0 GROUP BY ALL), {_REPLICATES.split("SELECT metric,")[0].replace("m AS (SELECT", "m0 AS (SELECT rep,").replace(" FROM q)", " FROM q),")}
  sure AS (SELECT rep, greatest(s,1-s) AS x, CASE WHEN s>=0.5e0 THEN pos ELSE neg END AS y, pos+neg AS w FROM one),
  edges AS (SELECT rep, quantile_cont(x, {_EDGES}) AS edges FROM (SELECT rep, x, unnest(range(w::BIGINT)) FROM sure) GROUP BY rep),
  eq AS (SELECT rep, sum(gap)/sum(w) AS ece_quantile FROM (SELECT rep, bin, abs(sum(x*w)-sum(y)) AS gap, sum(w) AS w FROM (SELECT sure.*, len(list_filter(edges, lambda v: v < x)) AS bin FROM sure JOIN edges USING (rep)) GROUP BY ALL) GROUP BY rep),
  gc AS (SELECT rep, nation, sum(CASE WHEN risk_score<0.5e0 THEN w*(1-label) ELSE 0 END) AS tn, sum(CASE WHEN risk_score>=0.5e0 THEN w*(1-label) ELSE 0 END) AS fp, sum(CASE WHEN risk_score<0.5e0 THEN w*label ELSE 0 END) AS fn, sum(CASE WHEN risk_score>=0.5e0 THEN w*label ELSE 0 END) AS tp FROM cells GROUP BY ALL),
  kept AS (SELECT rep, {RATES} FROM (SELECT *, sum(tn+fp+fn+tp) OVER (PARTITION BY rep) AS every FROM gc) WHERE tn+fp+fn+tp >= 0.04e0 * every),
  fr AS (SELECT rep, {_FAIR.replace(",6)", ",15)")} FROM kept GROUP BY rep),
  m AS (SELECT * EXCLUDE (rep) FROM m0 JOIN eq USING (rep) JOIN (SELECT *, least(fnr_ratio, fpr_ratio) AS equalized_odds_ratio, greatest(tpr_diff, fpr_diff) AS equalized_odds_diff FROM fr) USING (rep))
  SELECT metric, round(avg(value),6) AS mean, round(stddev_samp(value),6) AS std, round(quantile_cont(value,0.025),6) AS low, round(quantile_cont(value,0.975),6) AS high
  FROM (UNPIVOT m ON {", ".join(f'"{x}"' for x in _ALL_METRICS)} INTO NAME metric VALUE value) GROUP BY metric""")
def bootstrap_full(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of all metrics of evaluate(), fairness over groups among them, from 200 resamples."""
    return rounded(metrics.poisson_bootstrap(scores(spark, d), group="nation"), "mean", "std", "low", "high")


@query(f"""WITH {SCORES}, {_WEIGHTS}, e AS (SELECT quantile_cont(risk_score, [0.2,0.4,0.6,0.8]) AS edges FROM scores), b AS (SELECT w.*, len(list_filter(edges, lambda v: v < risk_score)) AS bin FROM w, e),
  share AS (SELECT segment, bin, rep, sum(w*label)/sum(w) AS v FROM b WHERE w > 0 GROUP BY 1, 2, 3), ends AS (SELECT segment, bin, quantile_cont(v,0.025) AS low, quantile_cont(v,0.975) AS high FROM share GROUP BY 1, 2),
  curve AS (SELECT segment, bin, avg(risk_score) AS mean_score, avg(label) AS share_positive, count(*) AS n FROM b WHERE rep = 0 GROUP BY 1, 2)
  SELECT segment, bin::INT AS bin, round(mean_score,6) AS mean_score, round(share_positive,6) AS share_positive, n, round(low,6) AS low, round(high,6) AS high FROM curve JOIN ends USING (segment, bin)""")
def calibration_interval(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.calibration_interval(scores(spark, d), "segment"), "mean_score", "share_positive", "low", "high")


_SOME = "given AS (SELECT row_id, label, segment, CASE WHEN row_id % 7 = 0 THEN NULL ELSE risk_score END AS risk_score FROM scores), known AS (SELECT * FROM given WHERE risk_score IS NOT NULL)"


@query(f"""WITH {SCORES}, {_SOME}, {_ROC.replace("FROM scores", "FROM known")}, c AS (SELECT {COUNTS} FROM (SELECT label, CAST(risk_score >= 0.5e0 AS INT) AS p FROM known))
  SELECT (SELECT count(*) FROM given WHERE risk_score IS NULL) AS n_unscored, (SELECT count(*) FROM known) AS n_samples, tn, fp, fn, tp, (SELECT round(sum(neg * (tp - pos/2e0)) / (max(p)*max(n)), 6) FROM cum) AS roc_auc,
  (SELECT round(avg(-(label*ln(risk_score+1e-300)+(1-label)*ln(1-risk_score))),6) FROM (SELECT label, greatest(2.220446049250313e-16, risk_score) AS risk_score FROM known)) AS log_loss FROM c""")
def unscored_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a model gave no score count in no metric, and are counted."""
    s = scores(spark, d).withColumn("risk_score", F.when(F.col("row_id") % 7 != 0, F.col("risk_score")))
    return rounded(metrics.evaluate(s).select("n_unscored", "n_samples", "tn", "fp", "fn", "tp", "roc_auc", "log_loss"), "roc_auc", "log_loss")


_FEATURES = ("price", "noise")


def _importance_sql() -> str:
    parts = []
    base = f"f AS (SELECT o_orderkey AS row_id, CAST(o_totalprice > 250000 AS INT) AS label, o_totalprice/600000e0 AS price, ({HASH32.format("CAST(o_orderkey AS VARCHAR) || ':7'")} % 10000)/10000e0 AS noise FROM orders), a AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) AS pos FROM f)"
    ctes = [base]
    auc = "SELECT {tag} AS feature, sum(neg*(tp-pos/2e0))/(max(p)*max(n)) AS auc FROM (SELECT pos, neg, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM (SELECT s, sum(label) AS pos, sum(1-label) AS neg FROM {src} GROUP BY s))"
    ctes.append("s0 AS (SELECT label, round(least(1e0, 0.6e0*price+0.4e0*noise), 6) AS s FROM f)")
    for k, f in enumerate(_FEATURES):
        for r in range(5):
            seed = 42 + 1000 * k + r
            other = [x for x in _FEATURES if x != f][0]
            ctes.append(f"b{k}{r} AS (SELECT row_number() OVER (ORDER BY md5(CAST(row_id AS VARCHAR) || ':{seed}'), row_id) AS pos, {f} AS v FROM f), s{k}{r} AS (SELECT label, round(least(1e0, 0.6e0*{'v' if f == 'price' else 'price'}+0.4e0*{'v' if f == 'noise' else 'noise'}), 6) AS s FROM (SELECT a.label, a.{other}, v FROM a JOIN b{k}{r} USING (pos)))")
            parts.append("(" + auc.format(tag=f"'{f}'", src=f"s{k}{r}") + ")")
    return f"WITH {', '.join(ctes)}, moved AS ({' UNION ALL '.join(parts)}), base AS ({auc.format(tag=chr(39) + chr(39), src='s0')}) SELECT moved.feature, round(avg(base.auc-moved.auc),6) AS imp_mean, round(stddev_pop(base.auc-moved.auc),6) AS imp_std FROM moved, base GROUP BY moved.feature"


@query(_importance_sql())
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") > 250000).cast("int").alias("label"), (F.col("o_totalprice") / 600000.0).alias("price"), uniform("o_orderkey", 7).alias("noise"))
    scorer = lambda df: F.round(F.least(F.lit(1.0), 0.6 * F.col("price") + 0.4 * F.col("noise")), 6)
    return rounded(metrics.importance(rows, list(_FEATURES), scorer), "imp_mean", "imp_std")


@query(f"WITH {SCORES} SELECT segment, round(avg(risk_score),6) AS score_mean, round(stddev_pop(risk_score),6) AS score_std, round(avg(label),6) AS prevalence FROM scores GROUP BY segment")
def score_stats(spark: SparkSession, d: str) -> DataFrame:
    out = scores(spark, d).groupBy("segment").agg(F.avg("risk_score").alias("score_mean"), F.stddev_pop("risk_score").alias("score_std"), F.avg("label").alias("prevalence"))
    return rounded(out, "score_mean", "score_std", "prevalence")


_BEST = "(SELECT threshold FROM (SELECT risk_score AS threshold, fp*p+(p-tp)*n AS cost FROM (SELECT risk_score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM (SELECT risk_score, sum(label) AS pos, sum(1-label) AS neg FROM {} GROUP BY 1) WINDOW w AS (ORDER BY risk_score DESC ROWS UNBOUNDED PRECEDING)) UNION ALL SELECT 1e0, (SELECT sum(label)*sum(1-label) FROM {})) ORDER BY cost, threshold DESC LIMIT 1)"


@query(f"WITH {SCORES}, few AS (SELECT * FROM scores ORDER BY md5(CAST(row_id AS VARCHAR) || ':42:0'), row_id LIMIT 100), t AS (SELECT {_BEST.format('few', 'few')} AS fitted, {_BEST.format('scores', 'scores')} AS optimal) SELECT round(fitted,6) AS fitted, round(optimal,6) AS optimal, round(avg(CAST(CAST(risk_score>=fitted AS INT)=label AS INT)),6) AS accuracy_fitted, round(avg(CAST(CAST(risk_score>=optimal AS INT)=label AS INT)),6) AS accuracy_optimal FROM scores, t GROUP BY fitted, optimal")
def fit_vs_optimal_threshold(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    fitted = metrics.best_threshold(dataset.sample(s, 100)).select(F.col("threshold").alias("fitted"))
    optimal = metrics.best_threshold(s).select(F.col("threshold").alias("optimal"))
    out = metrics.accuracy_at(s, fitted.crossJoin(optimal))
    return rounded(out, "fitted", "optimal", "accuracy_fitted", "accuracy_optimal")


_QUANTILES = "e AS (SELECT quantile_cont(risk_score, [0.2,0.4,0.6,0.8]) AS edges FROM scores), b AS (SELECT scores.*, len(list_filter(edges, lambda v: v < risk_score)) AS bin FROM scores, e)"


@query(f"WITH {SCORES}, {_QUANTILES} SELECT bin::INT AS bin, round(avg(risk_score),6) AS mean_score, round(avg(label),6) AS share_positive, count(*) AS n FROM b GROUP BY bin")
def calibration_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.calibration_curve(scores(spark, d)), "mean_score", "share_positive")


@query(f"WITH {SCORES}, {_QUANTILES} SELECT nation, bin::INT AS bin, round(avg(risk_score),6) AS mean_score, round(avg(label),6) AS share_positive, count(*) AS n FROM b WHERE nation IN (SELECT nation FROM scores GROUP BY 1 HAVING count(*) >= 0.04e0*(SELECT count(*) FROM scores)) GROUP BY nation, bin")
def calibration_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.calibration_curve(scores(spark, d), by=("nation",), min_share=0.04), "mean_score", "share_positive")


_CUT = "ends AS (SELECT {by} min(risk_score) AS lo, max(risk_score) AS hi FROM scores {group}), b AS (SELECT {by2} risk_score, label, greatest(0, ceil(round((risk_score-lo)/(hi-lo)*10, 9))-1) AS bin FROM scores {join}), t AS (SELECT {by} bin, avg(risk_score) AS s, avg(label) AS y, count(*) AS n FROM b GROUP BY {by} bin)"


@query(f"WITH {SCORES}, {_CUT.format(by='', by2='', group='', join=', ends')} SELECT round(sum(n*(CASE WHEN s<0.5e0 THEN (1-s)-(1-y) ELSE s-y END))/sum(n),6) AS confidence_bias FROM t")
def confidence_bias(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.bias(scores(spark, d)), "confidence_bias")


@query(f"""WITH {SCORES}, e AS (SELECT quantile_cont(risk_score, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS edges FROM scores), b AS (SELECT segment, risk_score, label, len(list_filter(edges, lambda v: v < risk_score)) AS bin FROM scores, e),
  t AS (SELECT segment, bin, avg(risk_score) AS s, avg(label) AS y, count(*) AS n FROM b GROUP BY 1, 2) SELECT segment, round(sum(n*(s-y))/sum(n),6) AS score_bias FROM t GROUP BY segment""")
def signed_bias_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.bias(scores(spark, d), signed=True, quantiles=True, by=("segment",)), "score_bias")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"WITH {SCORES}, {_CUT.format(by='segment,', by2='scores.segment,', group='GROUP BY segment', join='JOIN ends USING (segment)')}, x AS (SELECT segment, sum(n*(s-y))/sum(n) AS v FROM t GROUP BY segment) SELECT " + ", ".join(f"round(max(v) FILTER (segment='{s}'),6) AS {s.lower()}" for s in _SEGMENTS) + ", round(max(v) FILTER (segment='BUILDING') - max(v) FILTER (segment='MACHINERY'),6) AS building_v_machinery FROM x")
def signed_bias_pivot(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.bias(scores(spark, d), signed=True, by=("segment",)).groupBy().pivot("segment", _SEGMENTS).agg(F.max("score_bias"))
    out = out.select(*[F.col(s).alias(s.lower()) for s in _SEGMENTS]).withColumn("building_v_machinery", F.col("building") - F.col("machinery"))
    return rounded(out, *out.columns)


@query(f"WITH {SCORES} SELECT segment, least(19, floor(risk_score*20))::INT AS bin, count(*) AS n, round(100e0*count(*)/sum(count(*)) OVER (PARTITION BY segment),6) AS \"percent\" FROM scores GROUP BY 1, 2")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.histogram(scores(spark, d), by=("segment",)), "percent")


@query(f"WITH {SCORES}, n AS (SELECT risk_score, sum(label) AS pos, sum(1-label) AS neg FROM scores GROUP BY 1), k AS (SELECT i/20e0 AS x, sum(pos*exp(-((i/20e0-risk_score)/0.05e0)*((i/20e0-risk_score)/0.05e0)/2)) AS a, sum(neg*exp(-((i/20e0-risk_score)/0.05e0)*((i/20e0-risk_score)/0.05e0)/2)) AS b FROM n, range(21) t(i) GROUP BY i) SELECT round(x,6) AS x, 1 AS label, round(a/(a+b),6) AS share FROM k UNION ALL SELECT round(x,6), 0, round(b/(a+b),6) FROM k")
def score_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.density(scores(spark, d)), "x", "share")


@query("""WITH s AS (SELECT l_discount*10 AS risk_score, CAST(l_returnflag='R' AS INT) AS label FROM lineitem), b AS (SELECT risk_score, sum(label) AS pos, sum(1-label) AS neg FROM s GROUP BY 1),
  c AS (SELECT pos, neg, sum(pos) OVER (ORDER BY risk_score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM b)
  SELECT round(sum(neg*(tp-pos/2e0))/(max(p)*max(n)),6) AS roc_auc FROM c""")
def roc_auc_ties(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("risk_score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return rounded(metrics.roc_auc(rows), "roc_auc")


@query()
def ml_baseline_lr(spark: SparkSession, d: str) -> DataFrame:
    """Logistic regression on two features, evaluated; its optimiser has no counterpart in SQL."""
    from .baselines import fit_and_evaluate

    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") > 250000).cast("int").alias("label"), (F.col("o_totalprice") / 600000.0 * uniform("o_orderkey", 9)).alias("a"), uniform("o_orderkey", 7).alias("b"))
    return fit_and_evaluate(dataset.split(rows, test=0.3), ["a", "b"])


@query()
def ml_baseline_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees on features of all order lines, one of them with missing values, evaluated; a test grows the same trees in numpy."""
    from .baselines import fit_and_evaluate

    key, label = F.concat_ws("-", "l_orderkey", "l_linenumber"), (F.col("l_returnflag") == "R").cast("int")
    rows = table(spark, d, "lineitem").select(
        key.alias("row_id"), label.alias("label"), (F.col("l_extendedprice") * (0.4 * label + uniform(key, 9))).alias("a"),
        F.when(uniform(key, 7) > 0.2 + 0.3 * label, F.col("l_quantity")).alias("b"), F.col("l_discount").alias("c"),
    )
    return fit_and_evaluate(dataset.split(rows, test=0.3), ["a", "b", "c"], "XGBoost", trees=8, depth=3)


_BINNED = """SELECT CAST(l_returnflag = 'R' AS INT) AS y, CASE WHEN l_quantity % 7 > 0 THEN CAST(floor(l_quantity / 5) AS INT) END AS b0, CAST(floor(l_extendedprice / 4000) AS INT) AS b1 FROM lineitem"""


@query(f"""WITH r AS (SELECT 1 AS node, b0, b1, CASE WHEN y = 1 THEN -786432 ELSE 262144 END AS g, 196608 AS h FROM ({_BINNED})),
  x AS (SELECT node, 0 AS feature, b0 AS bin, g, h FROM r UNION ALL SELECT node, 1, b1, g, h FROM r),
  s AS (SELECT node, feature, bin, sum(g) AS g, sum(h) AS h FROM x GROUP BY 1, 2, 3),
  t AS (SELECT *, sum(CASE WHEN bin IS NULL THEN 0 ELSE g END) OVER up AS gu, sum(CASE WHEN bin IS NULL THEN 0 ELSE h END) OVER up AS hu, sum(g) OVER w AS ga, sum(h) OVER w AS ha,
    sum(CASE WHEN bin IS NULL THEN g ELSE 0 END) OVER w AS gn, sum(CASE WHEN bin IS NULL THEN h ELSE 0 END) OVER w AS hn FROM s
    WINDOW w AS (PARTITION BY node, feature), up AS (PARTITION BY node, feature ORDER BY bin NULLS FIRST ROWS UNBOUNDED PRECEDING)),
  c AS (SELECT node, feature, bin, m AS missing_left, CASE WHEN m THEN gu + gn ELSE gu END AS gl, CASE WHEN m THEN hu + hn ELSE hu END AS hl, ga, ha FROM t, (VALUES (true), (false)) v(m) WHERE bin IS NOT NULL),
  e AS (SELECT *, ga - gl AS gr, ha - hl AS hr FROM c),
  f AS (SELECT *, ((gl/1048576e0)*(gl/1048576e0)/(hl/1048576e0+1) + (gr/1048576e0)*(gr/1048576e0)/(hr/1048576e0+1) - (ga/1048576e0)*(ga/1048576e0)/(ha/1048576e0+1)) / 2 AS gain FROM e WHERE hl >= 1048576 AND hr >= 1048576)
  SELECT feature, bin, missing_left, gl::BIGINT AS gl, hl::BIGINT AS hl, gr::BIGINT AS gr, hr::BIGINT AS hr, round(gain, 6) AS gain FROM f WHERE gain > 0""")
def boosted_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every split of a first node, where each row's score is 0.25, with its gain."""
    quantity, price, y = F.col("l_quantity"), F.col("l_extendedprice"), (F.col("l_returnflag") == "R").cast("int")
    rows = table(spark, d, "lineitem").select(
        F.lit(1).alias("node"), ((0.25 - y) * boosting.UNIT).cast("long").alias("g"), F.lit(int(0.1875 * boosting.UNIT)).cast("long").alias("h"),
        F.when(quantity % 7 > 0, F.floor(quantity / 5)).alias("b0"), F.floor(price / 4000).alias("b1"),
    )
    return rounded(boosting.candidates(boosting.histogram(rows, ["quantity", "price"])).drop("node"), "gain")
