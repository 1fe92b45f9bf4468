"""Queries on results of many runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import results
from .registry import query, rounded, table

_MODELS = ["Meta-Llama-3-8B", "Meta-Llama-3-8B-Instruct", "Mixtral-8x22B-v0.1", "Mixtral-8x22B-Instruct-v0.1", "gemma-1.1-7b-it", "Yi-34B-Chat", "openai/gpt-4o", "Qwen2-7B"]
_LIST = "[" + ", ".join(f"'{m}'" for m in _MODELS) + "]"
_RUNS = f"runs AS (SELECT s_suppkey AS run, 'org--' || ({_LIST})[s_suppkey % 8 + 1] AS model, s_nationkey AS task, s_acctbal AS accuracy FROM supplier)"
_BASE = "replace(replace(replace(replace(replace(m, '-Instruct', ''), '-Chat', ''), '-it', ''), '-1.1', ''), '-v0.2', '-v0.1')"
_PRETTY = "CASE m " + " ".join(f"WHEN '{m}' THEN '{t.DISPLAY_NAMES[m]}'" for m in _MODELS if m in t.DISPLAY_NAMES) + " ELSE m END"
_FAMILY = "CASE WHEN contains(lower(m), 'gpt') THEN 'OpenAI' WHEN contains(lower(m), 'llama') THEN 'Llama' WHEN contains(lower(m), 'mistral') OR contains(lower(m), 'mixtral') THEN 'Mistral' WHEN contains(lower(m), 'gemma') THEN 'Gemma' WHEN contains(lower(m), 'yi') THEN 'Yi' WHEN contains(lower(m), 'qwen') THEN 'Qwen' ELSE '-' END"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(m) for m in _MODELS])
    model = F.concat(F.lit("org--"), F.get(names, (F.col("s_suppkey") % 8).cast("int")))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("run"), model.alias("model"), F.col("s_nationkey").alias("task"), F.col("s_acctbal").alias("accuracy"))


@query(f"""WITH {_RUNS}, x AS (SELECT run, substr(model, instr(model, '--') + 2) AS m FROM runs)
  SELECT run, m AS model, {_BASE} AS base_name, {_PRETTY} AS name, {_BASE} <> m OR contains({_PRETTY}, '(it)') AS is_inst, {_FAMILY} AS family,
  CAST(nullif(regexp_extract(lower(m), '(?:(\\d+)x)?(\\d+)b', 2), '') AS INT) * coalesce(CAST(nullif(regexp_extract(lower(m), '(?:(\\d+)x)?(\\d+)b', 1), '') AS INT), 1) AS size, replace(m, '/', '--') AS path FROM x""")
def model_name_parse(spark: SparkSession, d: str) -> DataFrame:
    out = results.with_model_columns(_runs(spark, d), "model")
    m = F.col("model")
    return out.select("run", "model", "base_name", "name", "is_inst", t.model_family(m).alias("family"), t.model_size(m).alias("size"), t.path_name(m).alias("path"))


@query(f"WITH {_RUNS}, x AS (SELECT DISTINCT substr(model, instr(model, '--') + 2) AS m FROM runs), y AS (SELECT m, {_BASE} AS b FROM x) SELECT a.m AS tuned, c.m AS base FROM y a JOIN y c ON a.b = c.m AND a.m <> c.m")
def model_pair_selfjoin(spark: SparkSession, d: str) -> DataFrame:
    return results.base_pairs(results.with_model_columns(_runs(spark, d).select("model").distinct(), "model"))


@query(f"WITH {_RUNS}, a AS (SELECT model, task, max(accuracy) AS v FROM runs GROUP BY 1, 2) SELECT model, task, a.v AS mc, b.v AS num FROM a JOIN (SELECT model, task, min(accuracy) AS v FROM runs GROUP BY 1, 2) b USING (model, task)")
def composite_pair_join(spark: SparkSession, d: str) -> DataFrame:
    r = _runs(spark, d)
    a = r.groupBy("model", "task").agg(F.max("accuracy").alias("mc"))
    return a.join(r.groupBy("model", "task").agg(F.min("accuracy").alias("num")), ["model", "task"])


@query(f"WITH {_RUNS} SELECT task, round(min(accuracy),6) AS low, round(max(accuracy),6) AS high, round(avg(accuracy),6) AS mean FROM runs GROUP BY task")
def min_max_per_task(spark: SparkSession, d: str) -> DataFrame:
    out = _runs(spark, d).groupBy("task").agg(F.min("accuracy").alias("low"), F.max("accuracy").alias("high"), F.avg("accuracy").alias("mean"))
    return rounded(out, "low", "high", "mean")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS config_k, event_type AS config_type FROM events""")
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").select("event_id", F.struct(F.from_json("props", "k int")["k"].alias("k"), F.col("event_type").alias("type")).alias("config"), F.create_map(F.lit("a"), F.lit("b")).alias("plots"))
    return results.flattened(df)


@query("""WITH f AS (SELECT p_size, list_sort(list_distinct(list(p_brand))) AS brands FROM part GROUP BY 1), g AS (SELECT p_size, brands, coalesce(lag(brands) OVER (ORDER BY p_size), []) AS before FROM f)
  SELECT p_size, array_to_string(list_sort(list_filter(brands, lambda b: NOT list_contains(before, b))), ',') AS added FROM g""")
def added_features_lag(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "part").groupBy("p_size").agg(F.array_sort(F.collect_set("p_brand")).alias("brands"))
    return results.added_features(f, "brands", "p_size").select("p_size", F.array_join(F.array_sort("added"), ",").alias("added"))


@query("""WITH x AS (SELECT s_suppkey, s_nationkey, s_acctbal AS v, min(s_acctbal) OVER (PARTITION BY s_nationkey) AS lo, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS hi FROM supplier), y AS (SELECT *, CASE WHEN hi = lo THEN 0.5e0 ELSE (v-lo)/(hi-lo) END AS p FROM x)
  SELECT s_suppkey, CASE WHEN p >= 0.9e0 THEN '\\cellcolor{good}' WHEN p <= 0.1e0 THEN '\\cellcolor{bad}' ELSE '' END || printf('%.2f', v) AS cell FROM y""")
def shaded_cells(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey")
    return table(spark, d, "supplier").select("s_suppkey", t.shaded(F.col("s_acctbal"), F.min("s_acctbal").over(w), F.max("s_acctbal").over(w), True).alias("cell"))


@query("SELECT p_type, " + ", ".join(f"round(avg(p_retailprice) FILTER (p_size % 3 = {i}),6) AS f{i}_imp_mean, round(max(p_retailprice) FILTER (p_size % 3 = {i}),6) AS f{i}_imp_std" for i in range(3)) + " FROM part GROUP BY p_type")
def importance_pivot(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "part").groupBy("p_type", F.concat(F.lit("f"), (F.col("p_size") % 3).cast("string")).alias("feature")).agg(F.avg("p_retailprice").alias("imp_mean"), F.max("p_retailprice").alias("imp_std"))
    out = results.pivoted_importances(long, "p_type")
    return rounded(out, *[c for c in out.columns if c != "p_type"])


@query("SELECT word, CASE WHEN lower(word) IN ('true','false') THEN 'bool' WHEN regexp_matches(word, '^[-+]?\\d+$') THEN 'int' WHEN TRY_CAST(word AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'str' END AS kind FROM (SELECT CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN CAST(event_id AS VARCHAR) || '.5' WHEN 2 THEN 'True' ELSE event_type END AS word FROM events)")
def scalar_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    word = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(k.cast("string"), F.lit(".5"))).when(k % 4 == 2, "True").otherwise(F.col("event_type"))
    return table(spark, d, "events").select(word.alias("word")).withColumn("kind", t.scalar(F.col("word")))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT contains(lower(c_mktsegment), 'build') AND NOT contains(lower(c_mktsegment), 'mach')")
def rows_without_names(spark: SparkSession, d: str) -> DataFrame:
    return results.without_names(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "Build", "MACH")


@query("""WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE string_split(substr('a,b,c,d,e,f,g,h', 1, CAST(2 * (c_custkey % 8) + 1 AS INT)), ',') END AS features FROM customer),
  n AS (SELECT c_custkey, coalesce(len(features), -1) AS num_features FROM f) SELECT c_custkey, num_features FROM n WHERE num_features IN (-1, 2, 4, 6)""")
def runs_by_feature_count(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    features = F.when(k % 3 != 0, F.split(F.substring(F.lit("a,b,c,d,e,f,g,h"), F.lit(1), (2 * (k % 8) + 1).cast("int")), ","))
    rows = table(spark, d, "customer").select("c_custkey", features.alias("features"))
    return results.by_feature_count(rows, "features", [-1, 2, 4, 6], "c_custkey").select("c_custkey", "num_features")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y.%m.%d-%H.%M.%S') AS at FROM orders")
def time_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", t.time_text(F.col("o_orderdate")).alias("at"))


@query("SELECT p_brand AS feature, round(avg(p_retailprice), 6) AS imp_mean, row_number() OVER (ORDER BY avg(p_retailprice) DESC, p_brand) AS place FROM part GROUP BY p_brand")
def importance_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Features in the order of their importance; there are few."""
    from pyspark.sql import Window

    mean = table(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("imp_mean"))
    return rounded(mean.withColumn("place", F.row_number().over(Window.orderBy(F.desc("imp_mean"), "feature"))), "imp_mean")
