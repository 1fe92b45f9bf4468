"""Queries on tables, splits, samples, value maps and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import dataset, results, valuemap
from ..operators.threshold import OPERATORS, Threshold
from ..sources import survey
from .registry import SCORES, query, rounded, scores, table

_NAMES = {">": "gt", "<": "lt", ">=": "ge", "<=": "le", "==": "eq", "!=": "ne"}


@query("WITH x AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS v FROM orders) SELECT row_id, " + ", ".join(f"CASE WHEN v IS NULL THEN {int(op == '!=')} ELSE CAST(v {'=' if op == '==' else op} 700 AS INT) END AS {n}" for op, n in _NAMES.items()) + " FROM x")
def threshold_ops(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey"))
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), v.alias("v"))
    return df.select("row_id", *[Threshold(700, op).of(F.col("v")).alias(_NAMES[op]) for op in OPERATORS])


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def population_filter(spark: SparkSession, d: str) -> DataFrame:
    return dataset.filtered(table(spark, d, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": 7}).select("c_custkey", "c_nationkey", "c_mktsegment")


@query('SELECT p_brand, p_size, CAST(p_retailprice > 1000 AS INT) AS "p_retailprice>1000" FROM part')
def feature_projection(spark: SparkSession, d: str) -> DataFrame:
    limit = Threshold(1000, ">")
    return limit.add(table(spark, d, "part"), "p_retailprice").select("p_brand", "p_size", f"`{limit.name('p_retailprice')}`")


_SPLIT = "r AS (SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey) AS p, count(*) OVER () AS n FROM orders), e AS (SELECT *, floor(n*0.7e0+1e-9)::BIGINT AS a, floor(n*0.9e0+1e-9)::BIGINT AS b FROM r), split AS (SELECT row_id, CASE WHEN p<=a THEN 'train' WHEN p<=b THEN 'test' ELSE 'val' END AS split, CASE WHEN p<=a THEN p WHEN p<=b THEN p-a ELSE p-b END AS split_rank FROM e)"


@query(f"WITH {_SPLIT} SELECT * FROM split")
def exact_split(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split(table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id")), test=0.2, val=0.1)


@query(f"WITH {_SPLIT} SELECT row_id, split, split_rank FROM split JOIN (SELECT split, floor(count(*)*0.125e0+0.5e0) AS k FROM split GROUP BY 1) USING (split) WHERE split_rank <= k")
def subsample_split(spark: SparkSession, d: str) -> DataFrame:
    rows = dataset.split(table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id")), test=0.2, val=0.1)
    return dataset.subsample(rows, 0.125).select("row_id", "split", "split_rank")


@query(f"WITH {_SPLIT}, kept AS (SELECT split.row_id, split, row_number() OVER (PARTITION BY split ORDER BY split_rank) AS split_rank FROM split JOIN orders ON row_id = o_orderkey WHERE o_orderstatus = 'F') SELECT row_id, split, split_rank FROM kept JOIN (SELECT split, floor(count(*)*0.5e0+0.5e0) AS k FROM kept GROUP BY 1) USING (split) WHERE split_rank <= k")
def subsample_population(spark: SparkSession, d: str) -> DataFrame:
    """Half of each split of the rows that a filter leaves."""
    rows = dataset.split(table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderstatus"), test=0.2, val=0.1)
    return dataset.subsample(dataset.filtered(rows, {"o_orderstatus": "F"}), 0.5).select("row_id", "split", "split_rank")


@query("SELECT o_orderkey AS row_id, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42:0'), o_orderkey LIMIT 50")
def sample_n_random(spark: SparkSession, d: str) -> DataFrame:
    return dataset.sample(table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice"), 50)


_STRATA = "SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS p FROM labels) WHERE p <= CASE quality WHEN 0 THEN {} ELSE {} END"


@query(_STRATA.format(11, 10))
def stratified_balanced(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select("doc_id", "quality")
    return dataset.stratified(rows, dataset.balanced_counts([0, 1], 21), "quality", row_id="doc_id")


@query(_STRATA.format(5, 17))
def stratified_counts(spark: SparkSession, d: str) -> DataFrame:
    return dataset.stratified(table(spark, d, "labels").select("doc_id", "quality"), {0: 5, 1: 17}, "quality", row_id="doc_id")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) WHERE k <= 5")
def head_per_group(spark: SparkSession, d: str) -> DataFrame:
    return dataset.head_per_group(table(spark, d, "events"), "event_type", 5, "event_id").select("event_type", "event_id")


_CODES = "x AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 99e0 WHEN c_custkey % 17 = 0 THEN c_nationkey + 0.5e0 ELSE c_nationkey END AS code FROM customer)"


def _codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    code = F.when(k % 11 == 0, None).when(k % 13 == 0, 99.0).when(k % 17 == 0, F.col("c_nationkey") + 0.5).otherwise(F.col("c_nationkey"))
    return table(spark, d, "customer").select("c_custkey", code.alias("code"))


@query(f"WITH {_CODES} SELECT c_custkey, CASE WHEN code IS NULL THEN 'unknown nation' ELSE coalesce(n_name, 'N/A') END AS text FROM x LEFT JOIN nation ON code = n_nationkey")
def value_map_lookup(spark: SparkSession, d: str) -> DataFrame:
    return valuemap.looked_up(_codes(spark, d), "code", table(spark, d, "nation"), code="n_nationkey", text="n_name", into="text", missing_fill="unknown nation").select("c_custkey", "text")


@query(f"WITH {_CODES} SELECT c_custkey, CASE WHEN code IS NULL THEN 'N/A' WHEN code IN (0, 5, 14, 15, 16) THEN 'first' WHEN code IN (1, 2, 3) THEN 'second' ELSE 'N/A' END AS text FROM x")
def value_map_two_stage(spark: SparkSession, d: str) -> DataFrame:
    groups = valuemap.composed({0: 1, 5: 1, 14: 1, 15: 1, 16: 1, 1: 2, 2: 2, 3: 2, 4: 9}, {1: "first", 2: "second"})
    return _codes(spark, d).select("c_custkey", valuemap.ColumnToText("code", "code", groups).of(F.col("code")).alias("text"))


@query("""WITH areas AS (SELECT n_nationkey AS position, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'Republic of ' || n_name END AS area, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
  x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'Atlantis' WHEN s_suppkey % 5 = 0 THEN 'Elsewhere' ELSE n_name || ' (mainland)' END AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  n AS (SELECT *, trim(split_part(place, '(', 1)) AS name FROM x),
  e AS (SELECT name, min_by(region, position) AS r FROM (SELECT DISTINCT name FROM n) JOIN areas ON name = area GROUP BY 1), c AS (SELECT name, min_by(region, position) AS r FROM (SELECT DISTINCT name FROM n) JOIN areas ON contains(area, name) GROUP BY 1)
  SELECT s_suppkey, place, coalesce(e.r, c.r, CASE WHEN n.name = 'Atlantis' THEN 'Ocean' END, 'N/A') AS region FROM n LEFT JOIN e ON n.name = e.name LEFT JOIN c ON n.name = c.name""")
def substring_region_lookup(spark: SparkSession, d: str) -> DataFrame:
    n, r, s = (table(spark, d, x) for x in ("nation", "region", "supplier"))
    named = n.join(r, n.n_regionkey == r.r_regionkey)
    areas = named.select(F.col("n_nationkey").alias("position"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.concat(F.lit("Republic of "), "n_name")).alias("area"), F.col("r_name").alias("region"))
    place = F.when(F.col("s_suppkey") % 7 == 0, "Atlantis").when(F.col("s_suppkey") % 5 == 0, "Elsewhere").otherwise(F.concat("n_name", F.lit(" (mainland)")))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", place.alias("place"))
    return valuemap.region_lookup(rows, "place", areas, regions={"Atlantis": "Ocean"})


@query("""SELECT p_partkey, CASE WHEN a < 18 THEN 'Less than 18 years old' WHEN a >= 90 THEN '90 or more years old' WHEN a < 30 THEN '18-29 years old' ELSE CAST((a // 10) * 10 AS VARCHAR) || '-' || CAST((a // 10) * 10 + 9 AS VARCHAR) || ' years old' END AS age,
  CASE WHEN h <= 0 THEN 'N/A (less than 16 years old, or did not work during the past 12 months)' WHEN h >= 60 THEN 'more than 60 hours' ELSE CAST((h // 10) * 10 AS VARCHAR) || '-' || CAST((h // 10) * 10 + 9 AS VARCHAR) || ' hours' END AS hours FROM (SELECT p_partkey, p_size * 2 AS a, p_size * 2 - 20 AS h FROM part)""")
def binning_labels(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("p_size") * 2
    return table(spark, d, "part").select("p_partkey", t.age_range(x).alias("age"), t.hours_range(x - 20).alias("hours"))


@query("SELECT p_partkey, CAST(x AS VARCHAR) || '% of the poverty line income, which is ' || CASE WHEN x < 90 THEN 'below' WHEN x < 110 THEN 'at or near' ELSE 'above' END || ' the poverty line' AS text, '$' || format('{:,}', (p_retailprice*1000)::BIGINT) AS dollars FROM (SELECT p_partkey, p_size * 4 AS x, p_retailprice FROM part)")
def poverty_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", t.poverty_ratio(F.col("p_size") * 4).alias("text"), t.dollars(F.round(F.col("p_retailprice") * 1000)).alias("dollars"))


@query("""WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'MGR-' || p_name WHEN 1 THEN 'Other Engineering-less' WHEN 2 THEN 'Unemployed And ' || p_name ELSE p_name || '/' || p_type END AS v FROM part)
  SELECT p_partkey, trim(upper(substr(y, 1, 1)) || lower(substr(y, 2))) AS occupation, trim(split_part(v, '/', 1)) AS place,
  CASE WHEN contains(v, '-') THEN split_part(v, '-', 1) WHEN contains(v, 'Engineering') THEN 'ENG' WHEN starts_with(v, 'Grinding') THEN 'PRD' WHEN starts_with(v, 'Unemployed') THEN 'UNEMPL' ELSE v END AS sector
  FROM (SELECT *, CASE WHEN contains(v, '-') THEN regexp_replace(v, '^[^-]*-', '') ELSE v END AS y FROM x)""")
def occupation_case(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    v = F.when(k == 0, F.concat(F.lit("MGR-"), "p_name")).when(k == 1, "Other Engineering-less").when(k == 2, F.concat(F.lit("Unemployed And "), "p_name")).otherwise(F.concat("p_name", F.lit("/"), "p_type"))
    df = table(spark, d, "part").select("p_partkey", v.alias("v"))
    return df.select("p_partkey", t.occupation(F.col("v")).alias("occupation"), t.before_slash(F.col("v")).alias("place"), t.sector(F.col("v")).alias("sector"))


@query(f"WITH {SCORES} SELECT row_id, round(risk_score, 6) AS risk_score, segment FROM scores JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON row_id = o_orderkey")
def index_align_join(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("row_id"))
    return rounded(scores(spark, d).join(done, "row_id").select("row_id", "risk_score", "segment"), "risk_score")


@query("SELECT coalesce(a.k, b.k) AS k, a.customers, b.suppliers FROM (SELECT floor(c_acctbal/100)::BIGINT AS k, count(*) AS customers FROM customer GROUP BY 1) a FULL OUTER JOIN (SELECT floor(s_acctbal/100)::BIGINT AS k, count(*) AS suppliers FROM supplier GROUP BY 1) b ON a.k = b.k")
def full_outer_stats(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers by balance, in hundreds; some hundreds have only one of them."""
    a = table(spark, d, "customer").groupBy(F.floor(F.col("c_acctbal") / 100).alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, d, "supplier").groupBy(F.floor(F.col("s_acctbal") / 100).alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full_outer")


@query("SELECT a.k, a.n AS n_mc, b.n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def side_by_side_left(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return results.side_by_side(a, results.require_unique(b, "k"), "k", "_mc")


@query("SELECT o_orderkey AS row_id FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)")
def cache_anti_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"))
    return results.unscored(rows, rows.where("row_id % 3 <> 0"))


@query("WITH x AS (SELECT s_nationkey, floor(s_acctbal/1000)::BIGINT AS band FROM supplier) SELECT a.s_nationkey, b.band FROM (SELECT DISTINCT s_nationkey FROM x) a, (SELECT DISTINCT band FROM x) b WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.s_nationkey = a.s_nationkey AND x.band = b.band)")
def completeness_anti(spark: SparkSession, d: str) -> DataFrame:
    """Nations and bands of balance that no supplier has together."""
    return results.absent_combinations(table(spark, d, "supplier").select("s_nationkey", F.floor(F.col("s_acctbal") / 1000).alias("band")), "s_nationkey", "band")


@query("SELECT DISTINCT c_mktsegment FROM customer")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_mktsegment").distinct()


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def drop_dup_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("digest"))
    return results.first_of_each(rows, ["digest"], "doc_id")


@query("SELECT s_suppkey AS k, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def union_missing_cols(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return results.stacked(a, b).select("k", "name", "balance", "segment")


@query("SELECT c_mktsegment, c_nationkey, count(c_acctbal) AS n FROM customer GROUP BY 1, 2")
def count_by_family(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("c_acctbal").alias("n"))


@query("SELECT max(greatest(a, b)) AS most FROM (SELECT count(DISTINCT c_nationkey) AS a, count(DISTINCT c_name) AS b FROM customer GROUP BY c_mktsegment)")
def nunique_max(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("a"), F.countDistinct("c_name").alias("b"))
    return g.agg(F.max(F.greatest("a", "b")).alias("most"))


@query("SELECT quality, count(*) AS n FROM labels GROUP BY quality")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@query("WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal END AS a, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_nationkey END AS b FROM supplier) SELECT s_suppkey, coalesce(a, -1) AS a, coalesce(b, -1) AS b, (SELECT count(*) FROM x WHERE a IS NULL OR b IS NULL) AS n_missing FROM x")
def fill_and_count(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    x = table(spark, d, "supplier").select("s_suppkey", F.when(k % 4 != 0, F.col("s_acctbal")).alias("a"), F.when(k % 6 != 0, F.col("s_nationkey")).alias("b"))
    n = x.agg(F.count_if(dataset.validity(x, ["a", "b"])).alias("n_missing"))
    return x.fillna(-1, subset=["a", "b"]).crossJoin(n)


@query("SELECT c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r % 2 = 1")
def every_other_row(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return table(spark, d, "customer").withColumn("_r", r).where("_r % 2 = 1").select("c_custkey", "c_acctbal")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_nationkey * 1000 + s_suppkey % 10 DESC, s_suppkey LIMIT 10")
def composite_sort(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").orderBy(F.desc(F.col("s_nationkey") * 1000 + F.col("s_suppkey") % 10), "s_suppkey").limit(10).select("s_suppkey", "s_name")


@query("WITH a AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS p FROM orders), b AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':5'), o_orderkey) AS p FROM orders) SELECT o_orderkey AS row_id, v AS price FROM a JOIN b USING (p)")
def column_permutation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"))
    return dataset.permuted(rows, "price", seed=5)


@query(f"WITH {_SPLIT} SELECT row_id, split, split_rank FROM split WHERE split = 'train' AND split_rank > 10 AND split_rank <= 60")
def rows_by_place(spark: SparkSession, d: str) -> DataFrame:
    """Fifty rows of the training split, by place."""
    rows = dataset.split(table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id")), test=0.2, val=0.1)
    return dataset.rows_at(rows, "train", 10, 60).select("row_id", "split", "split_rank")


# Orders as a survey: those of 1995 in the layout of 2018, those of 1996 in that of 2019, with another name and other codes of the same relationship.
_RELATED = " ".join(f"WHEN {new} THEN {old}" for new, old in survey.RELATIONSHIP_BEFORE_2019.items())


@query(f"""WITH people AS (SELECT year(o_orderdate) + 23 AS "year", c_nationkey + 1 AS "ST", CASE WHEN year(o_orderdate) + 23 < 2019 THEN o_orderkey % 18 ELSE CASE 20 + o_orderkey % 20 {_RELATED} END END AS "RELP", o_orderkey
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) + 23 IN (2018, 2019))
  SELECT CAST("year" AS INT) AS "year", CAST("ST" AS INT) AS "ST", CAST("RELP" AS INT) AS "RELP", count(*) AS people, min(o_orderkey) AS first_person FROM people WHERE "ST" IN (6, 12, 17) GROUP BY ALL""")
def survey_years(spark: SparkSession, d: str) -> DataFrame:
    """Relationships in three states over two years whose files name and code them differently; other years' rows fall away in the scan."""
    people = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    old = people.where("o_orderdate >= TIMESTAMP_NTZ '1995-01-01' AND o_orderdate < TIMESTAMP_NTZ '1996-01-01'").select((F.col("c_nationkey") + 1).alias("ST"), (F.col("o_orderkey") % 18).alias("RELP"), F.col("o_orderkey").alias("SERIALNO"))
    new = people.where("o_orderdate >= TIMESTAMP_NTZ '1996-01-01' AND o_orderdate < TIMESTAMP_NTZ '1997-01-01'").select((F.col("c_nationkey") + 1).alias("ST"), (20 + F.col("o_orderkey") % 20).alias("RELSHIPP"), F.col("o_orderkey").alias("SERIALNO"))
    columns = {"ST": "int", "RELP": "int", "SERIALNO": "bigint"}
    both = [survey.reconciled(raw, year, columns).withColumn("year", F.lit(year)) for year, raw in ((2018, old), (2019, new))]
    some = both[0].unionByName(both[1]).where(F.col("ST").isin(survey.numbers(["CA", "FL", "IL"])))
    return some.groupBy("year", "ST", "RELP").agg(F.count("*").alias("people"), F.min("SERIALNO").alias("first_person"))
