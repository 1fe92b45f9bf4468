"""The benchmark, its command line, sources and streaming, end to end with a stand-in for the model."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskframe import cli
from riskframe.operators import inference, results, valuemap
from riskframe.operators.task import Choice, MultipleChoice, Numeric, Task
from riskframe.operators.threshold import Threshold
from riskframe.operators.valuemap import ColumnToText
from riskframe.plans.benchmark import Benchmark, Config, FewShot
from riskframe.sources import tables
from riskframe.streaming import scorer

TASK = Task(
    "toy", "A toy.\n", ("a", "b"), "y", Threshold(3, ">"), "b", {"a": ColumnToText("a", "size", lambda x: x.cast("string")), "b": ColumnToText("b", "kind", {0: "old", 1: "new"})},
    MultipleChoice("y>3", "Is it large?", (Choice("No", 0), Choice("Yes", 1))), Numeric("y>3", "How likely?"),
)


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(120).select(F.col("id").alias("row_id"), (F.col("id") % 9).alias("a"), (F.col("id") % 2).cast("int").alias("b"), (F.col("id") % 7).alias("y"))


class Seen:
    def __call__(self, prompts):
        return [0.9 if "size is: 8" in p else 0.2 for p in prompts]


@pytest.mark.parametrize("config", [Config(), Config(numeric_risk_prompting=True), Config(cot_prompting=True), Config(correct_order_bias=False), Config(few_shot=FewShot(3, "balanced")), Config(use_chat_template=True, system_prompt="s"), Config(feature_subset=("a",)), Config(population_filter={"b": 1})])
def test_run(data, config, tmp_path):
    r = Benchmark(TASK, data, inference.HashBackend, config).run(str(tmp_path), test=0.3)
    assert 0 <= r["accuracy"] <= 1 and r["n_samples"] == (18 if config.population_filter else 36) or config.population_filter
    assert tables.load_json(r["path"])["config"]["hash"] == config.hash()


def test_scores_follow_the_backend(data):
    b = Benchmark(TASK, data, Seen)
    rows = b.scored(data).join(data, "row_id").collect()
    assert len(rows) == 120 and all(r["risk_score"] == (0.9 if r["a"] == 8 else 0.2) for r in rows)
    assert b.prompts(data).count() == 240
    assert 0 <= b.fit_threshold(b.data, 50) <= 1


def test_orders_are_averaged(data):
    class Key:
        def __call__(self, prompts):
            return [1.5 if "A. Yes" in p else 0.0 for p in prompts]

    assert {r["risk_score"] for r in Benchmark(TASK, data, Key).scored(data).collect()} == {0.5}


def test_config(tmp_path):
    with pytest.raises(ValueError):
        Config(few_shot=FewShot(1), use_chat_template=True)
    with pytest.raises(ValueError):
        Config(use_chat_template=True, cot_prompting=True)
    with pytest.raises(ValueError):
        FewShot(2, example_order=(0, 0))
    c = Config(few_shot=FewShot(2, (1, 1), example_order=(1, 0)), feature_subset=("a",))
    c.save(tmp_path / "c.json")
    assert Config.load(tmp_path / "c.json") == c and Config.load(tmp_path / "c.json").hash() == c.hash()
    tables.save_json({"few_shot": 3, "balance_few_shot_examples": True, "colour": 1}, tmp_path / "old.json")
    assert Config.load(tmp_path / "old.json").few_shot == FewShot(3, "balanced")
    with pytest.raises(ValueError):
        c.changed(nothing=1)


def test_command_line(spark, data, tmp_path):
    from riskframe.sources.census import TASKS

    task = TASKS["ACSIncome"]
    people = data.select("row_id", *[F.col("a").cast("double").alias(f) for f in task.features], (F.col("y") * 20000).alias("PINCP"))
    people.write.parquet(str(tmp_path / "people"))
    args = ["--model", "hash", "--results-dir", str(tmp_path), "--data", str(tmp_path / "people"), "--fit-threshold", "20", "--variation", "format=bullet;connector=is", "--use-population-filter", "SEX=1.0"]
    assert cli.main(args)["threshold_fitted_on"] == 20
    assert cli.pairs("a=1,b=x,c=true", ",") == {"a": 1, "b": "x", "c": True}
    assert cli.config(cli.parser().parse_args([*args, "--few-shot", "3", "--compose-few-shot-examples", "1,2"])).few_shot.compose == (1, 2)


def test_sources(spark, tmp_path):
    (tmp_path / "codes.txt").write_text("0010 .MGR-Chief Executives\nnot a code\n0020 .Other Engineers\n")
    from riskframe.functions.text import occupation

    book = tables.read_codebook(spark, str(tmp_path / "codes.txt"), occupation)
    assert sorted(map(tuple, book.collect())) == [(10, "Chief executives"), (20, "Other engineers")]
    df = spark.createDataFrame([(1, 10.0), (2, 99.0), (3, None), (4, 10.5)], "row_id long, x double")
    assert [r["t"] for r in valuemap.looked_up(df, "x", book, into="t", missing_fill="none").orderBy("row_id").collect()] == ["Chief executives", "N/A", "none", "N/A"]
    (tmp_path / "areas.csv").write_text("﻿# from somewhere\na;b;c;d;e;Sub;g;h;Country\n1;2;3;4;5;South;7;8;Somewhere\n")
    assert [tuple(r)[1:] for r in tables.read_areas(spark, str(tmp_path / "areas.csv")).collect()] == [("Somewhere", "South")]
    (tmp_path / "t.csv").write_text(",x\n5,1.5\n")
    assert tuple(tables.read_csv(spark, str(tmp_path / "t.csv"), "row_id long, x double").first()) == (5, 1.5)
    tables.save_results({"accuracy": 0.5, "config": {"seed": 1}, "plots": {"p": "q"}, "model": "o--Yi-34B-Chat"}, str(tmp_path / "r"), "m/x", "12")
    read = tables.read_results(spark, str(tmp_path / "r"), "accuracy double, config struct<seed: int>, plots map<string,string>, model string")
    flat = results.with_model_columns(results.flattened(read), "model").first()
    assert (flat["file_hash"], flat["config_seed"], flat["base_name"], flat["name"], flat["is_inst"]) == ("12", 1, "Yi-34B", "Yi 34B (it)", True)
    with pytest.raises(ValueError):
        results.require_unique(df.union(df), "row_id")
    assert "1 & 10.00" in tables.latex_table(df)
    tables.save_pickle({"a": 1}, tmp_path / "p")
    assert tables.load_pickle(tmp_path / "p") == {"a": 1}


def test_stream(spark, data, tmp_path):
    rows = data.select("row_id", "a", (F.col("y") > 3).cast("int").alias("label"), F.timestamp_seconds(F.col("row_id") * 60).alias("ts"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = scorer.scored_stream(stream, F.concat(F.lit("size is: "), F.col("a").cast("string")), Seen)
    scorer.write_scores(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("risk_score = 0.9").count() == data.where("a = 8").count()
    q = scorer.windowed_counts(out, "ts").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(tn + fp + fn + tp) FROM counts").first()[0] == 120


def test_large_value_maps_read_as_small_ones_do(spark):
    x = spark.createDataFrame([(3.0,), (999.0,), (1000.0,), (2.5,), (None,)], "x double")
    c = ColumnToText("x", "x", {i: f"t{i} \"ü\"" for i in range(1000)}, "none")
    assert [r[0] for r in x.select(c.of(F.col("x"))).collect()] == ['t3 "ü"', 't999 "ü"', "N/A", "N/A", "none"]


def test_models_of_the_command_line():
    """Names say which library opens a model; nothing is loaded before a task asks."""
    web = cli.backend("web:some/model", text=True)
    assert (web.gives, cli.backend("web:some/model").gives) == ("text", "words") and cli.backend("hash") is inference.HashBackend


def test_importance_by_the_command_line(data, tmp_path):
    from riskframe.sources.census import TASKS

    task = TASKS["ACSMobility"]
    names = {*task.features, "PINCP"}
    people = data.select("row_id", *[F.col("a").cast("double").alias(f) for f in sorted(names - {"AGEP"})], (F.col("y") * 5 + 15).cast("double").alias("AGEP"), (F.col("y") % 4).cast("double").alias("MIG"))
    people.write.parquet(str(tmp_path / "people"))
    args = ["--model", "hash", "--results-dir", str(tmp_path), "--data", str(tmp_path / "people"), "--task", "ACSMobility", "--use-feature-subset", "AGEP,SEX", "--feature-importance", "--importance-repeats", "1", "--subsampling", "0.9", "--task-population"]
    found = cli.main(args)["importance"]
    assert {f["feature"] for f in found} == {"AGEP", "SEX"}


def test_substring_lookup_by_an_index(spark):
    import random

    rng = random.Random(4)
    word = lambda lo, hi: "".join(rng.choice("abcé ") for _ in range(rng.randrange(lo, hi)))
    areas = [(i, word(0, 12), f"r{i}") for i in range(300)] + [(300, None, "none")]
    names = list({word(0, 6) for _ in range(200)} | {"", "a", "zzz", "ab(c"}) + [None]
    a = spark.createDataFrame(areas, "position int, area string, region string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    found = valuemap.region_lookup(n, "name", a)
    for r in found.collect():
        x = r["name"] if r["name"] is None else r["name"].split("(")[0].strip(" ")
        exact = [g for _, t, g in areas if t is not None and t == x]
        held = [g for _, t, g in areas if x is not None and t is not None and x in t]
        assert r["region"] == (exact or held or ["N/A"])[0], r
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
