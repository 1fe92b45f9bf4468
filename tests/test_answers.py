"""Each prompt is asked once: by the store, by thresholds, by importance, and after failures."""

from __future__ import annotations

import os
import uuid

import pytest
from pyspark.sql import functions as F

from riskframe.operators.inference import Model, Priced, Settings
from riskframe.plans.benchmark import Benchmark, Config
from riskframe.sources.answers import NUMBERS, AnswerStore

from .test_benchmark import TASK


class Counted:
    """Notes each prompt in a folder of files; fails while a file says so."""

    def __init__(self, folder, settings=None):
        self.folder, self.settings = str(folder), settings

    def __call__(self, prompts):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\x00".join(prompts))
        if os.path.exists(f"{self.folder}.fails"):
            raise RuntimeError("on purpose")
        return [0.1 * (len(p) % 7) for p in prompts]


def asked(folder) -> list[str]:
    return [p for f in folder.iterdir() for p in f.read_text().split("\x00")]


@pytest.fixture
def seen(tmp_path):
    (tmp_path / "seen").mkdir()
    return tmp_path / "seen"


@pytest.fixture(scope="module")
def data(spark):
    """No two rows read alike."""
    return spark.range(90).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("a"), (F.col("id") % 2).cast("int").alias("b"), (F.col("id") % 7).alias("y"))


def test_importance_asks_once_about_each_prompt(data, seen):
    b = Benchmark(TASK, data, lambda: Counted(seen), Config(correct_order_bias=False))
    tested = b.split(0.3).where("split = 'test'").count()
    found = b.importance(repeats=2, test=0.3)
    prompts = asked(seen)
    assert len(prompts) == len(set(prompts)) <= tested * (1 + 2 * 2)
    assert len(prompts) > tested and {f["feature"] for f in found} == {"a", "b"}


def test_threshold_and_evaluation_ask_once(data, seen, tmp_path):
    b = Benchmark(TASK, data, lambda: Counted(seen), Config(correct_order_bias=False), answers=str(tmp_path / "store"))
    b.fit_threshold(b.data, 50)
    assert len(asked(seen)) == 50
    record = b.run(fit_threshold=50, test=0.3)
    assert len(asked(seen)) == len(set(asked(seen))) and record["n_answers"] == len(asked(seen))
    before = len(asked(seen))
    again = Benchmark(TASK, data, lambda: Counted(seen), Config(correct_order_bias=False), answers=str(tmp_path / "store")).run(fit_threshold=50, test=0.3)
    assert len(asked(seen)) == before and again["accuracy"] == record["accuracy"]
    other = Benchmark(TASK, data, lambda: Counted(seen), Config(correct_order_bias=False, prompt_variation={"format": "comma"}), answers=str(tmp_path / "store")).run(test=0.3)
    assert len(asked(seen)) == before + other["n_samples"]  # the same rows asked about in other words


def test_store_keys_are_prompt_model_and_settings(spark, seen, tmp_path):
    store = AnswerStore(str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "yy"), (4, None), (5, "")], "i int, prompt string").withColumn("answerless", F.lit(1))
    got = {r["i"]: r["answer"] for r in store.answered(rows, lambda: Counted(seen), model_name="m").collect()}
    assert got == {1: pytest.approx(0.1), 2: pytest.approx(0.1), 3: pytest.approx(0.2), 4: None, 5: 0.0}
    assert sorted(asked(seen)) == ["", "x", "yy"]
    store.answered(rows, lambda: Counted(seen), model_name="other")
    assert len(asked(seen)) == 6
    assert store.answered(rows.limit(0), lambda: Counted(seen), model_name="m").count() == 0 and len(asked(seen)) == 6


class Dear:
    """Costs a quarter; has no answer to some prompts until there is a file."""

    def __init__(self, folder, settings):
        self.folder = folder

    def __call__(self, prompts):
        ready = os.path.exists(f"{self.folder}.ready")
        if os.path.exists(f"{self.folder}.fails") and any(p == "p7" for p in prompts):
            raise RuntimeError("on purpose")
        return [Priced(None if p == "p3" and not ready else f"Probability: 0.{p[1:]}", 0.25) for p in prompts]


def test_totals_count_each_answer_once_though_jobs_fail(spark, tmp_path):
    store, mark = AnswerStore(str(tmp_path / "store")), str(tmp_path / "x")
    model = Model(lambda settings: Dear(mark, settings), "text")
    rows = spark.range(40).select(F.col("id"), F.concat(F.lit("p"), (F.col("id") % 10).cast("string")).alias("prompt")).repartition(4)
    open(f"{mark}.fails", "w").close()
    with pytest.raises(Exception, match="on purpose"):
        store.answered(rows, model, model_name="m", settings=Settings())
    assert store.totals(spark) == {"n_answers": 0, "cost": 0.0}  # what tasks of a failed job wrote doesn't count
    os.remove(f"{mark}.fails")
    out = store.answered(rows, model, model_name="m", settings=Settings())
    assert store.totals(spark) == {"n_answers": 9, "cost": 2.25} and out.where("answer IS NULL").count() == 4
    open(f"{mark}.ready", "w").close()
    assert store.answered(rows, model, model_name="m", settings=Settings()).where("answer IS NULL").count() == 0  # a missing answer is asked again
    assert store.totals(spark) == {"n_answers": 10, "cost": 2.5}
    assert store.answered(rows, model, model_name="m", settings=Settings(temperature=0.5)).count() == 40 and store.totals(spark)["n_answers"] == 20


def test_two_runs_at_once_give_one_answer(spark, tmp_path):
    store = AnswerStore(str(tmp_path / "store"))
    rows = spark.createDataFrame([("x",)], "prompt string")
    store.answered(rows, lambda: Counted(tmp_path), model_name="m")
    batch = store.batches(spark, NUMBERS)
    batch.withColumns({"answer": F.lit(9.0), "batch": F.lit("zzz")}).write.parquet(f"{store.path}/{NUMBERS}/zzz")
    assert [r["answer"] for r in store.answered(rows, lambda: Counted(tmp_path), model_name="m").collect()] == [pytest.approx(0.1)]
