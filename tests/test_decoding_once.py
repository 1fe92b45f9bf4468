"""What decoding uses several times is computed once a row, and what is known beforehand never in a row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskframe.operators import inference
from riskframe.operators.inference import KINDS, Model
from riskframe.operators.task import Numeric

from .test_benchmark import TASK


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("question", [Numeric("y", "?"), TASK.multiple_choice])
def test_words_of_an_answer_are_listed_once(spark, question):
    model = Model(None, "words")
    rows = spark.createDataFrame([(1, ("0.42 or so", [{"4": 0.6, "so": 0.3, " B": 0.3, " A": 0.1}, {"2": 0.7}])), (2, ("none", [{"x": 1.0}])), (3, None)], f"k int, answer {KINDS['words'][0]}")
    scored = rows.select("k", inference.risk(F.col("answer"), model, question).alias("s"))
    assert plan(scored).count("array_distinct") == 1 and plan(scored).count("flatten") == 1
    got = {r["k"]: r["s"] for r in scored.collect()}
    numeric = isinstance(question, Numeric)
    assert got[1] == pytest.approx(0.42 if numeric else 0.75) and got[2] == (None if numeric else 0.5) and got[3] is None


def test_numeric_tokens_are_not_searched_for_in_each_row(spark):
    model = Model(None, "tokens", {str(i): 20 - i for i in range(10)} | {".": 30, "x": 31, "7x": 32, "77": 99}, 40)
    rows = spark.createDataFrame([(1, [{20: 0.1, 16: 0.5, 31: 0.9}, {18: 0.3}]), (2, [{31: 1.0}]), (3, [])], f"k int, answer {KINDS['tokens'][0]}")
    scored = rows.select("k", inference.risk(F.col("answer"), model, Numeric("y", "?")).alias("s"))
    assert "map_filter" not in plan(scored) and plan(scored).count("array_min") == 1
    # Of tokens that the answer lacks the one of the lowest id counts.
    assert {r["k"]: r["s"] for r in scored.collect()} == {1: 0.42, 2: 0.9, 3: None}
