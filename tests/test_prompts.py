"""Prompts and decoding: known cases, and one prompt byte for byte."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskframe.functions import text as t
from riskframe.operators import decode
from riskframe.operators.prompt import ChatTemplate, PromptConfig, Prompts, ended_at, reordered
from riskframe.operators.task import Choice, MultipleChoice, Reasoned, config_hash
from riskframe.sources.census import COLUMNS, LOW, TASKS

QUESTION = MultipleChoice("q", "?", (Choice("No", 0, 0.0), Choice("Yes", 1, 1.0)))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def as_map(d, kind="map<string,int>"):
    return F.create_map(*[F.lit(v) for kv in d.items() for v in kv]) if d else F.lit(None).cast(kind)


@pytest.mark.parametrize(
    "vocabulary, tokens, size, want",
    [
        ({" A": 1, " B": 2, " C": 3}, {1: 0.2, 2: 0.8}, 10, 0.8),
        ({" A": 1, " B": 2, "A": 11, "B": 12}, {1: 0.4, 2: 0.6}, 20, 0.6),
        ({" A": 1, " B": 2}, {1: 0.5}, 10, 0.0),
        ({" A": 1, " B": 99}, {1: 0.7, 99: 0.3}, 10, 0.0),
        ({" A": 1, " B": 2}, {1: 1.0, 2: 1.0}, 10, 0.5),
        ({" A": 1, " B": 2, " C": 3}, {99: 0.5, 100: 0.5}, 200, 0.5),
        ({" A": 1, " B": 2}, {1: 0.5, 2: 0.5, -1: 0.99}, 10, 0.5),
    ],
)
def test_choices(spark, vocabulary, tokens, size, want):
    found = decode.multiple_choice(decode.in_range(as_map(tokens), size), as_map(vocabulary), QUESTION)
    assert one(spark, found) == pytest.approx(want)


DIGITS = {str(i): i for i in range(10)}


@pytest.mark.parametrize(
    "vocabulary, passes, size, want",
    [
        (DIGITS, [{2: 0.7, 1: 0.2, 5: 0.05}, {5: 0.6, 4: 0.3, 6: 0.05}], 10, 0.25),
        (DIGITS | {"25": 25}, [{25: 0.9, 2: 0.05}, {0: 0.5}], 30, 0.250),
        (DIGITS | {".": 11}, [{5: 0.9}, {11: 0.9}], 20, 0.5),
        (DIGITS | {"99": 99}, [{99: 0.9, 3: 0.05, 1: 0.02}, {2: 0.5}], 10, 0.32),
    ],
)
def test_numbers(spark, vocabulary, passes, size, want):
    found = decode.numeric(F.array(*[as_map(p) for p in passes]), as_map(vocabulary), size)
    assert one(spark, found) == pytest.approx(want)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Probability: 75%", 0.75), ("probability: 75%", 0.75), ("Probability: 0.75", 0.75), ("Probability is 80%", 0.80), ("Probability of 0.42", 0.42), ("After thinking: 25%", 0.25),
        ("The answer is 50 percent.", 0.50), ("My estimate is 0.33", 0.33), ("Probability: 30%. Wait, on reflection, Probability: 65%.", 0.65), ("the answer is unclear", None), ("Probability: 150%", None),
    ],
)
def test_stated_probabilities(spark, text, want):
    assert one(spark, t.probability(F.lit(text))) == (pytest.approx(want) if want is not None else None)


def test_failed_extraction_reads_half(spark):
    assert one(spark, t.probability_or_half(F.lit("no idea"))) == 0.5
    assert one(spark, t.after_thinking(F.lit("a </think>\n b </think> c"))) == "b </think> c"


#: Fixed value: prompts have to match to the letter.
GOLDEN = """The following data corresponds to a survey respondent. The survey was conducted among US residents in 2018. Please answer the question based on the information provided. The data provided is enough to reach an approximate answer.

Information:
- The age is: 18 years old.
- The class of worker is: Working for a for-profit private company or organization.
- The highest educational attainment is: Some college, less than 1 year.
- The marital status is: Never married.
- The occupation is: Cashiers.
- The place of birth is: Georgia.
- The relationship to the reference person in the survey is: Non-institutionalized group quarters population.
- The usual number of hours worked per week is: 21 hours.
- The sex is: Female.
- The race is: Black or African American.

Question: What is this person's estimated yearly income?
A. Below $50,000.
B. Above $50,000.
Answer:"""


@pytest.fixture(scope="module")
def person(spark):
    row = (1, 18, 1.0, 18.0, 5, "Cashiers", "Georgia", 17, 21.0, 2, 2)
    return spark.createDataFrame([row], "row_id long, AGEP int, COW double, SCHL double, MAR int, OCCP string, POBP string, RELP int, WKHP double, SEX int, RAC1P int")


def test_golden_prompt(person):
    task = TASKS["ACSIncome"]
    assert person.select(Prompts(task).zero_shot(task.multiple_choice)).first()[0] == GOLDEN


def test_missing_and_unknown_values(spark):
    x = spark.createDataFrame([(None,), (999.0,), (1.5,), (float("nan"),), (2.0,)], "x double")
    assert [r[0] for r in x.select(COLUMNS["SEX"].of(F.col("x"))).collect()] == ["N/A", "N/A", "N/A", "N/A", "Female"]
    assert x.select(COLUMNS["ENG"].of(F.col("x"))).first()[0] == "Native (speaks only English)"


def test_low_granularity(person):
    task = TASKS["ACSIncome"]
    text = person.select(Prompts(task, PromptConfig.from_dict({"granularity": "low", "order": "SEX,AGEP"}), {k: v for k, v in LOW.items() if k != "POBP"}).information()).first()[0]
    assert text.startswith("- The sex is: Female.\n- The age is: 18-29 years old.\n- The class of worker is: Employed.")


def test_bins(spark):
    ages = spark.createDataFrame([(x,) for x in (17, 18, 29, 30, 89, 90)], "x int")
    assert [r[0] for r in ages.select(t.age_range(F.col("x"))).collect()] == ["Less than 18 years old", "18-29 years old", "18-29 years old", "30-39 years old", "80-89 years old", "90 or more years old"]


def test_chat_ends_with_the_prefill(spark):
    filled = ChatTemplate().filled(F.lit("hi"), system="s", prefill="My answer is")
    assert one(spark, filled) == "<|system|>s<|end|><|user|>hi<|end|><|assistant|>My answer is"
    assert one(spark, ChatTemplate(takes_system=False).filled(F.lit("hi"), system="s")) == "<|user|>hi<|end|><|assistant|>"
    assert one(spark, ended_at(F.lit("abc"), "x")) is None


def test_configuration():
    with pytest.raises(ValueError):
        PromptConfig.from_dict({"colour": 1})
    assert reordered(["a", "b", "c"], ("c", "x")) == ["c", "a", "b"]
    assert config_hash({"a": 1, "b": 2}) == config_hash({"b": 2, "a": 1})
    assert len(QUESTION.permutations()) == 2
    task = TASKS["ACSIncome"]
    assert isinstance(task.question(thinking=True), Reasoned) and task.question(thinking=True).temperature == 1.0
    assert task.with_features(["SEX", "AGEP"]).features == ("AGEP", "SEX")
    with pytest.raises(ValueError):
        task.with_features(["nothing"])
    with pytest.raises(ValueError):
        TASKS["ACSIncomePovertyRatio"].question(numeric=True)
    assert TASKS["ACSHealthInsurance-test"].features == tuple(sorted(set(TASKS["ACSHealthInsurance-test"].features)))


def test_every_text_states_what_plain_patterns_find(spark, sf):
    """The whole ladder of patterns against Python's, over all texts of the query."""
    import re

    from riskframe.functions.text import PROBABILITY_PATTERNS
    from riskframe.plans.prompt_queries import _texts, cot_extract_full

    def plain(x):
        x = x.split("</think>", 1)[1].strip(" \n\t\r") if "</think>" in x else x
        for pattern, percent in PROBABILITY_PATTERNS:
            if found := re.findall(pattern, x):
                v = float(found[-1])
                v = v / 100 if percent or v > 1 else v
                if 0 <= v <= 1:
                    return v
        return None

    got = {r["event_id"]: r for r in cot_extract_full(spark, sf).collect()}
    texts = _texts(spark, sf).select("event_id", "text").collect()
    assert len(got) == len(texts)
    for r in texts:
        want = plain(r["text"])
        assert got[r["event_id"]]["probability"] == (pytest.approx(want) if want is not None else None)
        assert got[r["event_id"]]["risk_score"] == pytest.approx(0.5 if want is None else want)
