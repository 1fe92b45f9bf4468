"""Model adapters on scripted stand-ins for their libraries, and what the benchmark does with their answers."""

from __future__ import annotations

import math
from contextlib import nullcontext
from types import SimpleNamespace as Some

import pytest
from pyspark.sql import functions as F

from riskframe.operators import inference, metrics
from riskframe.operators.inference import Model, Settings
from riskframe.operators.task import MultipleChoice, Numeric, Reasoned
from riskframe.plans.benchmark import Benchmark, Config, FewShot
from riskframe.sources import models

from .test_benchmark import TASK


class Vector(list):
    def float(self):
        return self

    def argmax(self):
        return max(range(len(self)), key=lambda i: (self[i], -i))


class FakeTorch:
    def __init__(self):
        self.seeds = []

    tensor = staticmethod(lambda x: x)
    no_grad = staticmethod(nullcontext)

    def manual_seed(self, seed):
        self.seeds.append(seed)

    @staticmethod
    def softmax(x, _):
        top = max(x)
        e = [math.exp(v - top) for v in x]
        return Vector(v / sum(e) for v in e)


class FakeTokenizer:
    words = {str(i): i for i in range(10)} | {".": 10, " A": 11, " B": 12, "z": 13}

    def get_vocab(self):
        return self.words

    def encode(self, text):
        return [ord(c) % 10 for c in text]

    def decode(self, ids, skip_special_tokens):
        return "".join(map(str, ids))


class FakeModel:
    """The next token is likely the number of tokens so far, or z, which is no answer; far more tokens than that are likelier than an answer's key."""

    def __init__(self):
        self.asked, self.how = [], None

    def __call__(self, ids, attention_mask):
        self.asked.append([sum(m) for m in attention_mask])
        assert all(len(r) == len(m) == len(ids[0]) and set(r[sum(m) :]) <= {0} for r, m in zip(ids, attention_mask))
        return Some(logits={(i, at): Vector([5.0 if t == (at + 1) % 10 else 9.0 if t == 13 else 2.0 if t > 13 else 0.0 for t in range(214)]) for i, r in enumerate(ids) for at in range(len(r))})

    def generate(self, ids, **how):
        self.how = how
        return [[*ids[0], 7, 5]]


def test_transformers_passes_and_text():
    model, torch = FakeModel(), FakeTorch()
    parts = {"model": model, "tokenizer": FakeTokenizer(), "torch": torch}
    (first, second), other = models.Transformers(Settings(2, context_size=4, digits_only=True), **parts)(["abcdefgh", "xy"])
    assert max(first, key=first.get) == 4 and max(second, key=second.get) == 5 and set(first) == set(range(10))  # digits, and not the point
    assert max(other[0], key=other[0].get) == 2 and max(other[1], key=other[1].get) == 3
    assert model.asked == [[4, 2], [5, 3]]  # both prompts at once
    free = models.Transformers(Settings(1), **parts)(["abc"])[0][0]
    whole = FakeTorch.softmax(model([[1, 2, 3]], [[1, 1, 1]]).logits[0, 2], -1)
    assert free == {i: pytest.approx(whole[i]) for i in range(13)}  # keys behind 200 likelier tokens have their share of the whole
    assert models.Transformers(Settings(temperature=0.0, most_tokens=9), text=True, **parts)(["ab"]) == ["75"] and model.how == {"max_new_tokens": 9, "do_sample": False}
    models.Transformers(Settings(temperature=1.0, seed=3), text=True, **parts)(["ab"])
    assert model.how["temperature"] == 1.0 and torch.seeds[-1] == 3


def test_vllm_token_maps_and_text():
    class Engine:
        def generate(self, prompts, parameters):
            self.parameters = parameters
            one = Some(text="Probability: 30%", logprobs=[{1: Some(logprob=math.log(0.25)), 2: Some(logprob=math.log(0.75))}])
            self.prompts = prompts
            return [Some(outputs=[one]) for _ in prompts]

        def get_tokenizer(self):
            return Some(encode=lambda t: [ord(c) for c in t], decode=lambda ids, skip_special_tokens: "".join(map(chr, ids)))

    engine = Engine()
    models.Vllm(Settings(1, context_size=3), engine=engine, sampling=dict)(["abcdef", "xy"])
    assert engine.prompts == ["def", "xy"]
    found = models.Vllm(Settings(1, 0.5, seed=9), engine=engine, sampling=dict)(["a", "b"])
    assert found[0] == [{1: pytest.approx(0.25), 2: pytest.approx(0.75)}] and len(found) == 2
    assert engine.parameters == {"temperature": 0.5, "seed": 9, "max_tokens": 1, "logprobs": models.TOP}
    assert models.Vllm(Settings(most_tokens=50), text=True, engine=engine, sampling=dict)(["a"]) == ["Probability: 30%"] and engine.parameters["max_tokens"] == 50
    assert models.per_pass(None) is None and models.per_pass([]) is None


def answer(text, *positions):
    content = [Some(top_logprobs=[Some(token=t, logprob=math.log(p)) for t, p in x.items()]) for x in positions]
    return Some(choices=[Some(message=Some(content=text), logprobs=Some(content=content) if positions else None)], _hidden_params={"response_cost": 0.25})


def test_web_parameters_costs_and_failures():
    calls = []

    def completion(**parameters):
        calls.append(parameters)
        return answer("B", {"A": 0.25, "B": 0.75})

    web = models.Web(Settings(1, 0.0), name="m", completion=completion, supported=lambda _: ["max_tokens", "logprobs", "top_logprobs"])
    (text, passes), cost = web(["x", "y"])[1]
    assert text == "B" and passes == [{"A": pytest.approx(0.25), "B": pytest.approx(0.75)}] and cost == 0.25
    assert set(calls[0]) == {"model", "messages", "max_tokens", "logprobs", "top_logprobs"}
    with pytest.raises(ValueError):
        models.Web(Settings(), name="m", completion=completion, supported=lambda _: ["max_tokens"])
    with pytest.raises(ValueError):
        models.Web(Settings(), name="m", completion=lambda **_: answer("B"))(["x"])
    assert models.Web(Settings(), name="m", text=True, completion=lambda **_: answer("so"))(["x"]) == [("so", 0.25)]


def test_backends_are_told_apart():
    assert models.resolved("gpt") == "web" and models.resolved(FakeModel()) == "transformers"
    assert models.resolved(type("E", (), {"generate": 1, "get_tokenizer": 1})()) == "vllm"
    given = models.open_model("", FakeModel(), tokenizer=FakeTokenizer()).make
    assert given.args[0] == "transformers" and set(given.args[3]) == {"model"}
    m = models.open_model("transformers", "n", tokenizer=FakeTokenizer())
    assert (m.gives, m.size) == ("tokens", 14) and models.open_model("web", "n", tasks=10).per_minute == 500 and models.open_model("vllm", "n", text=True).gives == "text"
    with pytest.raises(ValueError):
        models.open_model("other", "n")
    with pytest.raises(ValueError):
        Model(None, "tokens")


def test_settings_follow_the_question():
    reasoned = Reasoned("y", "How likely?")
    assert inference.settings_of(reasoned).temperature == 0 and inference.settings_of(Reasoned("y", "?", True)).temperature == 1
    assert inference.settings_of(Reasoned("y", "?", True), temperature=0.3).temperature == 0.3
    assert inference.settings_of(Numeric("y", "?")).digits_only and inference.settings_of(TASK.multiple_choice).passes == 1


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 9).alias("a"), (F.col("id") % 2).cast("int").alias("b"), (F.col("id") % 7).alias("y"))


class Gone:
    """Gives nothing for some prompts."""

    def __init__(self, settings):
        pass

    def __call__(self, prompts):
        return [None if "size is: 3" in p else [{1: 0.2, 2: 0.6}] for p in prompts]


class Heated:
    def __init__(self, settings):
        self.t = settings.temperature

    def __call__(self, prompts):
        return [f"Probability: {self.t}" for _ in prompts]


def test_missing_answers_stay_missing(data, tmp_path):
    b = Benchmark(TASK, data, Model(Gone, "tokens", {" A": 1, " B": 2}, 10))
    rows = b.scored(b.data).join(data, "row_id").collect()
    assert all((r["risk_score"] is None) == (r["a"] == 3) for r in rows) and {r["risk_score"] and round(r["risk_score"], 9) for r in rows} == {None, 0.5}
    with pytest.raises(ValueError, match="no score"):
        b.run(test=0.3)


def test_temperature_reaches_the_model(data):
    for given, want in ((0.25, 0.25), (None, 0.0)):
        b = Benchmark(TASK, data, Model(Heated, "text"), Config(cot_prompting=True, temperature=given))
        assert {r["risk_score"] for r in b.scored(b.data).collect()} == {want}


def test_all_splits_and_importance(data, tmp_path):
    class Size:
        def __call__(self, prompts):
            return [0.1 * int(p.split("size is: ")[1][0]) for p in prompts]

    b = Benchmark(TASK, data, Size, Config(correct_order_bias=False), population="a < 8")
    assert {r["split"]: r["count"] for r in b.scored_splits(0.2, 0.2).groupBy("split").count().collect()} == {"train": 32, "test": 10, "val": 12} or b.scored_splits(0.2, 0.2).count() == b.data.count()
    found = b.importance(str(tmp_path), repeats=2, test=0.5)
    assert [f["feature"] for f in found if f["imp_mean"] == 0] == ["b"] and {f["feature"] for f in found} == {"a", "b"}


def test_fresh_examples_differ_by_row_and_keep_their_counts(data):
    class Nothing:
        def __call__(self, prompts):
            return [0.5] * len(prompts)

    b = Benchmark(TASK, data, Nothing, Config(few_shot=FewShot(4, (3, 1)), correct_order_bias=False, context_size=10_000))
    prompts = [r["prompt"] for r in b.prompts(b.data, b.data).collect()]
    assert len(prompts) == 60 and len(set(prompts)) > 40
    assert all(p.count("Answer: A") == 3 and p.count("Answer: B") == 1 for p in prompts)
    same = Benchmark(TASK, data, Nothing, Config(few_shot=FewShot(4, (3, 1), reuse_examples=True), correct_order_bias=False, context_size=10_000))
    heads = {r["prompt"].rsplit("Information:", 1)[0] for r in same.prompts(same.data, same.data).collect()}
    assert len(heads) == 1


def test_null_scores_count_in_no_metric(spark):
    rows = spark.createDataFrame([(0, None), (1, 0.5), (1, float("nan"))], "label int, risk_score double")
    r = metrics.evaluate(rows).first()
    assert (r["n_unscored"], r["n_samples"], r["tp"]) == (2, 1, 1) and r["log_loss"] == pytest.approx(math.log(2))


def test_written_answers(spark):
    q = MultipleChoice("y", "?", TASK.multiple_choice.choices)
    rows = spark.createDataFrame([(1, " b) yes"), (2, "Because"), (3, None), (4, "A")], "row_id int, answer string")
    got = {r[0]: r[1] for r in rows.select("row_id", inference.risk(F.col("answer"), Model(Heated, "text"), q)).collect()}
    assert got == {1: 1.0, 2: None, 3: None, 4: 0.0}
