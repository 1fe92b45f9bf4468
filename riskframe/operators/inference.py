"""Scoring by a model: one Arrow function, whatever the backend; what comes before and after it is Spark's own."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clip01
from ..functions.text import reconciled, stated_probability
from . import decode
from .task import MultipleChoice, Numeric, Question, Reasoned

#: Rows that a backend gets at once.
BATCH = 16


class Backend(Protocol):
    """Is built once a task, on the executor."""

    def __call__(self, prompts: list[str]) -> list[float]: ...


def scored(df: DataFrame, make_backend: Callable[[], Backend], *, prompt: str = "prompt", into: str = "risk_score", batch: int = BATCH, per_minute: float | None = None) -> DataFrame:
    """Adds the backend's score of each prompt, null where it gives none. per_minute: the most prompts a minute of each task; divide a total by the tasks that run at once."""
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        for frame in frames:
            out: list[float] = []
            for a in range(0, len(frame), batch):
                prompts = frame[prompt].iloc[a : a + batch].tolist()
                out += backend(prompts)
                if per_minute:
                    time.sleep(60 * len(prompts) / per_minute)
            frame[into] = pd.Series(out, index=frame.index, dtype="float64")
            yield frame[[*names, into]]

    return df.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{into}` double"]))


@dataclass(frozen=True)
class Settings:
    """What a model is asked for: so many tokens, each with its likeliest alternatives, or a text; digits_only: numbers are all that counts."""

    passes: int = 1
    temperature: float = 0.0
    context_size: int = 600
    seed: int = 42
    digits_only: bool = False
    most_tokens: int = 8000


def settings_of(question: Question, *, temperature: float | None = None, context_size: int = 600, seed: int = 42) -> Settings:
    """A temperature that is given counts; else thinking models sample, and all others don't."""
    own = question.temperature if isinstance(question, Reasoned) else 0.0
    most = question.most_tokens if isinstance(question, Reasoned) else question.passes
    return Settings(question.passes, own if temperature is None else temperature, context_size, seed, isinstance(question, Numeric), most)


@dataclass(frozen=True)
class Model:
    """make(settings) is called once a task, on the executor, and returns a function of a list of prompts. What that gives for each, or None:

    tokens: a map from token id to probability for each pass; vocabulary (of the tokenizer) and size (of the model's output) say what ids mean.
    words: (text, a map from token to probability for each pass), as web services do.
    text: what was generated.
    """

    make: Callable[[Settings], Callable[[list[str]], list]]
    gives: str = "tokens"
    vocabulary: dict[str, int] | None = None
    size: int | None = None
    per_minute: float | None = None

    def __post_init__(self) -> None:
        if self.gives not in KINDS:
            raise ValueError(f"a model gives one of {sorted(KINDS)}")
        if self.gives == "tokens" and (self.vocabulary is None or self.size is None):
            raise ValueError("token ids need a vocabulary and the size of the output")


#: What comes back from the executors, by kind.
KINDS = {
    "tokens": ("array<map<bigint,double>>", pa.list_(pa.map_(pa.int64(), pa.float64()))),
    "words": ("struct<text:string,passes:array<map<string,double>>>", pa.struct([("text", pa.string()), ("passes", pa.list_(pa.map_(pa.string(), pa.float64())))])),
    "text": ("string", pa.string()),
}


class Priced(NamedTuple):
    """An answer and what it cost."""

    answer: object
    cost: float | None


def _plain(gives: str, answer):
    """As Arrow takes it: maps as lists of pairs."""
    if answer is None or gives == "text":
        return answer
    if gives == "tokens":
        return [list(p.items()) for p in answer]
    return {"text": answer[0], "passes": [list(p.items()) for p in answer[1] or ()]}


def answered(df: DataFrame, model: Model, settings: Settings, *, prompt: str = "prompt", into: str = "answer", batch: int = BATCH) -> DataFrame:
    """Adds what the model gives for each prompt, null where it gives nothing, and its cost, null if it names none. per_minute of the model holds for each task: divide a total
    by the tasks that run at once."""
    gives, make, pause = model.gives, model.make, 60 / model.per_minute if model.per_minute else 0.0
    sql, kind = KINDS[gives]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = make(settings)
        for rows in batches:
            prompts, out, costs = rows[prompt].to_pylist(), [], []
            for a in range(0, len(prompts), batch):
                some = prompts[a : a + batch]
                found = list(ask(some))
                if len(found) != len(some):
                    raise ValueError(f"{len(found)} answers to {len(some)} prompts")
                costs += [x.cost if isinstance(x, Priced) else None for x in found]
                out += [_plain(gives, x.answer if isinstance(x, Priced) else x) for x in found]
                if pause:
                    time.sleep(pause * len(some))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, kind), pa.array(costs, pa.float64())], [*rows.schema.names, into, "cost"])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{into}` {sql}", "cost double"]))


def useful_tokens(vocabulary: dict[str, int], size: int) -> dict[str, int]:
    """Tokens that decoding can ask for: digits, the point, and answer keys with what may stand before them."""
    key = re.compile(f"(?:{'|'.join(map(re.escape, decode.PREFIXES))})[A-Z]")
    return {t: i for t, i in vocabulary.items() if 0 <= i < size and (re.fullmatch("[0-9]+|[.]", t) or key.fullmatch(t))}


def risk(answer: Column, model: Model, question: Question) -> Column:
    """The score that an answer stands for; null without an answer. A text that states no probability counts as one half."""
    if isinstance(question, Reasoned):
        said = answer["text"] if model.gives == "words" else answer
        if model.gives == "tokens":
            raise ValueError("reasoning needs a model that gives text")
        return F.when(said.isNotNull(), F.coalesce(decode.reasoned(said, question.thinking), F.lit(0.5)))
    if model.gives == "text":
        return clip01(stated_probability(F.ltrim(answer))) if isinstance(question, Numeric) else F.when(question.key_in(answer).isNotNull(), question.number_of(question.key_in(answer)))
    clipped = lambda score: F.when(answer.isNotNull(), decode.let(score, clip01))
    if model.gives == "tokens":
        useful = useful_tokens(model.vocabulary, model.size)
        if isinstance(question, MultipleChoice):
            known = F.from_json(F.lit(json.dumps(useful)), "map<string,bigint>")
            return clipped(_decoded(answer, known, F.lit(model.size).cast("bigint"), question))
        # Known before any row is read: searched for once, not in each row.
        numbers = sorted((i, t) for t, i in useful.items() if re.fullmatch("[0-9]+|[.]", t))
        entries = F.from_json(F.lit(json.dumps([{"i": i, "t": t} for i, t in numbers])), "array<struct<i:bigint,t:string>>")
        return clipped(decode.numeric_of(answer, entries))

    def of_words(words: Column) -> Column:
        """Words stand for themselves: ids are their places among all words of the answer."""
        known = F.map_from_arrays(words, F.transform(words, lambda _, i: i.cast("bigint")))
        passes = F.transform(answer["passes"], lambda m: F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct((F.array_position(words, e["key"]) - 1).alias("key"), e["value"].alias("value")))))
        return _decoded(passes, known, F.size(words).cast("bigint"), question)

    score = decode.let(decode.synthetic_vocabulary(answer["passes"]), of_words)
    if not isinstance(question, MultipleChoice):
        stated = decode.let(F.ltrim(answer["text"]), stated_probability)
        score = decode.let(F.struct(score.alias("decoded"), stated.alias("stated")), lambda x: reconciled(x["decoded"], x["stated"]))
    return clipped(score)


def _decoded(passes: Column, known: Column, size: Column, question: Question) -> Column:
    if isinstance(question, MultipleChoice):
        return decode.let(decode.in_range(F.get(passes, F.lit(0)), size), lambda tokens: decode.multiple_choice(tokens, known, question))
    return decode.numeric(passes, known, size)


class HashBackend:
    """A stand-in for a model: a number between 0 and 1 made from the prompt's MD5."""

    def __call__(self, prompts: list[str]) -> list[float]:
        import hashlib

        return [int(hashlib.md5(p.encode()).hexdigest()[:8], 16) % 10000 / 10000 for p in prompts]


def in_each_order(df: DataFrame, question: MultipleChoice, prompt_of) -> DataFrame:
    """A row for each order of the choices, with its prompt. prompt_of: question to Column."""
    prompts = [F.struct(F.lit(i).alias("order_id"), prompt_of(q).alias("prompt")) for i, q in enumerate(question.permutations())]
    return df.withColumn("_o", F.explode(F.array(*prompts))).select("*", "_o.*").drop("_o")


def averaged(df: DataFrame, row_id: str = "row_id", *by: str, score: str = "risk_score") -> DataFrame:
    """The mean over orders of the clipped scores of each row; null where an order has none."""
    own = clip01(F.col(score))
    return df.groupBy(row_id, *by).agg(F.when(F.count(own) == F.count(F.lit(1)), F.avg(own)).alias(score))


def truncated(df: DataFrame, prompt: str = "prompt", words: int = 600) -> DataFrame:
    """Prompts keep their last words: the question stands at the end."""
    w = F.split(F.col(prompt), " ")
    return df.withColumn(prompt, F.when(F.size(w) > words, F.array_join(F.slice(w, F.size(w) - words + 1, words), " ")).otherwise(F.col(prompt)))


def failure_rate(df: DataFrame, extracted: str) -> DataFrame:
    """n, n_failed, failure_rate, and warned: a quarter or more of at least 20 failed."""
    n, bad = F.count(F.lit(1)), F.count_if(F.col(extracted).isNull())
    return df.agg(n.alias("n"), bad.alias("n_failed"), F.try_divide(bad, n).alias("failure_rate"), ((n >= 20) & (bad >= 0.25 * n)).alias("warned"))
