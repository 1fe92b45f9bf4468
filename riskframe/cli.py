"""python -m riskframe.cli: runs a benchmark, or permutation importance, on a table."""

from __future__ import annotations

import argparse
import importlib
import json
import os

from pyspark.sql import DataFrame

from .plans.benchmark import DEFAULT, Benchmark, Config, FewShot


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--model", required=True, help="module:attribute that makes the backend or is a Model, 'hash', or transformers:NAME, vllm:NAME or web:NAME")
    p.add_argument("--results-dir", required=True)
    p.add_argument("--data", required=True, help="Parquet table with row_id, the task's features and its target; with --survey-years a survey's table, as sources.survey writes it")
    p.add_argument("--survey-years", type=lambda x: [int(y) for y in x.split(",")], help="years of the survey, parted by commas")
    p.add_argument("--horizon", default="1-Year")
    p.add_argument("--survey-unit", default="person")
    p.add_argument("--states", type=lambda x: x.split(","), help="letters of states, parted by commas; all if left out")
    p.add_argument("--task", default="ACSIncome")
    p.add_argument("--few-shot", type=int)
    p.add_argument("--compose-few-shot-examples", default="random", help="random, balanced, or counts such as 2,3")
    p.add_argument("--reuse-few-shot-examples", action="store_true")
    p.add_argument("--example-order", type=lambda x: tuple(int(i) for i in x.split(",")))
    p.add_argument("--few-shot-hide-question", action="store_true")
    p.add_argument("--batch-size", type=int, default=16)
    p.add_argument("--context-size", type=int, default=600)
    p.add_argument("--fit-threshold", type=int)
    p.add_argument("--subsampling", type=float)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--temperature", type=float)
    p.add_argument("--dont-correct-order-bias", action="store_true")
    p.add_argument("--numeric-risk-prompting", action="store_true")
    p.add_argument("--cot-prompting", action="store_true")
    p.add_argument("--enable-thinking", action="store_true")
    p.add_argument("--variation", default="", help="key=value pairs, parted by ';'")
    p.add_argument("--use-chat-template", action="store_true")
    p.add_argument("--chat-prompt", default=DEFAULT)
    p.add_argument("--system-prompt", default=DEFAULT)
    p.add_argument("--use-feature-subset", type=lambda x: tuple(x.split(",")))
    p.add_argument("--use-population-filter", default="", help="column=value pairs, parted by commas")
    p.add_argument("--task-population", action="store_true", help="only rows that the task is about")
    p.add_argument("--feature-importance", action="store_true", help="permutation importance in place of the benchmark's metrics")
    p.add_argument("--importance-repeats", type=int, default=5)
    p.add_argument("--answers", default=os.environ.get("RISKFRAME_ANSWERS"), help="folder of stored answers, which are read instead of asking again; RISKFRAME_ANSWERS names one, too")
    return p


def value(text: str):
    """A number or truth value where the text is one."""
    low = text.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("none", "null", ""):
        return None
    for kind in (int, float):
        try:
            return kind(low)
        except ValueError:
            pass
    return text.strip()


def pairs(text: str, between: str) -> dict:
    return {k.strip(): value(v) for k, _, v in (x.partition("=") for x in text.split(between) if x.strip())}


def config(a: argparse.Namespace) -> Config:
    shots = None
    if a.few_shot:
        compose = a.compose_few_shot_examples
        shots = FewShot(a.few_shot, compose if compose in ("random", "balanced") else tuple(int(x) for x in compose.split(",")), a.reuse_few_shot_examples, a.example_order, not a.few_shot_hide_question)
    return Config(
        a.numeric_risk_prompting, a.cot_prompting, a.enable_thinking, shots, a.use_chat_template, a.chat_prompt, a.system_prompt, a.batch_size, a.context_size, not a.dont_correct_order_bias,
        a.use_feature_subset, pairs(a.use_population_filter, ",") or None, a.seed, a.temperature, pairs(a.variation, ";") or None,
    )


def backend(name: str, text: bool = False):
    """text: whether answers are texts, as of reasoning, and not tokens."""
    from .operators.inference import HashBackend

    if name == "hash":
        return HashBackend
    module, _, attribute = name.partition(":")
    if module in ("transformers", "vllm", "web"):
        from .sources.models import open_model

        return open_model(module, attribute, text=text)
    return getattr(importlib.import_module(module), attribute)


def records(a: argparse.Namespace) -> DataFrame:
    """The table, or what is asked of a survey's."""
    from .session import session
    from .sources import survey

    if a.survey_years is None:
        if a.states:
            raise ValueError("--states needs --survey-years")
        return session().read.parquet(a.data)
    return survey.read_table(session(), a.data, a.survey_years, horizon=a.horizon, unit=a.survey_unit, states=a.states)


def main(argv: list[str] | None = None) -> dict:
    from .sources.census import LOW, POPULATIONS, TASKS

    a = parser().parse_args(argv)
    task = TASKS[a.task]
    low = {k: v for k, v in LOW.items() if k in task.features}
    b = Benchmark(task, records(a), backend(a.model, a.cot_prompting or a.enable_thinking), config(a), a.model.replace(":", "."), low, population=POPULATIONS[a.task] if a.task_population else None, answers=a.answers)
    if a.feature_importance:
        found = b.importance(a.results_dir, repeats=a.importance_repeats, subsampling=a.subsampling)
        print(json.dumps(found))
        return {"importance": found}
    record = b.run(a.results_dir, fit_threshold=a.fit_threshold, subsampling=a.subsampling)
    print(json.dumps(record, default=str))
    return record


if __name__ == "__main__":
    main()
