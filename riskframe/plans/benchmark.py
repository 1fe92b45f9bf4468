"""A benchmark from rows to results: prompts, scores, metrics, files."""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dataset, inference, metrics
from ..operators.prompt import ChatTemplate, PromptConfig, Prompts
from ..operators.task import MultipleChoice, Question, Task, config_hash
from ..sources.answers import AnswerStore
from ..sources.shared import shared_folder
from ..sources.tables import load_json, save_json, save_results

DEFAULT = "default"
#: By kind of question, what the system says, and what the answer begins with.
CHAT_SYSTEM = {
    "choice": "You are a helpful assistant. You answer multiple-choice questions based on the information provided. Respond with a single answer choice.\n",
    "number": "You are a helpful assistant. You provide numeric probability estimates based on the information provided.\n",
}
CHAT_PREFILL = {"choice": "If had to select one of the options, my answer would be", "number": "Answer (between 0 and 1): 0."}


@dataclass(frozen=True)
class FewShot:
    n_shots: int
    compose: str | tuple[int, ...] = "random"
    reuse_examples: bool = False
    example_order: tuple[int, ...] | None = None
    show_question_in_examples: bool = True

    def __post_init__(self) -> None:
        if self.example_order is not None and sorted(self.example_order) != list(range(self.n_shots)):
            raise ValueError("example_order must be an order of all examples")
        if not isinstance(self.compose, str) and sum(self.compose) != self.n_shots:
            raise ValueError("counts by label must sum up to n_shots")


@dataclass(frozen=True)
class Config:
    numeric_risk_prompting: bool = False
    cot_prompting: bool = False
    enable_thinking: bool = False
    few_shot: FewShot | None = None
    use_chat_template: bool = False
    chat_prompt: str | None = DEFAULT
    system_prompt: str | None = DEFAULT
    batch_size: int = inference.BATCH
    context_size: int = 600
    correct_order_bias: bool = True
    feature_subset: tuple[str, ...] | None = None
    population_filter: dict | None = None
    seed: int = 42
    temperature: float | None = None
    prompt_variation: dict | None = None

    def __post_init__(self) -> None:
        if self.few_shot and self.use_chat_template:
            raise ValueError("few-shot prompts and chat templates don't go together")
        if self.use_chat_template and (self.cot_prompting or self.enable_thinking):
            raise ValueError("reasoning applies the chat template itself")
        if not self.use_chat_template and any(x not in (None, DEFAULT) for x in (self.chat_prompt, self.system_prompt)):
            warnings.warn("system_prompt and chat_prompt count only with use_chat_template", stacklevel=3)

    def changed(self, **changes) -> Config:
        if unknown := sorted(set(changes) - {f.name for f in fields(self)}):
            raise ValueError(f"unknown settings: {unknown}")
        return replace(self, **changes)

    def hash(self) -> str:
        return config_hash(asdict(self))

    def save(self, path: str) -> None:
        save_json(asdict(self), path)

    @classmethod
    def load(cls, path: str) -> Config:
        """Also of older files: n_shots, balance and reuse at the top level become few_shot; unknown settings are ignored."""
        d = load_json(path)
        shots, balance, reuse = d.pop("few_shot", None), d.pop("balance_few_shot_examples", False), d.pop("reuse_few_shot_examples", False)
        if isinstance(shots, int):
            shots = {"n_shots": shots, "compose": "balanced" if balance else "random", "reuse_examples": reuse} if shots else None
        if shots:
            tuples = {k: tuple(v) for k, v in shots.items() if isinstance(v, list)}
            shots = FewShot(**(shots | tuples))
        known = {f.name for f in fields(cls)}
        if d.get("feature_subset"):
            d["feature_subset"] = tuple(d["feature_subset"])
        return cls(few_shot=shots, **{k: v for k, v in d.items() if k in known})


@dataclass
class Benchmark:
    """task and data; make_backend is a Model, whose answers are decoded, or a function that builds what gives scores of prompts on each executor.

    answers: a folder for what models answer, by prompt, model_name and settings, which later runs and other benchmarks read instead of asking again.

    population: a condition that rows of the task meet, applied before the split; such as those of POPULATIONS.
    """

    task: Task
    data: DataFrame
    make_backend: Callable[[], inference.Backend] | inference.Model
    config: Config = Config()
    model_name: str = "model"
    low: dict | None = None
    template: ChatTemplate = ChatTemplate()
    population: str | None = None
    answers: str | None = None
    _own_store: bool = False

    def __post_init__(self) -> None:
        if self.population:
            self.data = self.data.where(self.population)
        if self.config.feature_subset:
            self.task = self.task.with_features(list(self.config.feature_subset))
        dataset.require(self.data, self.task.required)
        if self.task.threshold:
            self.data = self.task.threshold.add(self.data, self.task.target)

    def question(self) -> Question:
        c = self.config
        return self.task.question(reasoned=c.cot_prompting, thinking=c.enable_thinking, numeric=c.numeric_risk_prompting)

    def split(self, test: float = 0.1, val: float = 0.1) -> DataFrame:
        """The split depends on ids and the seed alone; filters come after it, so they never move a row to another split."""
        rows = dataset.split(self.data, test=test, val=val, seed=self.config.seed)
        return dataset.filtered(rows, self.config.population_filter) if self.config.population_filter else rows

    def examples(self, train: DataFrame, draw: int = 0) -> DataFrame:
        from pyspark.sql import Window

        from ..functions.numbers import hash_key

        shots, label = self.config.few_shot, f"`{self.task.target_column}`"
        draw = 0 if shots.reuse_examples else draw
        if shots.compose == "random":
            rows = dataset.sample(train, shots.n_shots, seed=self.config.seed, draw=draw)
        else:
            rows = dataset.stratified(train.withColumn("_label", F.col(label)), self.counts(), "_label", seed=self.config.seed).drop("_label")
        # A handful of rows.
        return rows.withColumn("shot", F.row_number().over(Window.orderBy(hash_key("row_id", self.config.seed, draw), "row_id")))

    def prompts(self, rows: DataFrame, train: DataFrame | None = None) -> DataFrame:
        """row_id, order_id and prompt: one row for each order of the choices if order bias is corrected."""
        c, q = self.config, self.question()
        # Texts are many times as large as the rows of a narrow table, of which a task may read a great many; tasks are dealt rows before these become texts.
        rows = rows.repartition("row_id")
        build = Prompts(self.task, PromptConfig.from_dict(c.prompt_variation or {}), self.low)
        if c.few_shot:
            shots = {"order": c.few_shot.example_order, "show_question": c.few_shot.show_question_in_examples}
            if c.few_shot.reuse_examples:
                examples = self.examples(train)
                ask = lambda x: build.few_shot(rows, examples, x, **shots)
            else:
                ask = lambda x: build.few_shot_each(rows, train, x, shots=c.few_shot.n_shots, counts=self.counts(), seed=c.seed, **shots)
            parts = [ask(x).select("row_id", F.lit(i).alias("order_id"), "prompt") for i, x in enumerate(self.asked())]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return inference.truncated(out, words=c.context_size)

        def one(x: Question):
            if not c.use_chat_template:
                return build.zero_shot(x)
            kind = "choice" if isinstance(x, MultipleChoice) else "number"
            return build.chat(x, system=CHAT_SYSTEM[kind] if c.system_prompt == DEFAULT else c.system_prompt, prefill=CHAT_PREFILL[kind] if c.chat_prompt == DEFAULT else c.chat_prompt, template=self.template)

        if isinstance(q, MultipleChoice) and c.correct_order_bias:
            out = inference.in_each_order(rows, q, one)
        else:
            out = rows.withColumn("order_id", F.lit(0)).withColumn("prompt", one(q))
        return inference.truncated(out.select("row_id", "order_id", "prompt"), words=c.context_size)

    def asked(self) -> list[Question]:
        """The question, in each order of its choices if order bias is corrected."""
        q = self.question()
        return q.permutations() if self.config.correct_order_bias and isinstance(q, MultipleChoice) else [q]

    def counts(self) -> dict[int, int] | None:
        """Few-shot examples of each label; None if any will do."""
        shots = self.config.few_shot
        if shots.compose == "random":
            return None
        return dataset.balanced_counts([0, 1], shots.n_shots) if shots.compose == "balanced" else dict(zip([0, 1], shots.compose))

    def scored(self, rows: DataFrame, train: DataFrame | None = None) -> DataFrame:
        """row_id and risk_score, the mean over orders; null where the model gave none. The model is asked at once, about each prompt that the store has no answer to;
        the result is a table beside the answers, however often it is read."""
        return self.ask(self.prompts(rows, train))

    def ask(self, prompts: DataFrame, *by: str) -> DataFrame:
        """As scored(), of prompts(): one row for each row_id and `by`."""
        c, asked, model = self.config, self.asked(), self.make_backend
        if not isinstance(model, inference.Model):
            answers = self.store().answered(prompts, model, model_name=self.model_name, batch=c.batch_size)
            return self.store().kept(inference.averaged(answers.withColumn("risk_score", F.col("answer")), "row_id", *by))
        settings = inference.settings_of(asked[0], temperature=c.temperature, context_size=c.context_size, seed=c.seed)
        answers = self.store().answered(prompts, model, model_name=self.model_name, settings=settings, batch=c.batch_size)
        score = F.lit(None).cast("double")
        for i, q in enumerate(asked):
            score = F.when(F.col("order_id") == i, inference.risk(F.col("answer"), model, q)).otherwise(score)
        return self.store().kept(inference.averaged(answers.withColumn("risk_score", score), "row_id", *by))

    def store(self) -> AnswerStore:
        """That of `answers`; without it a new one in the shared folder, which is this benchmark's alone."""
        if self.answers is None:
            self.answers, self._own_store = f"{shared_folder(self.data.sparkSession)}/answers-{uuid.uuid4().hex[:12]}", True
        return AnswerStore(self.answers)

    def close(self) -> None:
        """Deletes a store that wasn't asked for; what scored() gave can't be read any more."""
        if self._own_store:
            self.store().remove(self.data.sparkSession)
            self.answers, self._own_store = None, False

    def scored_splits(self, test: float = 0.1, val: float = 0.1) -> DataFrame:
        """row_id, split and risk_score of all rows, in one pass."""
        rows = self.split(test, val)
        return self.scored(rows, rows.where("split = 'train'")).join(rows.select("row_id", "split"), "row_id")

    def labelled(self, rows: DataFrame, train: DataFrame | None = None) -> DataFrame:
        own = rows.select("row_id", F.col(f"`{self.task.target_column}`").alias("label"), *([F.col(self.task.sensitive).alias("group")] if self.task.sensitive and self.task.sensitive in rows.columns else []))
        return self.scored(rows, train).join(own, "row_id")

    def fit_threshold(self, train: DataFrame, n: int) -> float:
        """The best threshold on n training rows."""
        return metrics.best_threshold(self.labelled(dataset.sample(train, n, seed=self.config.seed), train)).first()["threshold"]

    def run(self, results_dir: str | None = None, *, fit_threshold: int | None = None, test: float = 0.1, val: float = 0.1, subsampling: float | None = None, predictions: str | None = None) -> dict:
        """Scores the test split and evaluates it; writes results and predictions where asked to. Raises if a row has no score.

        Answers are written before they are read: neither a lost executor nor another metric asks the model again. cost: what the store's answers cost, as far as known.
        """
        rows = self.split(test, val)
        rows = dataset.subsample(rows, subsampling) if subsampling else rows
        train, tested = rows.where("split = 'train'"), rows.where("split = 'test'")
        threshold = self.fit_threshold(train, fit_threshold) if fit_threshold else 0.5
        scored = self.labelled(tested, train)
        if predictions:
            scored.write.mode("overwrite").parquet(predictions)
            scored = scored.sparkSession.read.parquet(predictions)
        if unscored := scored.where("risk_score IS NULL").count():
            raise ValueError(f"{unscored} rows have no score; answers that there are, are in {self.answers}")
        record = metrics.evaluate(scored, threshold=threshold, group="group" if "group" in scored.columns else None).first().asDict()
        totals = self.store().totals(scored.sparkSession)
        record |= {"cost": totals["cost"], "n_answers": totals["n_answers"], "model_name": self.model_name, "task": self.task.name, "threshold_fitted_on": fit_threshold or 0, "config": json.loads(json.dumps(asdict(self.config), default=str)) | {"hash": self.config.hash()}}
        if results_dir:
            record["path"] = save_results(record, results_dir, self.model_name, self.config.hash())
        self.close()
        return record

    def importance(self, results_dir: str | None = None, *, repeats: int = 5, test: float = 0.1, val: float = 0.1, subsampling: float | None = None) -> list[dict]:
        """feature, imp_mean and imp_std, the most important first: what the AUC on the test split loses when a feature's values are dealt anew over its rows. The model is
        asked at most 1 + repeats * features times about each row: once about each prompt, whatever rows and repeats it comes up in."""
        rows = self.split(test, val)
        rows = dataset.subsample(rows, subsampling) if subsampling else rows
        train, tested = rows.where("split = 'train'"), rows.where("split = 'test'")
        label = tested.select("row_id", F.col(f"`{self.task.target_column}`").alias("label"))
        variants = metrics.shuffled_features(tested, list(self.task.features), repeats=repeats, seed=self.config.seed)
        scored = self.ask(metrics.tagged({k: self.prompts(moved, train) for k, moved in variants.items()}), "_feature", "_repeat")
        out = metrics.lost_auc(scored.join(label, "row_id"))
        found = [r.asDict() for r in out.orderBy(F.desc("imp_mean"), "feature").collect()]
        if results_dir:
            save_json({"model_name": self.model_name, "task": self.task.name, "repeats": repeats, "importance": found}, f"{results_dir}/importance.{self.config.hash()}.json")
        self.close()
        return found
