"""Prompts: a configuration becomes one Column; what doesn't depend on the row is a literal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import hash_key, hash_long
from ..functions.text import connected, laid_out
from .positions import with_position
from .task import Question, Task
from .valuemap import ColumnToText

#: What precedes the information, and its words for one respondent and for several.
DESCRIPTION = "The following data corresponds to {respondent}. The survey was conducted among US residents in {year}. Please answer {question} based on the information provided. The data provided is enough to reach an approximate answer{suffix}.\n"
ONE = {"respondent": "a survey respondent", "year": 2018, "question": "the question", "suffix": ""}
SEVERAL = {"respondent": "different survey respondents", "year": 2018, "question": "each question", "suffix": " for each person"}


@dataclass(frozen=True)
class PromptConfig:
    format: str = "textbullet"
    connector: str = "is:"
    granularity: str = "original"
    order: tuple[str, ...] | None = None
    custom_prompt_prefix: str | None = None
    custom_prompt_suffix: str | None = None
    show_question: bool = True

    @classmethod
    def from_dict(cls, changes: dict) -> PromptConfig:
        if unknown := sorted(set(changes) - set(cls.__dataclass_fields__)):
            raise ValueError(f"unknown prompt settings: {unknown}")
        order = changes.get("order")
        if isinstance(order, str):
            changes = changes | {"order": tuple(x.strip() for x in order.split(","))}
        if changes.get("granularity", "original") not in ("original", "low"):
            raise ValueError("granularity is original or low")
        return cls(**changes)


def described(task: Task, several: bool = False) -> str | None:
    if "ACS" in task.name:
        return DESCRIPTION.format(**(SEVERAL if several else ONE))
    return None if several else task.description


def reordered(columns: list[str], order: tuple[str, ...] | None) -> list[str]:
    """Those named first, in that order, then all others as they were."""
    if not order:
        return columns
    return [c for c in order if c in columns] + [c for c in columns if c not in order]


class Prompts:
    """Renders rows of a task. low: coarser value maps by column."""

    def __init__(self, task: Task, config: PromptConfig = PromptConfig(), low: dict[str, Callable[[Column], Column] | dict] | None = None):
        self.task, self.config, self.low = task, config, low or {}

    def _column(self, name: str) -> ColumnToText:
        own = self.task.columns[name]
        return replace(own, values=self.low[name]) if self.config.granularity == "low" and name in self.low else own

    def information(self) -> Column:
        names = reordered(list(self.task.features), self.config.order)
        items = [connected(self._column(n).label, self.config.connector, self._column(n).of(F.col(f"`{n}`"))) for n in names]
        return laid_out(items, self.config.format)

    def prefix(self, description: str | None) -> str:
        own = self.config.custom_prompt_prefix or ""
        text = (description or "") + (own + "\n" if own and not own.endswith("\n") else own)
        return text + ("\n" if text else "") + "Information:\n"

    def suffix(self, question: Question, prefill: bool = True, show_question: bool | None = None) -> str:
        show = self.config.show_question if show_question is None else show_question
        return "\n" + (question.prompt(prefill) if show else question.prefix())

    def zero_shot(self, question: Question, description: str | None = "default", prefill: bool = True) -> Column:
        text = described(self.task) if description == "default" else description
        return F.concat(F.lit(self.prefix(text)), self.information(), F.lit("\n" + self.suffix(question, prefill) + (self.config.custom_prompt_suffix or "")))

    def example(self, question: Question, label: Column, first: bool, show_question: bool = True) -> Column:
        description = (described(self.task, several=True) or described(self.task)) if first else None
        return F.concat(F.lit(self.prefix(description)), self.information(), F.lit("\n" + self.suffix(question, True, show_question) + " "), label, F.lit("\n\n" + (self.config.custom_prompt_suffix or "")))

    def few_shot(self, rows: DataFrame, examples: DataFrame, question: Question, *, order: tuple[int, ...] | None = None, show_question: bool = True, into: str = "prompt") -> DataFrame:
        """Adds the prompt of each row, after the examples in the order of their column shot (from 1). examples: the task's features and
        target; a handful of rows, which become one row of text."""
        label = question.key_of(F.col(f"`{self.task.target_column}`"))
        one = examples.select("shot", self.example(question, label, True, show_question).alias("first"), self.example(question, label, False, show_question).alias("other"))
        place = F.array_position(F.array(*[F.lit(i + 1) for i in order]), F.col("shot")) if order else F.col("shot")
        listed = one.select(F.struct(place.cast("int").alias("at"), "first", "other").alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x"))
        head = listed.select(F.array_join(F.transform("x", lambda x, i: F.when(i == 0, x["first"]).otherwise(x["other"])), "").alias("_head"))
        return rows.crossJoin(F.broadcast(head)).withColumn(into, F.concat("_head", self.zero_shot(question, None))).drop("_head")

    def few_shot_each(self, rows: DataFrame, train: DataFrame, question: Question, *, shots: int, counts: dict[int, int] | None = None, seed: int = 42, order: tuple[int, ...] | None = None, show_question: bool = True, row_id: str = "row_id", into: str = "prompt") -> DataFrame:
        """As few_shot(), with examples drawn anew for each row, without replacement, by hashes of the row's id. counts: so many of each label; without it, any rows.

        Places in the training rows are drawn, and examples joined by place: rows * shots texts are moved, and nothing is collected but the number of rows of each label.
        """
        label = F.col(f"`{self.task.target_column}`")
        part = label.cast("int") if counts else F.lit(0)
        placed = with_position(train.withColumn("_part", part), "_p", hash_key(row_id, seed), row_id, by=("_part",))
        key = question.key_of(label)
        texts = placed.select("_part", "_p", self.example(question, key, True, show_question).alias("first"), self.example(question, key, False, show_question).alias("other"))
        sizes = {r[0]: r[1] for r in train.groupBy(part.alias("_part")).count().collect()}
        wanted = counts or {0: shots}
        if short := {k: sizes.get(k, 0) for k, n in wanted.items() if sizes.get(k, 0) < n}:
            raise ValueError(f"too few examples: {short}")

        def places(k: int, n: int) -> Column:
            # Twice as many as needed and some; the first places stand in where too many of these are equal.
            tries = F.transform(F.sequence(F.lit(0), F.lit(2 * n + 8)), lambda j: hash_long(hash_key(row_id, seed, k, j)) % sizes[k] + 1)
            found = F.slice(F.array_distinct(F.concat(tries, F.sequence(F.lit(1), F.lit(n)).cast("array<bigint>"))), 1, n)
            return F.transform(found, lambda p: F.struct(hash_key(row_id, seed, k, p).alias("o"), F.lit(k).alias("_part"), p.alias("_p")))

        drawn = [places(k, n) for k, n in wanted.items() if n]
        shown = rows.select(F.col(row_id).alias("_row"), F.posexplode(F.array_sort(F.concat(*drawn))).alias("_at", "_x")).select("_row", "_at", "_x._part", "_x._p")
        place = F.array_position(F.array(*[F.lit(i) for i in order]), F.col("_at")).cast("int") if order else F.col("_at")
        head = shown.join(texts, ["_part", "_p"]).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), "first", "other"))).alias("x"))
        head = head.select("_row", F.array_join(F.transform("x", lambda x, i: F.when(i == 0, x["first"]).otherwise(x["other"])), "").alias("_head"))
        return rows.join(head, F.col(row_id) == F.col("_row")).withColumn(into, F.concat("_head", self.zero_shot(question, None))).drop("_head", "_row")

    def chat(self, question: Question, *, system: str | None, prefill: str | None, template: ChatTemplate) -> Column:
        return template.filled(self.zero_shot(question, prefill=False), system=system, prefill=prefill)


@dataclass(frozen=True)
class ChatTemplate:
    """What surrounds a message of each role; takes_system: whether the model knows the role."""

    before: str = "<|{role}|>"
    after: str = "<|end|>"
    generation: str = "<|assistant|>"
    takes_system: bool = True

    def _message(self, role: str, content: Column) -> Column:
        return F.concat(F.lit(self.before.format(role=role)), content, F.lit(self.after))

    def filled(self, user: Column, *, system: str | None = None, prefill: str | None = None) -> Column:
        """The conversation; with a prefill, it ends where the prefill does. Null where the prefill can't be found."""
        parts = [self._message("system", F.lit(system))] if system is not None and self.takes_system else []
        parts.append(self._message("user", user))
        if prefill is None:
            return F.concat(*parts, F.lit(self.generation))
        whole = F.concat(*parts, self._message("assistant", F.lit(prefill)))
        return ended_at(whole, prefill)

    def messages(self, conversation: str | Column) -> Column:
        """Of an array of (role, text), in order."""
        shown = F.filter(conversation, lambda m: (m["role"] != "system") | F.lit(self.takes_system))
        before, after = self.before.split("{role}")
        return F.array_join(F.transform(shown, lambda m: F.concat(F.lit(before), m["role"], F.lit(after), m["text"], F.lit(self.after))), "")


def ended_at(x: Column, last: str) -> Column:
    """Up to the end of the last occurrence; null if there is none."""
    at = F.locate(last[::-1], F.reverse(x))
    return F.when(at > 0, F.substring(x, F.lit(1), F.length(x) - at + 1))


def description_list(task: Task) -> Column:
    """One line a feature: '- The label is: text.', or the text alone where the column says all."""
    lines = [F.concat(F.lit("- "), c.of(F.col(f"`{n}`"))) if (c := task.columns[n]).value_only else F.concat(F.lit(f"- The {c.label} is: "), c.of(F.col(f"`{n}`")), F.lit(".")) for n in task.features]
    return F.concat_ws("\n", *lines)
