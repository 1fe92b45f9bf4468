"""Questions, choices and tasks: plain descriptions on the driver, from which expressions are built."""

from __future__ import annotations

import hashlib
import itertools
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .threshold import Threshold
from .valuemap import ColumnToText

KEYS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def config_hash(config: dict, length: int = 8) -> str:
    """Hexadecimal SHAKE-256 of the sorted JSON."""
    return hashlib.shake_256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest(length // 2)


@dataclass(frozen=True)
class Choice:
    text: str
    value: object
    numeric: float | None = None

    @property
    def number(self) -> float:
        return float(self.value) if self.numeric is None else self.numeric


@dataclass(frozen=True)
class MultipleChoice:
    column: str
    text: str
    choices: tuple[Choice, ...]
    passes: int = 1

    def __post_init__(self) -> None:
        if not self.choices or len(self.choices) > len(KEYS):
            raise ValueError(f"between 1 and {len(KEYS)} choices are needed")

    @property
    def keys(self) -> tuple[str, ...]:
        return tuple(KEYS[: len(self.choices)])

    def prefix(self) -> str:
        return "Answer:"

    def prompt(self, prefill: bool = True) -> str:
        lines = [f"Question: {self.text}", *(f"{k}. {c.text}." for k, c in zip(self.keys, self.choices)), *([self.prefix()] if prefill else [])]
        return "\n".join(lines)

    def key_of(self, value: Column) -> Column:
        """The answer key of a value; null if no choice has it."""
        table = F.create_map(*[x for k, c in zip(self.keys, self.choices) for x in (F.lit(str(c.value)), F.lit(k))])
        return F.try_element_at(table, value.cast("string"))

    def key_in(self, answer: Column) -> Column:
        """The key that a written answer begins with; null if there is none."""
        found = F.regexp_extract(F.upper(answer), rf"^\s*([{''.join(self.keys)}])(?![A-Z0-9])", 1)
        return F.when(found != "", found)

    def number_of(self, key: Column) -> Column:
        """The number of a key's choice."""
        table = F.create_map(*[x for k, c in zip(self.keys, self.choices) for x in (F.lit(k), F.lit(float(c.number)))])
        return F.try_element_at(table, key)

    def text_of_answer(self, answer: Column) -> Column:
        """The choice's text for an answer such as ' b '; null if there is none."""
        table = F.create_map(*[x for k, c in zip(self.keys, self.choices) for x in (F.lit(k), F.lit(c.text))])
        return F.try_element_at(table, F.upper(F.trim(answer)))

    def permutations(self) -> list[MultipleChoice]:
        """The question with its choices in every order: n! of them for n choices, each of which is asked."""
        return [replace(self, choices=p) for p in itertools.permutations(self.choices)]

    @classmethod
    def of_values(cls, column: str, values: dict, attribute: str) -> MultipleChoice:
        return cls(column, f"What is this person's {attribute}?", tuple(Choice(t, str(v)) for v, t in values.items()))


@dataclass(frozen=True)
class Numeric:
    column: str
    text: str
    passes: int = 2
    is_probability: bool = True

    def prefix(self) -> str:
        return "Answer (between 0 and 1): 0." if self.is_probability else "Answer: "

    def prompt(self, prefill: bool = True) -> str:
        return f"Question: {self.text}" + (f"\n{self.prefix()}" if prefill else "")


@dataclass(frozen=True)
class Reasoned:
    """Free text that ends with a probability."""

    column: str
    text: str
    thinking: bool = False
    most_tokens: int = 8000
    passes: int = -1

    def prefix(self) -> str:
        return ""

    @property
    def temperature(self) -> float:
        return 1.0 if self.thinking else 0.0

    def prompt(self, prefill: bool = True) -> str:
        # How reasoning is asked for.
        return (
            f"Question: {self.text}\n\n"
            "Think step-by-step about the factors that could influence the answer to this question. "
            "After reasoning through the relevant information, provide your final probability estimate.\n\n"
            "Your response MUST end with your probability estimate in the following format:\n"
            "Probability: X%\nwhere X is a number between 0 and 100.\n\nReasoning:"
        )


Question = MultipleChoice | Numeric | Reasoned


@dataclass(frozen=True)
class Task:
    name: str
    description: str
    features: tuple[str, ...]
    target: str
    threshold: Threshold | None = None
    sensitive: str | None = None
    columns: dict[str, ColumnToText] = field(default_factory=dict, hash=False)
    multiple_choice: MultipleChoice | None = None
    numeric: Numeric | None = None

    @property
    def target_column(self) -> str:
        return self.threshold.name(self.target) if self.threshold else self.target

    @property
    def required(self) -> list[str]:
        return [*self.features, self.target]

    def with_features(self, subset: list[str]) -> Task:
        if unknown := sorted(set(subset) - set(self.features)):
            raise ValueError(f"not features of {self.name}: {unknown}")
        return replace(self, features=tuple(f for f in self.features if f in set(subset)), name=f"{self.name}_{'_'.join(sorted(subset))}")

    def question(self, *, reasoned: bool = False, thinking: bool = False, numeric: bool = False) -> Question:
        """Reasoning goes before numbers, numbers before choices; thinking implies reasoning."""
        if reasoned or thinking:
            if self.numeric is None:
                raise ValueError(f"{self.name} has no question on a probability")
            return Reasoned(self.numeric.column, self.numeric.text, thinking)
        found = self.numeric if numeric else self.multiple_choice
        if found is None:
            raise ValueError(f"{self.name} has no such question")
        return found

    def hash(self) -> str:
        return config_hash({"name": self.name, "features": sorted(self.features), "target": self.target_column, "question": asdict(self.multiple_choice) if self.multiple_choice else None})
