"""Token probabilities and generated texts to risk scores, all by Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import after_thinking, probability, stated_probability
from .task import MultipleChoice

#: What may stand before an answer key in a token.
PREFIXES = ("", " ", "_", "▁", "Ġ", "Ċ")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column) -> Column:
    powers = let(F.struct(logits.alias("z"), F.array_max(logits).alias("m")), lambda s: F.transform(s["z"], lambda v: F.exp(v - s["m"])))
    summed = let(powers, lambda p: F.struct(p.alias("p"), F.aggregate(p, F.lit(0.0), lambda a, v: a + v).alias("s")))
    return let(summed, lambda x: F.transform(x["p"], lambda p: p / x["s"]))


def top_k(probabilities: Column, k: int) -> Column:
    """Map of the k likeliest token ids (positions) to their probabilities; ties go to the lower id."""
    entries = F.transform(probabilities, lambda p, i: F.struct((-p).alias("m"), i.alias("i")))
    return F.map_from_entries(F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e["i"].alias("key"), (-e["m"]).alias("value"))))


def in_range(tokens: Column, size: int | Column) -> Column:
    """Without token ids that a model of that many tokens can't have."""
    return F.map_filter(tokens, lambda i, _: (i >= 0) & (i < size))


def from_logprobs(tokens: Column, size: int | Column) -> Column:
    return F.transform_values(in_range(tokens, size), lambda _, v: F.exp(v))


def passes_of(positions: Column) -> Column:
    """Of an array of maps from token to a struct with its logprob: maps to probabilities; null where there are none."""
    return F.when(F.size(positions) > 0, F.transform(positions, lambda m: F.transform_values(m, lambda _, v: F.exp(v["logprob"]))))


def choice_masses(tokens: Column, vocabulary: Column, question: MultipleChoice) -> list[tuple[Column, list[Column]]]:
    """For each prefix: the mass of all keys, and that of each; null where the vocabulary lacks a token."""
    out = []
    for prefix in PREFIXES:
        masses = []
        for key in question.keys:
            token = F.try_element_at(vocabulary, F.lit(prefix + key))
            masses.append(F.when(token.isNotNull(), F.coalesce(F.try_element_at(tokens, token), F.lit(0.0))))
        out.append((sum((F.coalesce(m, F.lit(0.0)) for m in masses), F.lit(0.0)), masses))
    return out


def multiple_choice(tokens: Column, vocabulary: Column, question: MultipleChoice) -> Column:
    """The expected value of the choices under the prefix with the most mass (ties: the first), with masses scaled to one; equal
    shares where there is none. With two choices found: the share of that of the higher value."""
    by_prefix = choice_masses(tokens, vocabulary, question)
    best = F.greatest(*[total for total, _ in by_prefix])
    numbers = [c.number for c in question.choices]
    ranked = sorted(range(len(numbers)), key=lambda i: numbers[i])
    uniform = 1.0 / len(numbers) if len(numbers) == 2 else sum(numbers) / len(numbers)
    out = F.lit(None).cast("double")
    for total, masses in reversed(by_prefix):
        found = sum((m.isNotNull().cast("int") for m in masses), F.lit(0))
        # Of two choices that were found, the one with the higher number.
        higher = F.coalesce(*[masses[i] for i in reversed(ranked)])
        expected = sum((F.coalesce(m, F.lit(0.0)) * n for m, n in zip(masses, numbers)), F.lit(0.0))
        score = F.when(found == 2, F.try_divide(higher, total)).otherwise(F.try_divide(expected, total))
        out = F.when(total == best, score).otherwise(out)
    return F.when(best <= 0, F.lit(uniform)).otherwise(out)


def numeric_tokens(vocabulary: Column, size: int | Column) -> Column:
    """Token to id, of digits and the point."""
    return F.map_filter(vocabulary, lambda t, i: (t.rlike("^[0-9]+$") | (t == ".")) & (i < size))


def numeric_entries(vocabulary: Column, size: int | Column) -> Column:
    """i and t: numeric tokens' ids and texts, in the order of the ids."""
    return F.array_sort(F.transform(F.map_entries(numeric_tokens(vocabulary, size)), lambda e: F.struct(e["value"].alias("i"), e["key"].alias("t"))))


def numeric(passes: Column, vocabulary: Column, size: int | Column) -> Column:
    """Each pass gives its likeliest numeric token; together they are the number's digits. Null if that is no number."""
    return numeric_of(passes, numeric_entries(vocabulary, size))


def numeric_of(passes: Column, entries: Column) -> Column:
    """numeric(), from numeric_entries(). Spark doesn't keep what it computed within these functions, so all that is used again is computed by let()."""

    def likeliest(tokens: Column, known: Column) -> Column:
        ranked = F.transform(known, lambda e: F.struct((-F.coalesce(F.try_element_at(tokens, e["i"]), F.lit(0.0))).alias("m"), e["i"].alias("i"), e["t"].alias("t")))
        return F.array_min(ranked)["t"]

    digits = let(entries, lambda known: F.array_join(F.transform(passes, lambda tokens: likeliest(tokens, known)), ""))
    return let(digits, stated_probability)


def reasoned(text: Column, thinking: bool = False) -> Column:
    """The stated probability, or null."""
    return probability(after_thinking(text) if thinking else text)


def synthetic_vocabulary(passes: Column) -> Column:
    """Of an array of maps from token to probability: the distinct tokens, sorted; a token's id is its place."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(passes, lambda m: F.map_keys(m)))))
