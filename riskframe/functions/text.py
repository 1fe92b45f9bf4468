"""Strings: labels of values, layouts, extraction of probabilities, names of models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def years_old(x: Column) -> Column:
    return F.concat(x.cast("int").cast("string"), F.lit(" years old"))


def hours(x: Column) -> Column:
    return F.concat(x.cast("int").cast("string"), F.lit(" hours"))


def minutes(x: Column) -> Column:
    return F.concat(x.cast("int").cast("string"), F.lit(" minutes"))


def dollars(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x.cast("long"), 0))


def poverty_ratio(x: Column) -> Column:
    where = F.when(x < 90, "below").when(x < 110, "at or near").otherwise("above")
    return F.concat(x.cast("int").cast("string"), F.lit("% of the poverty line income, which is "), where, F.lit(" the poverty line"))


def sentence_case(x: Column) -> Column:
    """First letter upper case, all others lower."""
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))


def after_dash(x: Column) -> Column:
    """Without what stands before the first dash."""
    return F.when(x.contains("-"), F.regexp_replace(x, "^[^-]*-", "")).otherwise(x)


def occupation(x: Column) -> Column:
    return F.trim(sentence_case(after_dash(x)))


def before_slash(x: Column) -> Column:
    return F.trim(F.split_part(x, F.lit("/"), F.lit(1)))


def sector(x: Column) -> Column:
    """The prefix before the first dash; lines without one name their sector by their beginning."""
    special = F.when(x.contains("Engineering"), "ENG").when(x.startswith("Grinding"), "PRD").when(x.startswith("Unemployed"), "UNEMPL").otherwise(x)
    return F.when(x.contains("-"), F.split_part(x, F.lit("-"), F.lit(1))).otherwise(special)


def age_range(x: Column, width: int = 10, least: int = 18, most: int = 90) -> Column:
    """Ranges of ages that begin at multiples of the width; the least age opens the first, with the range after it if that is short."""
    first = -(-least // width) * width
    if first - least <= width / 2:
        first += width
    low = F.when(x < first, F.lit(least)).otherwise((F.floor(x / width) * width).cast("int"))
    high = F.when(x < first, F.lit(first - 1)).otherwise(F.least((F.floor(x / width) * width).cast("int") + width, F.lit(most)) - 1)
    return (
        F.when(x < least, f"Less than {least} years old")
        .when(x >= most, f"{most} or more years old")
        .otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" years old")))
    )


def hours_range(x: Column, width: int = 10, most: int = 60) -> Column:
    low = (F.floor(x / width) * width).cast("int")
    return (
        F.when(x <= 0, "N/A (less than 16 years old, or did not work during the past 12 months)")
        .when(x >= most, f"more than {most} hours")
        .otherwise(F.concat(low.cast("string"), F.lit("-"), (low + (width - 1)).cast("string"), F.lit(" hours")))
    )


def white_or_not(x: Column) -> Column:
    return F.when(x == 1, "White").otherwise("Non-White")


def connected(label: str | Column, connector: str, text: Column) -> Column:
    """Label and text; a lone colon clings to the label (fixed, as prompts have to match)."""
    between = ": " if connector == ":" else f" {connector} "
    return F.concat(F.lit(label) if isinstance(label, str) else label, F.lit(between), text)


#: What stands before and after each item.
LAYOUTS = {"bullet": ("- ", "\n"), "comma": ("", ", "), "text": ("The ", ". "), "textbullet": ("- The ", ".\n")}


def laid_out(items: list[Column], layout: str) -> Column:
    """Items one after the other; commas, blanks and line ends at the end go."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown format {layout!r}; there are {sorted(LAYOUTS)}")
    before, after = LAYOUTS[layout]
    parts = [p for x in items for p in (F.lit(before), x, F.lit(after))]
    return F.regexp_replace(F.concat(*parts), "[, \\n]+$", "")


def time_text(at: Column) -> Column:
    """A time as it stands in names of files."""
    return F.date_format(at, "yyyy.MM.dd-HH.mm.ss")


def after_thinking(x: Column) -> Column:
    """What follows the first </think>, trimmed; the whole text if there is none."""
    at = F.locate("</think>", x)
    return F.when(at > 0, F.trim(F.substring(x, at + F.lit(8), F.length(x)), F.lit(" \n\t\r"))).otherwise(x)


#: Patterns for a stated probability, the surest first, and whether the number is a percentage.
PROBABILITY_PATTERNS = (
    (r"[Pp]robability(?:\s+(?:is|of|estimate)?)?[:\s]+(\d+(?:\.\d+)?)\s*%", True),
    (r"[Pp]robability(?:\s+(?:is|of|estimate)?)?[:\s]+(\d*\.?\d+)(?![%\d])", False),
    (r"(\d+(?:\.\d+)?)\s*%", True),
    (r"(?i)(\d+(?:\.\d+)?)\s+percent", True),
    (r"(?<![.\d])(0?\.\d+)(?![.\d])", False),
)


def last_probability(x: Column, pattern: str, percent: bool) -> Column:
    """The last match as a share of one; null if there is none or it lies outside."""
    found = F.try_element_at(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), F.lit(-1)).try_cast("double")
    share = F.when(F.lit(percent) | (found > 1), found / 100).otherwise(found)
    return F.when(share.between(0.0, 1.0), share)


def probability(x: Column) -> Column:
    """By the first pattern that gives one; null if none does."""
    return F.coalesce(*[last_probability(x, p, percent) for p, percent in PROBABILITY_PATTERNS])


def probability_or_half(x: Column) -> Column:
    return F.coalesce(probability(after_thinking(x)), F.lit(0.5))


def leading_number(x: Column) -> Column:
    """The decimal or whole number that the text begins with, as text; null if there is none."""
    found = F.regexp_extract(x, r"^([-+]?\d*\.\d+|\d+)", 1)
    return F.when(found != "", found)


def stated_probability(x: Column) -> Column:
    """The leading number, read as what follows the point if it has none."""
    n = leading_number(x)
    return F.when(n.contains("."), n.try_cast("double")).otherwise(F.concat(F.lit("0."), n).try_cast("double"))


def reconciled(decoded: Column, stated: Column) -> Column:
    """The stated number where it clearly differs from the decoded one; above one it is a percentage."""
    other = F.when(stated > 1, stated / 100).otherwise(stated)
    return F.when(stated.isNotNull() & (F.abs(decoded - stated) > 0.01 + 1e-5 * F.abs(stated)), other).otherwise(decoded)


def model_size(name: Column) -> Column:
    """Billions of parameters that a name states, experts times size; null if it states none."""
    low = F.lower(name)
    size = F.regexp_extract(low, r"(?:(\d+)x)?(\d+)b", 2)
    experts = F.regexp_extract(low, r"(?:(\d+)x)?(\d+)b", 1)
    return F.when(size != "", size.try_cast("int") * F.when(experts != "", experts.try_cast("int")).otherwise(F.lit(1)))


def replaced(x: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, x)


#: What is taken out of a name, in this order, to get that of the base model.
TUNED = [("-Instruct", ""), ("-Chat", ""), ("-it", ""), ("-1.1", ""), ("-v0.2", "-v0.1")]
#: Names for display.
DISPLAY_NAMES = {
    "Meta-Llama-3-70B": "Llama 3 70B",
    "Meta-Llama-3-70B-Instruct": "Llama 3 70B (it)",
    "Meta-Llama-3-8B": "Llama 3 8B",
    "Meta-Llama-3-8B-Instruct": "Llama 3 8B (it)",
    "Mistral-7B-Instruct-v0.2": "Mistral 7B (it)",
    "Mistral-7B-v0.1": "Mistral 7B",
    "Mixtral-8x22B-Instruct-v0.1": "Mixtral 8x22B (it)",
    "Mixtral-8x22B-v0.1": "Mixtral 8x22B",
    "Mixtral-8x7B-Instruct-v0.1": "Mixtral 8x7B (it)",
    "Mixtral-8x7B-v0.1": "Mixtral 8x7B",
    "Yi-34B": "Yi 34B",
    "Yi-34B-Chat": "Yi 34B (it)",
    "gemma-1.1-2b-it": "Gemma 2B (it)",
    "gemma-1.1-7b-it": "Gemma 7B (it)",
    "gemma-2b": "Gemma 2B",
    "gemma-7b": "Gemma 7B",
    "gemma-2-9b": "Gemma 2 9B",
    "gemma-2-9b-it": "Gemma 2 9B (it)",
    "gemma-2-27b": "Gemma 2 27B",
    "gemma-2-27b-it": "Gemma 2 27B (it)",
    "openai/gpt-4o-mini": "GPT 4o mini (it)",
    "openai/gpt-4o": "GPT 4o (it)",
}


def without_owner(x: Column) -> Column:
    """What follows the first double dash."""
    at = F.locate("--", x)
    return F.when(at > 0, F.substring(x, at + F.lit(2), F.length(x))).otherwise(x)


def base_name(x: Column) -> Column:
    return replaced(x, TUNED)


def pretty_name(x: Column) -> Column:
    """The display name, or the name itself if it has none."""
    known = F.create_map(*[F.lit(v) for kv in DISPLAY_NAMES.items() for v in kv])
    return F.coalesce(F.try_element_at(known, x), x)


def model_family(x: Column) -> Column:
    low, out = F.lower(x), F.when(F.lower(x).contains("gpt"), "OpenAI")
    for word, family in (("llama", "Llama"), ("mistral", "Mistral"), ("mixtral", "Mistral"), ("gemma", "Gemma"), ("yi", "Yi"), ("qwen", "Qwen")):
        out = out.when(low.contains(word), family)
    return out.otherwise("-")


def path_name(x: Column) -> Column:
    return F.replace(x, F.lit("/"), F.lit("--"))


def shaded(value: Column, low: Column, high: Column, higher_is_better: bool) -> Column:
    """A table cell, with its place between the worst and the best as a shade if that is in the outer tenths."""
    place = F.when(high == low, F.lit(0.5)).otherwise((value - low) / (high - low))
    place = place if higher_is_better else 1 - place
    text = F.format_string("%.2f", value)
    return F.when(place >= 0.9, F.concat(F.lit(r"\cellcolor{good}"), text)).when(place <= 0.1, F.concat(F.lit(r"\cellcolor{bad}"), text)).otherwise(text)


def scalar(x: Column) -> Column:
    """The kind of a command-line value: bool, int, float, or str."""
    return F.when(F.lower(x).isin("true", "false"), "bool").when(x.rlike(r"^[-+]?\d+$"), "int").when(x.try_cast("double").isNotNull(), "float").otherwise("str")
