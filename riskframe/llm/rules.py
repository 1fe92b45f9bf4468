"""Quality rules: every rule is evaluated once into a ledger of failure bits and measurements.

A policy is a versioned set of rules. Applying one, or asking what each of its rules removes,
reads the ledger's bits only; texts aren't read again. Everything stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails where the condition over the measurements holds."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...] = field(default_factory=tuple)


#: Order gives the bits; new rules go to the end, so that stored ledgers keep their meaning.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "4 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("shouting", "2 * n_upper > n_letters"),
    Rule("exclamations", "10 * n_exclaims > 3 * n_words"),
)
BASE = Policy(1, ("few_words", "repeated_words"))
STRICT = Policy(2, tuple(r.name for r in RULES))


def _length_without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and one column for each measurement; a null text counts as empty.

    Repeated rows each get a row. n_repeat_words: words that lie in a 3-word window which the text holds twice or more.
    Windows are compared by 64-bit hashes within a document: equal hashes are taken as found, not checked.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    df = docs.select(F.col(doc_id).alias("doc_id"), t.alias("_t"))
    df = df.select(
        "doc_id",
        F.filter(F.split("_t", SPACE), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "").alias("_l"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _length_without(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        _length_without(F.col("_t"), "!").cast("long").alias("n_exclaims"),
        _length_without(F.col("_t"), upper).cast("long").alias("n_upper"),
        _length_without(F.col("_t"), upper + lower).cast("long").alias("n_letters"),
    )
    kept = ["doc_id", "word_chars", "n_symbols", "n_exclaims", "n_upper", "n_letters"]
    df = df.select(
        *kept,
        F.size("_w").cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).alias("_h"),
    )
    kept += ["n_words", "n_lines", "n_dup_lines"]
    # Few documents repeat a window; only those sort their windows.
    df = df.select(*kept, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_p"))
    same = lambda p, j: F.coalesce(F.get("_p", j)["h"] == p["h"], F.lit(False))
    df = df.select(*kept, F.sort_array(F.transform(F.filter("_p", lambda p, j: same(p, j - 1) | same(p, j + 1)), lambda p: p["i"])).alias("_s"))
    # A window at position i adds three words, or as many as lie before the next repeated window.
    steps = F.transform("_s", lambda s, j: F.least(F.lit(3), F.coalesce(F.get("_s", j + 1) - s, F.lit(3))))
    return df.select(*kept, F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds fail_bits long: bit k is set where rule k fails."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(rules)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("fail_bits", total)


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    names = [r.name for r in rules]
    return sum(1 << names.index(x) for x in policy.rules)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules))) == 0


def ablation(ledgered: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: how many documents fail it, and how many only it removes. One pass over the bits."""
    m = mask(policy, rules)
    own = F.col("fail_bits").bitwiseAND(F.lit(m))
    picked = [(k, r.name) for k, r in enumerate(rules) if m >> k & 1]
    sums = [F.struct(F.lit(policy.version).alias("version"), F.lit(n).alias("rule"), F.count_if(own.bitwiseAND(F.lit(1 << k)) != 0).alias("n_fail"), F.count_if(own == (1 << k)).alias("n_only"), F.count_if(own != 0).alias("n_removed"), F.count(F.lit(1)).alias("n_docs")) for k, n in picked]
    return ledgered.agg(F.array(*sums).alias("x")).select(F.inline("x"))


def quality_rules(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The ledger with base_failed and kept (false where base_failed, else the policy's verdict)."""
    out = ledger(measure(docs))
    return out.withColumn("base_failed", ~passes(BASE)).withColumn("kept", passes(BASE) & passes(policy)).withColumn("policy_version", F.lit(policy.version))
