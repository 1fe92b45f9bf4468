"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskframe.llm import spelling


def folded(run: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in run)


def words_of(rows, drop_one_in=31) -> Counter:
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = folded(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if drop_one_in and h % drop_one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return out


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, drop_one_in=31) -> dict:
    n = {w: k for w, k in words_of(rows, drop_one_in).items() if k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: f for w in n if near[w] and n[f := min(near[w], key=lambda v: (-n[v], v))] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in n}


def corpus() -> list[tuple]:
    """Words with variants of all kinds, chains of forms, ties, runs of equal letters, letters outside A-Z, and a very long run."""
    rng = random.Random(5)
    letters = "abcdeéÉß÷z"
    out, held = [], []
    for _ in range(60):
        w = "".join(rng.choice(letters) for _ in range(rng.choice([6, 7, 7, 8, 9, 12, 20])))
        held += [w] * rng.choice([2, 3, 40, 400])
        for _ in range(6):
            i, c = rng.randrange(len(w) + 1), rng.choice(letters)
            held += [rng.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]])] * rng.choice([1, 2, 2, 3, 30])
    held += ["chained"] * 2 + ["chainedx"] * 20 + ["chainedxy"] * 200 + ["chainedxyz"] * 2000 + ["tiesone"] * 3 + ["tiesonea"] * 30 + ["tiesoneb"] * 30
    held += ["aaaaaaa"] * 2 + ["aaaaaaaa"] * 30 + ["AAAAAAAaa"] * 2 + ["q" * 3000] * 2 + ["q" * 1500 + "x" + "q" * 1500] * 25 + ["short"] * 9
    rng.shuffle(held)
    for i in range(0, len(held), 50):
        out.append((i, " ".join(w.upper() if w.isascii() and rng.random() < 0.1 else w for w in held[i : i + 50]) + rng.choice([".", " 12", "ā中", "-"])))
    return out + [(None, "nullable nullable"), (7, None), (8, ""), (9, "twiceover twiceover"), (9, "twiceover twiceover")]


def rows_of(found) -> dict:
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in found.collect()}


@pytest.mark.parametrize("part_bits", [spelling.PART_BITS, 1 << 15])
def test_variants_are_those_of_all_pairs(spark, part_bits):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("word", "n", "form", "id", "t")}).repartition(7)
    assert rows_of(spelling.variants(docs, part_bits=part_bits)) == brute(rows)


def test_without_deletions(spark):
    rows = corpus()
    found = rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), drop_one_in=0))
    assert found == brute(rows, 0)
    assert found["chained"][4] == "chainedxyz" and found["tiesone"][2] == "tiesonea"


def test_filter_in_parts_loses_no_word(spark):
    vocabulary = spark.createDataFrame([(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", 2) for i in range(9000)], "word string, n long")
    whole, parts = (spelling.near_pairs(vocabulary, 9000, bits).select("word", "near") for bits in (1 << 28, 1 << 15))
    assert whole.count() == parts.count() > 9000 and whole.exceptAll(parts).count() == 0


def test_no_words(spark):
    for rows in ([], [(1, None), (2, ""), (3, "all too short")]):
        assert spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_each_edit_comes_once():
    known = spelling.Filter({i: b"\xff" * 4096 for i in range(1)}, 1 << 15, 0, 1)
    for word in (b"aabba", b"a", b"abc", b"aaaa"):
        found = [c for _, c in spelling.neighbours([word], b"ab", known)]
        letters = "ab"
        w = word.decode()
        expected = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters if c != w[i]} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        assert sorted(x.decode() for x in found) == sorted(expected)
