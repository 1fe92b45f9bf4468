"""Fill-in-the-middle against plain Python, and there and back."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from riskframe.llm import fim
from riskframe.llm.queries import QUERIES

LONG = "\n".join(f"word{i} \t tail{i % 7}" for i in range(60000)) + "  "
ROWS = [
    (1, None), (2, ""), (3, "  \t\n"), (4, "one"), (5, " one  two\x0bthree "), (6, "has <P> inside"), (7, "almost <P <S< M> <<"), (8, "a<M>"), (9, LONG), (10, "é ü \U0001f600 z \x00\x1f q"), (None, "no id at all"),
    (11, "repeated row"), (11, "repeated row"), (12, "<"), (13, ">" * 50 + " <S"), (-14, "below zero"), *[(i, f"a{i} <b{i}\tc >{i} d S>{i}") for i in range(100, 400)],
]


def plain(doc_id, text, rate=50, spm=80, seed=42) -> tuple:
    text = text or ""
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("settings", [{}, {"rate": 100, "spm": 50}, {"rate": 0}, {"rate": 100, "spm": 0, "seed": 7}, {"rate": 100, "spm": 100}])
def test_rows_are_those_of_plain_python(spark, settings):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "form", "output", "units", "h1", "p", "a")})
    out = fim.fill_in_middle(docs, **settings).withColumn("back", fim.restored()).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1] or "")
    found = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out), key=key)
    assert found == sorted(((i, *plain(i, t, **settings)) for i, t in ROWS), key=key)
    assert all(r["back"] == r["text"] for r in out)
    if settings.get("rate") == 100:
        assert {r["form"] for r in out} == {"plain", *(["spm"] if settings["spm"] else []), *(["psm"] if settings["spm"] < 100 else [])}


def test_empty_table(spark):
    assert fim.digest(fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_digest_shows_what_restoring_gives(spark):
    out = fim.digest(fim.fill_in_middle(spark.createDataFrame(ROWS, "doc_id long, text string"))).collect()
    texts = {i: t or "" for i, t in ROWS}
    assert all(r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in out)
    assert any(r["output_sha256"] != r["restored_sha256"] for r in out)


def test_plan_has_neither_python_nor_exchange(spark, sf):
    plan = QUERIES["op11_fim"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)
    assert plan.count("regexp_extract_all") == 1  # once a text, not once a column
