"""The pipeline against its stages, done plainly."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from riskframe.llm import classifier, mixing

from . import brute
from .test_corpus import drifting_groups


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    model = classifier.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = model.scores([(r["text"] or "").encode() for r in rows])
    rows = [r for r, s in zip(rows, scores) if s >= 0.7]
    groups = brute.components([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if groups[r["doc_id"]][1] == r["doc_id"]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = brute.leaks([(r["doc_id"], r["text"]) for r in rows], items)
    rows = [r for r in rows if not hit[r["doc_id"]][4]]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(rows, docs.schema)).collect()}
    want = sorted((r["doc_id"], r["source"]) for r in rows for _ in range(copies[r["doc_id"]]))

    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["source"]) for r in out) == want
    sizes, by_shard = {}, {}
    for r in out:
        k = hashlib.md5(r["text"].encode()).hexdigest()
        sizes[k] = sizes.get(k, 0) + r["size"]
        by_shard[r["shard"]] = by_shard.get(r["shard"], 0) + r["size"]
    assert max(by_shard.values()) == brute.least_capacity([sizes[k] for k in sorted(sizes)], 8)


def test_one_of_each_drifting_group_stays(spark, sf):
    """No link between parts of a group that the pivots left apart is lost, so no group keeps two documents."""
    groups = drifting_groups(5, sizes=(60, 90, 120, 150))
    want = sorted(d for rows in groups for d, (_, c) in brute.components(rows).items() if d == c)
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([r for rows in groups for r in rows], "doc_id long, text string"), sf)
    assert sorted(r["doc_id"] for r in out.collect()) == want


def test_rows_that_share_or_lack_an_id_are_told_apart(spark, sf):
    """Of repeated rows one stays; other texts of the same id, or without one, stay if they are no copies."""
    a, b = ("%s one two three four five six seven eight nine ten" % x for x in "ab")
    c = "ten nine eight seven six five four three two one"
    rows = [(1, a), (1, a), (1, b + " x y z w"), (None, c), (None, c), (None, "p q r s t u v"), (2, a), (3, c), (None, None), (None, ""), (4, "a"), (4, "a")]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [(1, a), (1, b + " x y z w"), (3, c), (None, "p q r s t u v"), (None, None), (None, ""), (4, "a")]))


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "source_mix", "shards"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_stages_take_nothing_and_nulls(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0)], docs.schema)
    for table, n in ((docs.limit(0), 0), (odd, 3)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf)
            assert out.count() <= n * 3 and set(docs.columns) <= set(out.columns), name
