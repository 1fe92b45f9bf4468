"""The registered queries of the corpus operators, one each, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, decontam, extract, fim, langid, licenses, mixing, ngram_join, rules, secrets, sharding, spelling, warc
from .common import Scratch
from .oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by the Jaccard similarity of their 5-word shingles."""
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents hold notices or texts of."""
    found = licenses.licenses(_table(spark, sf_dir, "documents"))
    return found.withColumn("dice", F.round("dice", 9))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents share with benchmark items."""
    return decontam.digest(decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes."""
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents: counts and a digest of the base kinds, and all spans."""
    found = secrets.secrets(_table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *[count(k) for k in secrets.BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives, and read back."""
    pages = _table(spark, sf_dir, "pages")
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.root}/archives"
    manifest = warc.write(pages, folder, scratch=scratch)
    back = warc.read(manifest, folder, pages.schema["page_id"].dataType.simpleString())
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of documents, as labels teach it."""
    return classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of documents, the rules they fail, and what the strict policy keeps."""
    out = rules.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits", "base_failed", "kept")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents, as their own labels teach it."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut and rearranged for fill-in-the-middle, and whether they come back whole."""
    return fim.digest(fim.fill_in_middle(_table(spark, sf_dir, "documents")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents, the near words and the forms that they are variants of."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of the pages."""
    return extract.extract(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_join, op2_license_scan, op3_decontamination, op4_sharding, op5_secret_scan, op6_warc, op7_quality, op8_quality_rules, op9_language, op10_mixing, op11_fim, op12_spelling, op13_html_text)
}
