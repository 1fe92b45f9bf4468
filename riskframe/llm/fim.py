"""Fill-in-the-middle: texts cut into prefix, middle and suffix at unit borders, and put in the order that a model is trained on.

Only Spark's own functions: regexp_extract_all makes the array of units, SHA-256 of the id gives the cuts, slice and array_join the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit: a word with the white space before it; white space that no word follows is a unit too. Units cover the whole text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 that follow from the seed and the id; a null id counts as an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, *, rate: int = 50, spm: int = 80, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output, text; a row for each row of docs, in one pass without a shuffle.

    About `rate` of 100 texts are rearranged, and of those about `spm` of 100 with the suffix first. Null texts count as empty. Empty texts and those that
    hold one of the three sentinels stay plain, for their parts couldn't be told apart; plain rows have null prefix_chars and middle_chars. Rows that repeat
    an id and a text get the same form and cuts; other columns aren't looked at.
    """
    units = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[d.alias(f"h{i}") for i, d in enumerate(_draws(F.col(doc_id), seed), 1)])
    units = units.withColumn("units", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))).withColumn("n", F.size("units").cast("long"))
    sentinel = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("n") == 0) | sentinel | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    one, other = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    cut = units.select("doc_id", "text", "units", "n", form.alias("form"), F.least(one, other).cast("int").alias("a"), F.greatest(one, other).cast("int").alias("b"))
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    parts = cut.select("doc_id", "text", "n", "form", part(F.lit(1), F.col("a")).alias("p"), part(F.col("a") + 1, F.col("b") - F.col("a")).alias("m"), part(F.col("b") + 1, F.col("n").cast("int") - F.col("b")).alias("s"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "p", F.lit(SUFFIX), "s", F.lit(MIDDLE), "m")).otherwise(F.concat(F.lit(SUFFIX), "s", F.lit(PREFIX), "p", F.lit(MIDDLE), "m"))
    return parts.select("doc_id", "n", "form", F.length("p").cast("long").alias("prefix_chars"), F.length("m").cast("long").alias("middle_chars"), output.alias("output"), "text")


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output of a form was made from: what lies between the sentinels, in the text's order.

    A text with a sentinel of its own is always plain, and no sentinel can arise where a part meets one, so the three found are those put in.
    """
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    between = F.split(output, "<[PSM]>", 4)
    ordered = lambda *places: F.concat(*[F.get(between, F.lit(i)) for i in places])
    return F.when(form == "plain", output).when(form == "psm", ordered(1, 3, 2)).otherwise(ordered(2, 3, 1))


def digest(rows: DataFrame) -> DataFrame:
    """Lengths and SHA-256 of the output, and of the text as rebuilt from output and form alone."""
    rows = rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", restored().alias("back"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("back").cast("binary"), 256).alias("restored_sha256"))
