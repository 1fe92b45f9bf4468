"""Readers and writers."""

from __future__ import annotations

import json
import os
import pickle
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, *, sep: str = ",", skip_comments: bool = False) -> DataFrame:
    """With a header and a given schema; bad rows raise. A first column without a name is the schema's first."""
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "FAILFAST").option("enforceSchema", True)
    return (reader.option("comment", "#") if skip_comments else reader).csv(path)


def read_codebook(spark: SparkSession, path: str, postprocess=None) -> DataFrame:
    """code and text from lines such as '0010 .Text'; other lines are left out. postprocess: Column to Column."""
    pattern = r"(\d+)\s+[.](.+)$"
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    text = F.regexp_extract("value", pattern, 2)
    return lines.select(F.regexp_extract("value", pattern, 1).cast("long").alias("code"), (postprocess(text) if postprocess else F.trim(text)).alias("text"))


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """position, area and region from a semicolon-separated table whose header stands in its second line, after a comment."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.col("value"), "\r?\n")).alias("position", "line"))
    cells = F.split(F.col("line"), ";")
    return raw.where("position > 1 AND line <> ''").select("position", F.get(cells, F.lit(8)).alias("area"), F.get(cells, F.lit(5)).alias("region"))


def read_results(spark: SparkSession, root: str, schema: str | T.StructType, pattern: str = r"results[.]bench-(\d+)[.]json$") -> DataFrame:
    """JSON files below a folder whose names match; file_hash is the pattern's first group."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    df = df.withColumn("_f", F.col("_metadata.file_name"))
    return df.where(F.col("_f").rlike(pattern)).withColumn("file_hash", F.regexp_extract("_f", pattern, 1)).drop("_f")


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header, for tables of results."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_json(obj, path: str | Path, overwrite: bool = True) -> None:
    with open(path, "w" if overwrite else "x") as f:
        json.dump(obj, f, indent=4, sort_keys=True, default=str)


def load_json(path: str | Path):
    with open(path) as f:
        return json.load(f)


def save_pickle(obj, path: str | Path) -> None:
    with open(path, "wb") as f:
        pickle.dump(obj, f)


def load_pickle(path: str | Path):
    """Only for files that this program wrote."""
    with open(path, "rb") as f:
        return pickle.load(f)


def save_results(record: dict, root: str, model: str, config_hash: str) -> str:
    """Writes <root>/<model>_bench-<hash>/results.bench-<hash>.json."""
    folder = os.path.join(root, f"{model.replace('/', '--')}_bench-{config_hash}")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"results.bench-{config_hash}.json")
    save_json(record, path)
    return path


def latex_table(df: DataFrame, digits: int = 2) -> str:
    """A small table as LaTeX."""
    rows = df.collect()
    cell = lambda v: "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    body = [" & ".join(cell(v) for v in r) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", " & ".join(df.columns) + r" \\", r"\hline", *body, r"\end{tabular}"])


def qa_dataset(df: DataFrame, prompts, question, numeric_question, label: str) -> DataFrame:
    """The published layout: one row a record, with its texts, questions, choices and answer. prompts: a Prompts of the task."""
    q, n = question, numeric_question
    return df.select(
        F.col("row_id").alias("id"),
        prompts.information().alias("description"),
        F.lit("Please answer the question based on the information provided.").alias("instruction"),
        F.lit(q.text).alias("question"),
        F.array(*[F.lit(c.text) for c in q.choices]).alias("choices"),
        q.text_of_answer(q.key_of(F.col(label))).alias("answer"),
        q.key_of(F.col(label)).alias("answer_key"),
        prompts.zero_shot(q).alias("choice_question_prompt"),
        F.lit(n.text).alias("numeric_question"),
        F.col(label).alias("label"),
        prompts.zero_shot(n).alias("numeric_question_prompt"),
    )
