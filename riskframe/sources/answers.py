"""A store of what models answered, by the content of what they were asked.

Rows are keyed by a hash of prompt, model and settings. Each prompt that has no answer yet is asked once, whatever rows hold it; what comes back is one batch,
a folder that counts once its job has ended. So a lost executor, a failed job or another run never changes an answer or adds a cost twice.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import inference
from .shared import committed, remove

#: Answers of a Backend, and their type.
NUMBERS, BACKEND_ANSWER = "numbers", "double"


def answer_key(prompt: Column, model_name: str, settings: dict) -> Column:
    """SHA-256 of the settings, the model's name and the prompt."""
    return F.sha2(F.concat_ws("\n", F.lit(json.dumps(settings, sort_keys=True, default=str)), F.lit(model_name), prompt).cast("binary"), 256)


class AnswerStore:
    """Answers in the folder `path`, of any number of models and settings, each kind of answer (numbers, tokens, words, texts) apart from the others.

    A prompt without an answer isn't stored: it is asked again by the next run. Two runs at once may ask the same prompt; of several answers to a key the
    first batch's counts.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _folder(self, gives: str) -> str:
        return f"{self.path}/{gives}"

    def batches(self, spark, gives: str) -> DataFrame:
        """_key, answer, cost, batch: all that ended jobs have written."""
        kind = inference.KINDS[gives][0] if gives in inference.KINDS else BACKEND_ANSWER
        schema = f"_key string, answer {kind}, cost double, batch string"
        folders = committed(spark, self._folder(gives))
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def stored(self, spark, gives: str) -> DataFrame:
        """_key, answer, cost: one row a key."""
        rows = self.batches(spark, gives)
        return rows.groupBy("_key").agg(F.min_by(F.struct("answer", "cost"), "batch").alias("_a")).select("_key", "_a.*")

    def answered(self, df: DataFrame, backend, *, model_name: str, settings: inference.Settings | None = None, prompt: str = "prompt", batch: int = inference.BATCH) -> DataFrame:
        """df with `answer`: null where the model gave none, or the prompt is null. backend: a Model, or what makes a Backend that gives numbers. The model is asked here and now; what
        is returned only reads."""
        spark, model = df.sparkSession, backend if isinstance(backend, inference.Model) else None
        gives = model.gives if model else NUMBERS
        what = asdict(settings) if model and settings else {}
        keyed = df.withColumn("_key", answer_key(F.col(prompt), model_name, what))
        # Of all columns: a first() of texts would have each task sort all of its prompts.
        wanted = keyed.where(F.col(prompt).isNotNull()).select("_key", F.col(prompt).alias("_prompt")).distinct()
        known = self.stored(spark, gives).select("_key")
        new = wanted.join(known, "_key", "left_anti")
        if model:
            found = inference.answered(new, model, settings, prompt="_prompt", batch=batch)
        else:
            found = inference.scored(new, backend, prompt="_prompt", into="answer", batch=batch).withColumn("cost", F.lit(None).cast("double"))
        name = uuid.uuid4().hex[:12]
        found.where(F.col("answer").isNotNull()).select("_key", "answer", "cost", F.lit(name).alias("batch")).write.parquet(f"{self._folder(gives)}/{name}")
        return keyed.join(self.stored(spark, gives).select("_key", "answer"), "_key", "left").drop("_key")

    def kept(self, scores: DataFrame) -> DataFrame:
        """Scores written beside the answers and read back, so that no metric makes their prompts again."""
        path = f"{self.path}/scores/{uuid.uuid4().hex[:12]}"
        scores.write.parquet(path)
        return scores.sparkSession.read.schema(scores.schema).parquet(path)

    def totals(self, spark) -> dict:
        """n_answers and cost of all that is stored, each answer once."""
        out = {"n_answers": 0, "cost": 0.0}
        for gives in (NUMBERS, *inference.KINDS):
            r = self.stored(spark, gives).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost")).first()
            out = {"n_answers": out["n_answers"] + r["n"], "cost": out["cost"] + r["cost"]}
        return out

    def remove(self, spark) -> None:
        remove(spark, self.path)
