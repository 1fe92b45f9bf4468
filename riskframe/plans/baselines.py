"""Classical models on the same features, for comparison."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boosting, metrics
from ..sources.shared import remove, shared_folder

#: XGBoost: second-order boosted trees by Spark's aggregates (operators/boosting.py); the others are Spark's own.
MODELS = {"LR": lambda: LogisticRegression(maxIter=50), "GBM": lambda: GBTClassifier(maxIter=20, seed=42)}


def fit_and_score(df: DataFrame, features: list[str], model: str = "LR", **settings) -> DataFrame:
    """Fits on the rows of split train; risk_score of the others. Missing features read -1, but to XGBoost, which learns a side for them at each split. settings: of boosting.fit."""
    if model == "XGBoost":
        learned = boosting.fit(df.where("split = 'train'"), features, **settings)
        return df.where("split <> 'train'").withColumn("risk_score", learned.probability())
    filled = df.fillna(-1, subset=features)
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(filled)
    fitted = MODELS[model]().setFeaturesCol("_x").setLabelCol("label").fit(rows.where("split = 'train'"))
    out = fitted.transform(rows.where("split <> 'train'"))
    return out.withColumn("risk_score", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def fit_and_evaluate(df: DataFrame, features: list[str], model: str = "LR", **settings) -> DataFrame:
    """One row. The split rows are written once and read by all passes of the fit, the scores once for all metrics; both go when the row is there."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/baseline-{uuid.uuid4().hex[:12]}"
    try:
        df.select(*dict.fromkeys([*features, "label", "split"])).write.partitionBy("split").parquet(f"{folder}/rows")
        rows = spark.read.parquet(f"{folder}/rows")
        fit_and_score(rows, features, model, **settings).select("label", "risk_score").write.parquet(f"{folder}/scores")
        scored = spark.read.parquet(f"{folder}/scores")
        found = metrics.losses(scored).crossJoin(metrics.roc_auc(scored)).withColumn("model", F.lit(model))
        return spark.createDataFrame(found.collect(), found.schema)  # one row
    finally:
        remove(spark, folder)
