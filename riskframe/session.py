"""A session with the settings that the package expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "riskframe", **conf: str) -> SparkSession:
    """The running session, or a new one; on a cluster, master and memory come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def local(cpus: int | None = None, memory: str = "6g") -> SparkSession:
    """For tests and benchmarks on one machine."""
    cpus = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(cpus))
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
