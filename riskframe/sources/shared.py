"""The folder that driver and executors share, and what is written to it for a while."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and Spark runs on this machine alone (tests), a new temporary one, which is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="riskframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def committed(spark: SparkSession, path: str) -> list[str]:
    """Folders below path whose job has ended; those of jobs that failed or still run don't count."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    folders = [s.getPath() for s in system.listStatus(at) if s.isDirectory()]
    return sorted(f.toString() for f in folders if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))
