"""The folder that all executors share."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local-mode session may go without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"/tmp/checkpoints/{os.getpid()}"
    os.makedirs(folder, exist_ok=True)
    return f"file://{folder}"
