"""Session factory with the settings that the engine is tuned for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: UTC for timestamps, run-time re-planning, and Arrow batches that stay small with long texts.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def session(app: str = "lectern", **settings: str) -> SparkSession:
    """A session with ``SETTINGS``, overridden by ``settings`` (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table: in ``spark.checkpoint.dir``, or in a local folder where all runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"
