"""Session settings the jobs are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Recording the call site of every column operation costs several times the operation.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # The page expressions are long; their full text is of no use to the listeners that ask for a description.
    "spark.sql.ui.explainMode": "simple",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
