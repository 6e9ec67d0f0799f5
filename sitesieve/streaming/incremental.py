"""Findings of captures as they arrive.

Extraction works row by row, so a stream of captures needs no state: findings are appended as pages come in, and the
per-site deduplication and reports run over the appended table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import registry
from ..operators.extract import extract
from ..schema import RESPONSES
from ..sources.captures import analyzable


def read_stream(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(RESPONSES).format(format).load(path)


def append_findings(captures: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append the findings of every arriving page to a table.

    First-page extractors are left out: which page of a site is first is known only over the whole table.
    """
    findings = extract(analyzable(captures), registry.names(in_audit=True, first_page_only=False))
    writer = findings.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
