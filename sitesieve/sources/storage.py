"""Sinks for findings and reports, and places to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(session: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local session without that setting, as in tests,
    gets a temporary one.
    """
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        folder = session.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="sitesieve-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settle(frame: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there; for small tables."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame, name: str = "table") -> DataFrame:
    """Write the rows as compressed Parquet below the checkpoint folder and go on from there; for large tables.

    Read again, the table has its true size for the planner, which a checkpointed frame has not.
    """
    path = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


class Buckets:
    """A table in buckets of some columns below the checkpoint folder, to which rows are added step by step.

    Joins and aggregates on these columns read it as it lies: only their other side is shuffled, to as many partitions. The
    number of buckets is the session's number of shuffle partitions, unless given. ``step`` counts the additions, each in
    a folder of its own, so that one step is read without the others.
    """

    def __init__(self, session: SparkSession, name: str, *keys: str, number: int | None = None):
        self.session, self.keys = session, keys
        self.number = number or int(session.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"{name}_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(session)}/{self.table}"

    def add(self, frame: DataFrame, step: int = 0) -> None:
        """Rows that are dealt by the keys already are written without a shuffle, one file per bucket."""
        dealt = frame.repartition(self.number, *self.keys).withColumn("step", F.lit(step))
        writer = dealt.write.mode("append").partitionBy("step").bucketBy(self.number, *self.keys)
        writer.option("path", self.path).saveAsTable(self.table)

    def read(self, step: int | None = None) -> DataFrame:
        rows = self.session.table(self.table)
        return (rows if step is None else rows.where(F.col("step") == step)).drop("step")

    def done(self) -> DataFrame:
        """All rows, read by their path; the catalog forgets the table."""
        schema = self.session.table(self.table).schema
        self.session.sql(f"DROP TABLE IF EXISTS {self.table}")
        return self.session.read.schema(schema).parquet(self.path).drop("step")


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as a table, one folder per type, so that reports on one type read only theirs.

    Rows are gathered by type before writing, or every task would write a file per type. A large type is split over as
    many tasks as its measured size asks for.
    """
    findings.hint("rebalance", "type").write.mode("overwrite").partitionBy("type").parquet(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON document per site."""
    reports.write.mode("overwrite").json(path)
