"""Row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import settle


def number_rows(frame: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """``row_number()`` over ``group`` by ``order``, without bringing a group into one task.

    A window would sort each group in one task. Here the rows are range-partitioned, so that a large group spans several
    tasks; a row's number is its place within its range plus the group's rows in earlier ranges. The ranged rows are
    settled first, because their bounds come from a sample and must not be drawn twice.
    """
    ranged = settle(
        frame.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
    )
    # One row per group and range it reaches into.
    stretches = ranged.groupBy("_range", *group).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = stretches.select(
        "_range", *group, "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    numbered = ranged.join(offsets, ["_range", *group])
    return numbered.select(
        *frame.columns, (F.col("_place") - F.col("_first") + F.col("_before") + 1).cast("bigint").alias(name)
    )
