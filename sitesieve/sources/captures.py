"""Captured responses: reading, normalising, storing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import site_of
from ..schema import RESPONSES


def read_responses(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Read a stored capture table; the schema is given, never inferred.

    The table is one that ``normalise`` made before it was stored, so its columns are read as they are and filters on them
    reach the files.
    """
    return spark.read.schema(RESPONSES).format(format).load(path)


def read_flagged(spark: SparkSession, path: str) -> DataFrame:
    """Read captures stored by :func:`write_captures`: with ``first_page``, by which files are pruned."""
    return spark.read.schema(f"{RESPONSES}, first_page boolean").parquet(path)


def normalise(captures: DataFrame) -> DataFrame:
    """Bring captures into the responses schema, before they are stored. What is missing gets a neutral value.

    ``site`` defaults to the netloc of the URL and ``visit_order`` to the page id.
    """
    present = set(captures.columns)

    def column(name: str, type: str, default: Column | None = None) -> Column:
        if name not in present:
            return (F.lit(None) if default is None else default).cast(type).alias(name)
        given = F.col(name).cast(type)
        return (given if default is None else F.coalesce(given, default.cast(type))).alias(name)

    return captures.select(
        column("site", "string", site_of(F.col("url"))),
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        column("visit_order", "bigint", F.col("page_id")),
        column("depth", "int", F.lit(0)),
        column("status", "int", F.lit(200)),
        column("content_type", "string", F.lit("text/html")),
        column("headers", "map<string,string>"),
        column("html", "string"),
        column("error", "string"),
    )


def analyzable(responses: DataFrame) -> DataFrame:
    """Answered pages of a kind that is analysed; the rest is left out without an error."""
    kind = F.col("content_type")
    return responses.where(
        (F.col("status") == 200) & (F.contains(kind, F.lit("text/html")) | F.contains(kind, F.lit("javascript")))
    )


def with_first_pages(responses: DataFrame) -> DataFrame:
    """Add ``first_page``: whether a capture is the first analysable page of its site, by visit order.

    Captures stored with the column are returned as they are. For others the first pages are found on the narrow columns, with
    one number per site and task shuffled, and looked up by a join on the page id. That join moves the captures once where
    the sites are too many to be broadcast, so it belongs where captures are stored.
    """
    if "first_page" in responses.columns:
        return responses
    first = analyzable(responses).groupBy("site").agg(F.min_by("page_id", "visit_order").alias("page_id"))
    marked = responses.join(first.select("page_id", F.lit(True).alias("first_page")), "page_id", "left")
    return marked.select(*responses.columns, F.coalesce("first_page", F.lit(False)).alias("first_page"))


def errors(responses: DataFrame) -> DataFrame:
    """``(site, page_id, message)`` of captures that failed."""
    return responses.where(F.col("error").isNotNull()).select(
        "site", "page_id", F.concat(F.col("url"), F.lit(": "), F.col("error")).alias("message")
    )


def visited(responses: DataFrame, *documents: DataFrame) -> DataFrame:
    """``(site, url)``: every address visited once, with documents ``(site, url)`` that were answered."""
    rows = responses.select("site", "url")
    for document in documents:
        rows = rows.union(document.select("site", "url"))
    return rows.distinct()


def write_captures(responses: DataFrame, path: str) -> None:
    """Store captures with ``first_page``, first pages in files of their own.

    An audit of them reads each page once and looks nothing up; what concerns first pages alone reads only their files.
    """
    with_first_pages(responses).write.mode("overwrite").partitionBy("first_page").parquet(path)


def write_bucketed(responses: DataFrame, table: str, buckets: int) -> None:
    """Store captures bucketed by page, so that looking up single pages later moves no page.

    Buckets go by page and not by site, since one site may hold a large share of all pages.
    """
    responses.write.mode("overwrite").bucketBy(buckets, "page_id").sortBy("page_id").format("parquet").saveAsTable(table)
