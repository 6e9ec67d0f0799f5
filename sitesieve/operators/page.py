"""Derived columns that several extractors share, computed once per page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reuse import per_session
from ..functions.text import case_fold, find_all
from ..functions.urls import url_parts


@dataclass(frozen=True)
class Page:
    """What an extractor may use. Unused columns are pruned, so a run of one extractor computes only its own."""

    url: Column  # page URL as captured
    html: Column
    base: Column  # url_parts struct of the page URL
    lower: Column  # lower-cased html
    fold: Column  # html folded as ignore-case matching does
    scripts: Column  # bodies of script elements
    headers: Column  # map, lower-cased names
    raw_headers: Column  # map as captured
    header_lines: Column  # "name: value" lines


def page_columns() -> Page:
    return Page(
        url=F.col("url"),
        html=F.col("html"),
        base=F.col("base"),
        lower=F.col("lower"),
        fold=F.col("fold"),
        scripts=F.col("scripts"),
        headers=F.col("lower_headers"),
        raw_headers=F.col("headers"),
        header_lines=F.col("header_lines"),
    )


def quoted_segments(text: Column) -> Column:
    """Texts between neighbouring quote characters, in order.

    The first segment that contains (ends with) X is what a search for a quoted string containing (ending with) X
    finds, so one split serves any number of such searches.
    """
    segments = F.split(text, "[\"']")
    return F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 2, F.lit(0)))


def _lower_headers(headers: Column) -> Column:
    """Headers by lower-cased name; where two spellings of a name meet, the last one counts."""
    names = F.transform(F.map_keys(headers), F.lower)
    values = F.map_values(headers)

    def last_of_name(entry: Column, i: Column) -> Column:
        later = F.slice(names, i + 2, F.size(names))
        return ~F.array_contains(later, entry["name"])

    entries = F.filter(F.arrays_zip(names.alias("name"), values.alias("value")), last_of_name)
    return F.when(F.size(F.array_distinct(names)) == F.size(names), F.map_from_arrays(names, values)).otherwise(
        F.map_from_entries(entries)
    )


def _text_columns() -> list[Column]:
    html = F.coalesce(F.col("html"), F.lit(""))
    headers = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    names = [F.col(name) for name in ("site", "url", "page_id", "visit_order")]
    return [*names, html.alias("html"), headers.alias("headers"), F.lower(html).alias("lower")]


def _derived_columns() -> list[Column]:
    script_bodies = find_all(F.col("html"), r"<script[^>]*>((?s:.)*?)</script>", 1, ignore_case=True)
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return [
        F.col("*"),
        case_fold(F.col("html"), F.col("lower")).alias("fold"),
        F.when(F.contains(F.col("html"), F.lit("</")), script_bodies)
        .otherwise(F.array().cast("array<string>"))
        .alias("scripts"),
        _lower_headers(F.col("headers")).alias("lower_headers"),
        F.array_join(lines, "\n").alias("header_lines"),
        url_parts(F.col("url")).alias("base"),
    ]


def with_page_columns(responses: DataFrame, *more: str) -> DataFrame:
    """The responses with the columns of :class:`Page`, and ``more`` of their own."""
    texts = responses.select(*per_session("text_columns", _text_columns), *more)
    return texts.select(*per_session("derived_columns", _derived_columns))
