"""Run extractors over responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reuse import per_session
from ..functions.text import case_fold
from . import registry
from .candidates import explode_candidates, merge_candidates, no_candidates
from .page import page_columns, with_page_columns
from .technology import detect, searched_text

_KEYS = ("site", "url", "page_id", "visit_order")
_USES_TECHNOLOGY = {"fingerprint", "wordpress", "technology_hints"}


def with_technologies(pages: DataFrame, first_only: bool = False) -> DataFrame:
    """Add the technologies of each page, or of first pages alone, as an array in signature order."""
    text = searched_text(page_columns())
    text = F.when(F.col("first_page"), text) if first_only else text
    searched = pages.select("*", text.alias("searched"), F.lower(text).alias("searched_lower"))
    folded = searched.select("*", case_fold(F.col("searched"), F.col("searched_lower")).alias("searched_fold"))
    detected = per_session("technologies", lambda: detect(F.col("searched"), F.col("searched_fold")))
    detected = F.when(F.col("first_page"), detected) if first_only else detected
    return folded.select("*", detected.alias("technologies"))


def extract(responses: DataFrame, extractors: Sequence[str], on_first_pages: Sequence[str] = ()) -> DataFrame:
    """Findings of the named extractors on every row of ``responses``. Narrow: no data moves between tasks.

    Those among ``on_first_pages`` run on rows with ``first_page`` only, in the same pass over the pages.
    """
    gated = frozenset(on_first_pages)
    pages = with_page_columns(responses, *(["first_page"] if gated else []))
    users = _USES_TECHNOLOGY & set(extractors)
    if users:
        pages = with_technologies(pages, users <= gated)
    entries = tuple(sorted((registry.entry(name) for name in extractors), key=lambda e: e.order))
    on_first = tuple(registry.entry(name) for name in extractors if name in gated)

    def candidates() -> Column:
        page = page_columns()
        arrays = [(e.order, per_session(e, lambda e=e: e.extract(page))) for e in entries]
        arrays = [
            (e.order, F.when(F.col("first_page"), found).otherwise(no_candidates()) if e in on_first else found)
            for e, (_, found) in zip(entries, arrays, strict=True)
        ]
        return merge_candidates(arrays, page.base)

    return explode_candidates(pages, per_session((entries, on_first), candidates), _KEYS)


def errors(responses: DataFrame, extractors: Sequence[str]) -> DataFrame:
    """``(site, page_id, message)``: a row for each page and extractor of the named ones that fails on it."""
    shape = "site string, page_id bigint, message string"
    page = page_columns()
    messages = [e.failed(page) for e in map(registry.entry, extractors) if e.failed is not None]
    if not messages:
        return responses.sparkSession.createDataFrame([], shape)
    pages = with_page_columns(responses).select("site", "page_id", F.array(*messages).alias("messages"))
    return pages.select("site", "page_id", F.explode(F.array_compact("messages")).alias("message"))


def technologies(responses: DataFrame) -> DataFrame:
    """``(site, page_id, name, category, version)``, one row per technology of a response."""
    pages = with_technologies(with_page_columns(responses))
    # An expression and not the bare column is exploded, for the reason given in explode_candidates.
    listed = F.transform("technologies", lambda t: t.dropFields("evidence"))
    rows = pages.select("site", "page_id", F.explode(listed).alias("t"))
    return rows.select("site", "page_id", F.col("t.ord").alias("ord"), "t.name", "t.category", "t.version")
