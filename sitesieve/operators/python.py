"""Extractors written as Python functions. Their failures become error rows instead of ending the job."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import registry
from .candidates import CANDIDATES
from .page import Page

PageFunction = Callable[[str, str, dict[str, str]], Iterable[dict[str, Any]]]


def register_function(name: str, function: PageFunction, *, in_audit: bool = True, first_page_only: bool = False) -> None:
    """Add an extractor that is called with a page's URL, text and headers, by lower-cased name, and yields findings.

    A finding is a dict with ``value`` and, if they differ from the defaults, ``type`` ("info"), ``source`` (the name),
    ``severity`` ("info"), ``context`` ("") and ``metadata``. Pages travel to Python in Arrow batches; column functions need no
    such way and are to be preferred. Where the function raises, the page has no finding of this extractor and one
    row in ``extract.errors``.
    """

    def finding(place: int, given: dict[str, Any]) -> tuple:
        unknown = set(given) - {"value", "type", "source", "severity", "context", "metadata"}
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        metadata = [(str(k), None if v is None else str(v)) for k, v in (given.get("metadata") or {}).items()]
        return (
            0, place, given.get("type", "info"), given.get("source", name), given.get("severity", "info"), str(given["value"]),
            False, given.get("context", ""), 0, False, None, metadata,
        )

    def run(url: str, html: str, headers: dict[str, str] | None) -> tuple:
        try:
            return [finding(i, x) for i, x in enumerate(function(url, html, headers or {}))], None
        except Exception as error:  # whatever a user's function raises
            return [], f"{url}:{name}: {error}"

    called = F.udf(run, f"struct<found:{CANDIDATES},error:string>", useArrow=True)

    def results(page: Page) -> Column:
        return called(page.url, page.html, page.headers)

    registry.register(
        name,
        lambda page: results(page)["found"],
        in_audit=in_audit,
        first_page_only=first_page_only,
        failed=lambda page: results(page)["error"],
    )
