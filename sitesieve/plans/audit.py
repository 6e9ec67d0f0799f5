"""The site audit: pages to findings, each finding once per site."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import registry
from ..operators.documents import fetched_sitemaps, robots_findings, sitemap_findings, sitemap_requests
from ..operators.extract import errors, extract, technologies
from ..schema import FINDING_COLUMNS, FINDING_ORDER
from ..sources.captures import analyzable, with_first_pages


def first_pages(pages: DataFrame) -> DataFrame:
    """The first page of every site, by visit order.

    Captures stored by ``write_captures`` have them in files of their own. For others they are found on the narrow columns
    alone, with one number per site and task shuffled, and looked up by a semi join on the page id, which moves pages where
    the sites are too many to be broadcast; captures bucketed by page are not moved.
    """
    if "first_page" in pages.columns:
        return pages.where("first_page")
    first = pages.groupBy("site").agg(F.min_by("page_id", "visit_order").alias("page_id"))
    return pages.join(first.select("page_id"), "page_id", "left_semi").select(*pages.columns)


def page_findings(pages: DataFrame) -> DataFrame:
    """All findings of the audit on analyzable pages, repeated ones included. Every page is read once."""
    return extract(
        with_first_pages(pages),
        registry.names(in_audit=True),
        on_first_pages=registry.names(in_audit=True, first_page_only=True),
    )


def extractor_errors(responses: DataFrame) -> DataFrame:
    """``(site, page_id, message)`` of the audit's extractors that fail on a page."""
    pages = with_first_pages(analyzable(responses))
    every = errors(pages, registry.names(in_audit=True, first_page_only=False))
    return every.unionByName(errors(pages.where("first_page"), registry.names(in_audit=True, first_page_only=True)))


def deduplicate(findings: DataFrame) -> DataFrame:
    """The first finding per site, type, value and source. Pre-aggregated before the shuffle."""
    order = F.struct(*FINDING_ORDER)
    rest = [c for c in FINDING_COLUMNS if c not in ("site", "type", "value", "source")]
    first = findings.groupBy("site", "type", "value", "source").agg(
        F.min_by(F.struct(*rest), order).alias("first")
    )
    return first.select("site", "type", "value", "source", "first.*").select(*FINDING_COLUMNS)


def target_urls(responses: DataFrame) -> DataFrame:
    """``(site, base_url)``: scheme and host of the first capture of a site, where its documents are looked up."""
    secure = F.lower("url").startswith("https:")
    first = responses.groupBy("site").agg(F.min_by(secure, "visit_order").alias("secure"))
    scheme = F.when(F.col("secure"), "https://").otherwise("http://")
    return first.select("site", F.concat(scheme, F.col("site")).alias("base_url"))


def audit(
    responses: DataFrame,
    robots: DataFrame | None = None,
    sitemaps: DataFrame | None = None,
    *,
    check_robots: bool = True,
    check_sitemap: bool = True,
) -> DataFrame:
    """Findings of every site, each once: documents first, then pages in visit order."""
    parts = [page_findings(analyzable(responses))]
    if robots is not None and check_robots:
        parts.append(robots_findings(robots))
    if sitemaps is not None:
        requests = sitemap_plan(responses, robots, check_robots=check_robots, check_sitemap=check_sitemap)
        if requests is not None:
            parts.append(sitemap_findings(fetched_sitemaps(requests, sitemaps)))
    return deduplicate(reduce(DataFrame.unionByName, parts))


def sitemap_plan(
    responses: DataFrame, robots: DataFrame | None, *, check_robots: bool = True, check_sitemap: bool = True
) -> DataFrame | None:
    """The sitemaps an audit looks up, or None if it looks up none."""
    sites = target_urls(responses)
    if not check_sitemap:
        sites = sites.limit(0)
        if robots is None or not check_robots:
            return None
    if robots is None or not check_robots:
        spark = responses.sparkSession
        robots = spark.createDataFrame([], "site string, base_url string, content string")
    return sitemap_requests(robots, sites)


def site_technologies(responses: DataFrame) -> DataFrame:
    """The technology stack of every site, as found on its first page."""
    return technologies(first_pages(analyzable(responses)))
