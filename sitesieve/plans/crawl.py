"""The audit of what a crawl reaches: pages within a number of links, of pages and of the site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.documents import fetched_sitemaps, sitemap_urls
from .audit import audit, sitemap_plan
from .reachability import link_table, reachable, start_pages


def reached(
    responses: DataFrame,
    robots: DataFrame | None = None,
    sitemaps: DataFrame | None = None,
    *,
    max_depth: int | None = None,
    max_pages: int | None = None,
    follow_external: bool = False,
    check_robots: bool = True,
    check_sitemap: bool = True,
) -> DataFrame:
    """The captures whose address a breadth-first crawl from the first capture of each site reaches.

    Addresses in sitemaps enter after the start page. A page that several sites reach by external links is a row of each of them.
    Addresses are found on the links alone; the captures meet them in one join on the address, whose small side is the
    addresses.
    """
    listed = None
    if sitemaps is not None:
        plan = sitemap_plan(responses, robots, check_robots=check_robots, check_sitemap=check_sitemap)
        if plan is not None:
            entries = sitemap_urls(fetched_sitemaps(plan, sitemaps))
            # One sitemap after the other.
            listed = entries.select("site", "url", (F.shiftleft(F.col("position").cast("bigint"), 32) + F.col("pos")).alias("pos"))
    links = link_table(responses, follow_external)
    found = reachable(start_pages(responses), links, listed, max_depth=max_depth, max_pages=max_pages).select("site", "url")
    if not follow_external:
        return responses.join(found, ["site", "url"], "left_semi").select(*responses.columns)
    # Whether a page is a site's first was found for its own site and may not hold for one that reaches it.
    kept = [c for c in responses.columns if c != "first_page"]
    return responses.drop("site", "first_page").join(found, "url").select(*kept)


def audit_reached(
    responses: DataFrame,
    robots: DataFrame | None = None,
    sitemaps: DataFrame | None = None,
    *,
    max_depth: int | None = None,
    max_pages: int | None = None,
    follow_external: bool = False,
    check_robots: bool = True,
    check_sitemap: bool = True,
) -> DataFrame:
    """Findings of every site on the pages that a crawl with these options reaches."""
    checks = {"check_robots": check_robots, "check_sitemap": check_sitemap}
    pages = reached(
        responses, robots, sitemaps, max_depth=max_depth, max_pages=max_pages, follow_external=follow_external, **checks
    )
    return audit(pages, robots, sitemaps, **checks)
