"""robots.txt and sitemap documents, read before any page of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reuse import per_session
from ..functions.text import contains_any, find_all, find_groups, strip
from ..functions.urls import site_of, url_join, url_parts
from ..schema import ROBOTS_VISIT, SITEMAP_VISIT
from .candidates import each, explode_candidates, merge_candidates, prefixed, together

# Patterns and words. Blanks after a keyword may span lines, as in the pattern language they come from.
DISALLOW = r"Disallow:\s*(.+)"
SITEMAP = r"Sitemap:\s*(\S+)"
REMARK = r"#\s*(.+)"
REMARK_WORDS = ("api", "admin", "debug", "test", "internal", " staging")
LOCATION = r"<loc>\s*(.*?)\s*</loc>"
#: Place of a site's default sitemap: after all that robots.txt names.
LAST = 2**31 - 1

_KEYS = ("site", "url", "page_id", "visit_order")


def robots_findings(robots: DataFrame) -> DataFrame:
    """Disallowed paths, sitemap lines and telling remarks of robots.txt documents ``(site, base_url, content)``."""
    documents = robots.select(
        "site",
        F.col("base_url").alias("url"),
        F.lit(0).cast("bigint").alias("page_id"),
        F.lit(ROBOTS_VISIT).cast("bigint").alias("visit_order"),
        F.coalesce("content", F.lit("")).alias("content"),
        url_parts(F.col("base_url")).alias("base"),
    )
    return explode_candidates(documents, per_session("robots", _robots_candidates), _KEYS)


def _robots_candidates() -> Column:
    content = F.col("content")
    disallowed = each(
        F.transform(find_all(content, DISALLOW, 1, ignore_case=True), strip),
        keep=lambda path: ~path.isin("", "/"),
        type="endpoint",
        source="robots_disallow",
        severity="low",
        value=lambda path: path,
        resolve=True,
        context=lambda path: prefixed("Blocked by robots.txt: Disallow: ", path),
    )
    sitemaps = each(
        find_groups(content, SITEMAP, ignore_case=True),
        rule=1,
        type="endpoint",
        source="robots_sitemap",
        value=lambda m: m["g1"],
        context=lambda m: prefixed("Sitemap reference: ", m["g0"]),
    )
    remarks = each(
        F.transform(find_all(content, REMARK, 1), strip),
        keep=lambda text: contains_any(F.lower(text), *REMARK_WORDS),
        rule=2,
        type="info",
        source="robots_comment",
        severity="low",
        value=lambda text: text,
        context=lambda text: prefixed("Interesting robots.txt comment: ", text),
    )
    return merge_candidates([(0, together(disallowed, sitemaps, remarks))], F.col("base"))


def _first(found: Column, limit: int | None) -> Column:
    return found if limit is None else F.slice(found, F.lit(1), F.lit(limit))


def sitemap_requests(robots: DataFrame, sites: DataFrame, limit: int | None = None) -> DataFrame:
    """``(site, sitemap_url, position)``: the sitemaps robots.txt names, then the default address of every site.

    ``sites`` is ``(site, base_url)``. ``limit`` keeps the first so many of a robots.txt, as a polite fetcher would.
    """
    named = _first(find_all(F.col("content"), SITEMAP, 1, ignore_case=True), limit)
    listed = robots.select("site", F.posexplode(named).alias("position", "sitemap_url"))
    default = sites.select(
        "site",
        F.lit(LAST).alias("position"),
        url_join(url_parts(F.col("base_url")), F.lit("/sitemap.xml")).alias("sitemap_url"),
    )
    return listed.select("site", "sitemap_url", "position").union(default.select("site", "sitemap_url", "position"))


def fetched_sitemaps(requests: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """Requests that were answered, with content. A sitemap requested twice is read twice."""
    answered = sitemaps.where("status = 200").select("site", "sitemap_url", "content")
    return requests.join(answered, ["site", "sitemap_url"])


def _locations() -> Column:
    return find_all(F.coalesce("content", F.lit("")), LOCATION, 1)


def sitemap_urls(fetched: DataFrame, limit: int | None = None) -> DataFrame:
    """``(site, sitemap_url, position, pos, url)``: listed pages of the own site, in order; of the first ``limit`` listed."""
    first = _first(_locations(), limit)
    rows = fetched.select("site", "sitemap_url", "position", F.posexplode(first).alias("pos", "url"))
    return rows.where(site_of(F.col("url")) == F.col("site"))


def sitemap_findings(fetched: DataFrame, limit: int | None = None) -> DataFrame:
    """One finding per sitemap that lists pages of the site among the first ``limit``, with their number."""
    counted = fetched.select(
        "site",
        F.col("sitemap_url").alias("url"),
        "position",
        F.size(_locations()).alias("parsed"),
        F.size(F.filter(_first(_locations(), limit), lambda u: site_of(u) == F.col("site"))).alias("queued"),
    ).where("queued > 0")
    return counted.select(
        "site",
        "url",
        F.lit(0).cast("bigint").alias("page_id"),
        F.lit("endpoint").alias("type"),
        F.concat(F.col("queued").cast("string"), F.lit(" URLs from sitemap")).alias("value"),
        F.lit("sitemap").alias("source"),
        F.lit("info").alias("severity"),
        F.format_string("Parsed %d URLs, queued %d for crawling", "parsed", "queued").alias("context"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
        F.lit(SITEMAP_VISIT).cast("bigint").alias("visit_order"),
        F.lit(0).alias("extractor_ord"),
        F.lit(0).alias("rule_ord"),
        F.col("position").alias("match_ord"),
    )
