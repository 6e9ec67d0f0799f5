"""A whole audit to storage: findings are computed once, and every report reads the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.documents import fetched_sitemaps
from ..sources.captures import errors, visited
from ..sources.storage import write_findings, write_reports
from . import reports as rp
from .audit import audit, extractor_errors, site_technologies, sitemap_plan


def visited_addresses(
    responses: DataFrame,
    robots: DataFrame | None = None,
    sitemaps: DataFrame | None = None,
    *,
    check_robots: bool = True,
    check_sitemap: bool = True,
) -> DataFrame:
    """``(site, url)`` of every capture and of every document that was asked for and answered."""
    documents = []
    if robots is not None and check_robots:
        documents.append(robots.select("site", F.concat("base_url", F.lit("/robots.txt")).alias("url")))
    if sitemaps is not None:
        plan = sitemap_plan(responses, robots, check_robots=check_robots, check_sitemap=check_sitemap)
        if plan is not None:
            documents.append(fetched_sitemaps(plan, sitemaps).select("site", F.col("sitemap_url").alias("url")))
    return visited(responses.select("site", "url"), *documents)


#: Tables made of the stored findings alone, by name.
TABLES = {
    "scores": rp.security_scores,
    "issues": rp.issues,
    "severities": rp.severity_breakdown,
    "deductions": rp.deductions,
    "tiles": rp.tiles,
    "section_counts": rp.section_counts,
    "section_listing": rp.section_listing,
    "report_sections": rp.report_sections,
}


def run(
    responses: DataFrame,
    folder: str,
    robots: DataFrame | None = None,
    sitemaps: DataFrame | None = None,
    *,
    check_robots: bool = True,
    check_sitemap: bool = True,
) -> dict[str, str]:
    """Audit ``responses`` and write findings, technologies, visited addresses, errors and all report tables below ``folder``.

    The captures are read for the findings, the first pages and the addresses, never once per report; to bound an audit by a
    crawl, give it the captures that ``crawl.reached`` keeps.
    """
    spark = responses.sparkSession
    written = ("findings", "technologies", "visited", "errors", "reports", "summary", "pages", *TABLES)
    paths = {name: f"{folder}/{name}" for name in written}
    checks = {"check_robots": check_robots, "check_sitemap": check_sitemap}

    def write(frame: DataFrame, name: str) -> None:
        frame.write.mode("overwrite").parquet(paths[name])

    write_findings(audit(responses, robots, sitemaps, **checks), paths["findings"])
    write(site_technologies(responses), "technologies")
    write(visited_addresses(responses, robots, sitemaps, **checks), "visited")
    write(errors(responses).unionByName(extractor_errors(responses)), "errors")

    findings, addresses, failed, technologies = (
        spark.read.parquet(paths[name]) for name in ("findings", "visited", "errors", "technologies")
    )
    for name, table in TABLES.items():
        write(table(findings), name)
    write(rp.summary(findings, addresses, failed), "summary")
    write(rp.pages_listing(addresses), "pages")
    write_reports(rp.json_reports(findings, addresses, failed, technologies), paths["reports"])
    return paths
