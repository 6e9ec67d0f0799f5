"""Summaries, scores and report tables over deduplicated findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import FINDING_ORDER, ISSUE_SEVERITIES, SECTION_TYPES, SECURITY_TYPES, SEVERITIES
from .numbering import number_rows


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for info."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int") - 1


def counts(findings: DataFrame) -> DataFrame:
    """``(site, type, severity, findings)``: per site, per site and type, and per site and severity.

    The dimension a row does not count by is NULL. What does not occur has no row.
    """
    return (
        findings.groupingSets([("site", "type"), ("site", "severity"), ("site",)], "site", "type", "severity")
        .agg(F.count("*").alias("findings"))
        .select("site", "type", "severity", "findings")
    )


def summary(findings: DataFrame, visited: DataFrame, errors: DataFrame) -> DataFrame:
    """One row per site: total, counts by type and by severity as maps, pages visited, errors."""
    long = counts(findings)

    def as_map(key: str) -> Column:
        entry = F.when(F.col(key).isNotNull(), F.struct(key, "findings"))
        # One entry per type or severity, so the list is short whatever the site.
        return F.map_from_entries(F.sort_array(F.collect_list(entry)))

    total = F.max(F.when(F.col("type").isNull() & F.col("severity").isNull(), F.col("findings")))
    per_site = long.groupBy("site").agg(
        total.alias("total_findings"), as_map("type").alias("by_type"), as_map("severity").alias("by_severity")
    )
    pages = visited.groupBy("site").agg(F.count("*").alias("urls_visited"))
    failed = errors.groupBy("site").agg(F.count("*").alias("errors"))
    joined = pages.join(per_site, "site", "full").join(failed, "site", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "site",
        F.coalesce("total_findings", zero).alias("total_findings"),
        F.coalesce("urls_visited", zero).alias("urls_visited"),
        "by_type",
        "by_severity",
        F.coalesce("errors", zero).alias("errors"),
    )


def rating(score: Column) -> Column:
    return (
        F.when(score >= 95, "A+")
        .when(score >= 85, "A")
        .when(score >= 70, "B")
        .when(score >= 50, "C")
        .when(score >= 30, "D")
        .otherwise("F")
    )


def scores(findings: DataFrame) -> DataFrame:
    """``(site, score, rating)``: 100 less 20 per critical, 8 per high and 2 per medium finding, at most five of these."""

    def number(severity: str) -> Column:
        return F.count_if(F.col("severity") == severity)

    loss = number("critical") * 20 + number("high") * 8 + F.least(number("medium"), F.lit(5)) * 2
    scored = findings.groupBy("site").agg(F.greatest(F.lit(100) - loss, F.lit(0)).cast("bigint").alias("score"))
    return scored.select("site", "score", rating(F.col("score")).alias("rating"))


def deductions(findings: DataFrame, limit: int = 20) -> DataFrame:
    """``(site, position, deduction)``: what the score was reduced for, the first ``limit`` in finding order.

    Only as many findings per site as can be listed reach the shuffle: the first ``limit`` serious ones and the first
    five medium ones.
    """
    by_severity = F.col("severity")
    points = F.when(by_severity == "critical", "-20: ").when(by_severity == "high", "-8: ").otherwise("-2: ")
    candidates = findings.where(by_severity.isin(*ISSUE_SEVERITIES)).select(
        "site",
        (by_severity == "medium").alias("medium"),
        *FINDING_ORDER,
        F.concat(points, F.substring("value", 1, 60)).alias("deduction"),
    )
    place = F.row_number().over(W.partitionBy("site", "medium").orderBy(*FINDING_ORDER))
    listed = candidates.withColumn("place", place).where(F.col("place") <= max(limit, 5))
    listed = listed.where(~F.col("medium") | (F.col("place") <= 5))
    overall = F.row_number().over(W.partitionBy("site").orderBy(*FINDING_ORDER))
    return (
        listed.withColumn("position", overall.cast("bigint"))
        .where(F.col("position") <= limit)
        .select("site", "position", "deduction")
    )


def security_scores(findings: DataFrame, limit: int = 20) -> DataFrame:
    """``(site, score, rating, deductions)`` with the deductions as an array in order."""
    listed = deductions(findings, limit).groupBy("site").agg(
        F.sort_array(F.collect_list(F.struct("position", "deduction"))).alias("listed")
    )
    empty = F.array().cast("array<string>")
    return (
        scores(findings)
        .join(listed, "site", "left")
        .select(
            "site",
            "score",
            "rating",
            F.coalesce(F.transform("listed", lambda d: d["deduction"]), empty).alias("deductions"),
        )
    )


def issues(findings: DataFrame, limit: int | None = 25, value_length: int = 50, context_length: int = 40) -> DataFrame:
    """Findings of medium severity and above, by severity and then in finding order.

    With a limit, the first so many per site; tasks drop what cannot be among them before the shuffle. Without, all of
    them (the Markdown report lists all, with 60 characters of value and context), in sorted order.
    """
    rank = severity_rank(F.col("severity"))
    chosen = findings.where(F.col("severity").isin(*ISSUE_SEVERITIES)).withColumn("rank", rank)
    columns = [
        "site",
        "severity",
        "type",
        F.substring("value", 1, value_length).alias("value"),
        F.substring("context", 1, context_length).alias("context"),
    ]
    if limit is None:
        return chosen.orderBy("site", "rank", *FINDING_ORDER).select(*columns)
    place = F.row_number().over(W.partitionBy("site").orderBy("rank", *FINDING_ORDER))
    first = chosen.withColumn("position", place.cast("bigint")).where(F.col("position") <= limit)
    return first.select("position", *columns)


def section(type: Column) -> Column:
    return F.when(type.isin(*SECURITY_TYPES), "Security Issues").otherwise("Surface Findings")


def section_counts(findings: DataFrame) -> DataFrame:
    """``(site, section, type, findings)``."""
    return findings.groupBy("site", section(F.col("type")).alias("section"), "type").agg(
        F.count("*").alias("findings")
    )


def section_listing(findings: DataFrame, context_length: int = 100) -> DataFrame:
    """Findings of the text report: security issues, then the rest, in finding order."""
    ordered = findings.withColumn("section", section(F.col("type"))).orderBy("site", "section", *FINDING_ORDER)
    return ordered.select(
        "site", "section", "severity", "type", "value", F.substring("context", 1, context_length).alias("context")
    )


def severity_breakdown(findings: DataFrame) -> DataFrame:
    """``(site, severity, findings, breakdown)`` with the types of a severity as text, by name."""
    by_type = findings.groupBy("site", "severity", "type").agg(F.count("*").alias("n"))
    entry = F.concat(F.col("type"), F.lit(":"), F.col("n").cast("string"))
    return by_type.groupBy("site", "severity").agg(
        F.sum("n").alias("findings"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("type", entry.alias("text")))), lambda e: e["text"]), ", "
        ).alias("breakdown"),
    )


def tiles(findings: DataFrame) -> DataFrame:
    """``(site, total, critical_high, medium)``: the figures on top of the HTML report."""
    severity = F.col("severity")
    return findings.groupBy("site").agg(
        F.count("*").alias("total"),
        F.count_if(severity.isin("critical", "high")).alias("critical_high"),
        F.count_if(severity == "medium").alias("medium"),
    )


def report_sections(findings: DataFrame) -> DataFrame:
    """Rows of the HTML report: nine types in fixed order, each by severity, numbered within site and type."""
    place = F.array_position(F.array(*[F.lit(t) for t in SECTION_TYPES]), F.col("type")).cast("int")
    rows = (
        findings.where(F.col("type").isin(*SECTION_TYPES))
        .withColumn("section", place)
        .withColumn("rank", severity_rank(F.col("severity")))
        .select("site", "section", "type", "rank", *FINDING_ORDER, "severity", "value", "source", "context")
    )
    numbered = number_rows(rows, ["site", "section"], ["rank", *FINDING_ORDER])
    return numbered.select(
        "site",
        "section",
        "type",
        "position",
        "severity",
        F.substring("value", 1, 120).alias("value"),
        "source",
        F.substring("context", 1, 90).alias("context"),
    )


def pages_listing(visited: DataFrame) -> DataFrame:
    """``(site, position, page)``: visited addresses by name, numbered from 1."""
    return number_rows(visited.select("site", "url"), ["site"], ["url"]).select(
        "site", "position", F.substring("url", 1, 80).alias("page")
    )


def json_reports(
    findings: DataFrame,
    visited: DataFrame,
    errors: DataFrame,
    technologies: DataFrame,
    tool: str = "sitesieve",
    version: str = "0.1.0",
) -> DataFrame:
    """One nested row per site for the JSON sink: meta, technology stack.

    The findings and errors of a site are unbounded and go to their own sorted tables (:func:`json_findings`), not into
    one array: a document per site would pass a large site through one task.
    """
    stack = technologies.groupBy("site").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("ord", "name", "category", "version"))),
            lambda t: F.struct(t["name"].alias("name"), t["category"].alias("category"), t["version"].alias("version")),
        ).alias("tech_stack")
    )
    joined = summary(findings, visited, errors).join(security_scores(findings), "site", "left").join(stack, "site", "left")
    return joined.select(
        "site",
        F.struct(
            F.lit(tool).alias("tool"),
            F.lit(version).alias("version"),
            F.current_timestamp().alias("timestamp"),
            F.col("site").alias("target"),
            "total_findings",
            "urls_visited",
            "by_type",
            "by_severity",
            "errors",
            F.struct("score", "rating", "deductions").alias("security_score"),
        ).alias("meta"),
        F.coalesce(
            "tech_stack", F.array().cast("array<struct<name:string,category:string,version:string>>")
        ).alias("tech_stack"),
    )


def json_findings(findings: DataFrame) -> DataFrame:
    """Findings as they stand in the JSON report, sorted by site and finding order."""
    return findings.orderBy("site", *FINDING_ORDER).select(
        "site", "type", "url", "value", "source", "severity", "context", "metadata"
    )
