"""One query per operator over the given tables, with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesieve.functions.encoding import base64_text
from sitesieve.functions.text import cut, find_all, strip
from sitesieve.functions.urls import query_pairs, url_join, url_parts
from sitesieve.operators.documents import (
    fetched_sitemaps,
    robots_findings,
    sitemap_findings,
    sitemap_requests,
    sitemap_urls,
)
from sitesieve.operators import registry
from sitesieve.operators.extract import errors as extractor_failures
from sitesieve.operators.extract import extract
from sitesieve.operators.links import page_links, tag_links
from sitesieve.operators.page import quoted_segments
from sitesieve.operators.python import register_function
from sitesieve.plans import audit as au
from sitesieve.plans import reachability as re_
from sitesieve.plans import reports as rp
from sitesieve.plans.crawl import audit_reached
from sitesieve.sources import captures as ca
from sitesieve.sources.storage import settle

from . import oracle as o
from . import overlay as ov

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PAGE_COLUMNS = ("page_id", "type", "value", "source", "severity", "context")
SITE_COLUMNS = ("site", "type", "value", "source", "severity", "context")


def add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


# Extractor rules: query, extractor, source and, where two rules share a source, the rule's number.
RULES = (
    ("endpoints_html_attribute", "endpoints", "html_attribute"),
    ("endpoints_inline_script", "endpoints", "inline_script"),
    ("endpoints_template_literal", "endpoints", "template_literal"),
    ("scripts_src", "scripts", "script_src"),
    ("scripts_dynamic_import", "scripts", "dynamic_import"),
    ("scripts_inline_analysis", "scripts", "inline_script_analysis"),
    ("api_routes_wp_urls", "api_routes", "wordpress_rest_api", 0),
    ("api_routes_wp_paths", "api_routes", "wordpress_rest_api", 1),
    ("api_routes_rest_path", "api_routes", "rest_api_path"),
    ("api_routes_link_tag", "api_routes", "api_link_tag"),
    ("api_routes_graphql", "api_routes", "graphql_reference"),
    ("api_routes_websocket", "api_routes", "websocket"),
    ("api_routes_config_object", "api_routes", "config_object"),
    ("api_routes_fetch_call", "api_routes", "fetch_call"),
    ("api_routes_xhr_request", "api_routes", "xhr_request"),
    ("params_form_input", "parameters", "form_input"),
    ("params_url_query", "parameters", "url_query"),
    ("params_json_body", "parameters", "json_body"),
    ("params_browser_storage", "parameters", "browser_storage"),
    ("params_path", "parameters", "path_parameter"),
    ("params_header", "parameters", "header_parameter"),
    ("tech_fingerprint_cms", "fingerprint", "fingerprint_cms"),
    ("tech_fingerprint_framework", "fingerprint", "fingerprint_framework"),
    ("tech_fingerprint_library", "fingerprint", "fingerprint_library"),
    ("tech_fingerprint_server", "fingerprint", "fingerprint_server"),
    ("tech_fingerprint_language", "fingerprint", "fingerprint_language"),
    ("tech_fingerprint_analytics", "fingerprint", "fingerprint_analytics"),
    ("tech_fingerprint_cdn", "fingerprint", "fingerprint_cdn"),
    ("wordpress_plugins", "wordpress", "wordpress_plugin_enum"),
    ("wordpress_themes", "wordpress", "wordpress_theme_enum"),
    ("wordpress_version", "wordpress", "wordpress_version"),
    ("wordpress_xmlrpc", "wordpress", "wordpress_xmlrpc"),
    ("wordpress_rest_api", "wordpress", "wordpress_rest_api"),
    ("tech_hints", "technology_hints", "tech_hint"),
    ("headers_required_missing", "security_headers", "missing_security_header"),
    ("headers_required_weak", "security_headers", "weak_security_header"),
    ("cors_exact_wildcard", "cors", "cors_wildcard"),
    ("cors_exact_credentials", "cors", "cors_credentials"),
    ("cookies_flags", "cookies", "cookie_analysis"),
    ("cookies_session", "cookies", "insecure_session_cookie"),
    ("files_sensitive", "sensitive_files", "sensitive_file_reference"),
    ("files_environment", "sensitive_files", "env_reference"),
    ("waf_detection", "firewall", "waf_detection"),
    ("source_maps_declared", "source_maps", "source_map"),
    ("source_maps_referenced", "source_maps", "source_map_reference"),
    ("csp_weakness", "content_policy", "csp_weakness"),
    ("csp_wildcard", "content_policy", "csp_wildcard"),
    ("csp_missing", "content_policy", "csp_missing"),
    ("headers_disclosure", "audit_headers", "info_disclosure"),
    ("headers_server_version", "audit_headers", "version_disclosure"),
    ("headers_missing", "audit_headers", "missing_header"),
    ("headers_weak", "audit_headers", "weak_header"),
    ("headers_cors_wildcard", "audit_headers", "cors_wildcard"),
    ("headers_cors_credentials", "audit_headers", "cors_credentials"),
    ("cookies_insecure", "audit_headers", "insecure_cookie"),
    ("files_directory_listing", "directory_listing", "directory_listing"),
    ("files_backup", "backup_files", "backup_file"),
    ("debug_endpoints", "debug_endpoints", "debug_endpoint"),
    ("redirects_form", "open_redirects", "open_redirect"),
    ("redirects_script", "open_redirects", "open_redirect_js"),
    ("js_url_credentials", "script_secrets", "js_url_credentials"),
    ("js_base64_secrets", "script_secrets", "js_base64_secret"),
    ("js_risky_calls", "script_secrets", "js_analysis"),
    ("subdomains_html", "subdomains", "html_subdomain"),
    ("subdomains_email", "subdomains", "email_subdomain"),
    ("subdomains_comment", "subdomains", "comment_subdomain"),
    ("subdomains_json", "subdomains", "json_subdomain"),
    ("graphql_detection", "graphql", "graphql_detection"),
    ("html_comments", "comments", "html_comment"),
    ("jwt_analysis", "tokens", "jwt_analysis"),
    ("jwt_unsigned", "tokens", "jwt_vulnerability"),
    ("jwt_hints", "tokens", "jwt_hint"),
    ("forms_file_upload", "forms", "file_upload"),
    ("forms_csrf", "forms", "csrf_token"),
    ("forms_many", "forms", "form_analysis"),
    ("secrets_format", "secrets", "secret_format"),
    ("secrets_variable", "secrets", "secret_variable"),
)


def _rule_query(extractor: str, source: str, rule: int | None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = extract(ov.responses(spark, sf_dir), [extractor]).where(F.col("source") == source)
        if rule is not None:
            found = found.where(F.col("rule_ord") == rule)
        return found.select(*PAGE_COLUMNS)

    return query


for key, extractor_name, source_name, *rule_number in RULES:
    number = rule_number[0] if rule_number else None
    statement = o.extractor_sql(extractor_name, [source_name])
    add(
        key,
        _rule_query(extractor_name, source_name, number),
        statement if number is None else f"{statement} AND ro = {number}",
    )


# Captures
add(
    "responses_scan",
    lambda spark, sf: ov.responses(spark, sf).select("page_id", "site", "url", F.length("html").alias("size")),
    f"WITH {o.prelude()} SELECT page_id, site, url, length(html) AS size FROM r",
)
add(
    "responses_analyzable",
    lambda spark, sf: ca.analyzable(ov.responses(spark, sf)).select("page_id", "status", "content_type"),
    f"WITH {o.prelude()} SELECT page_id, status, content_type FROM ok",
)
add(
    "capture_errors",
    lambda spark, sf: ca.errors(ov.responses(spark, sf)),
    f"WITH {o.prelude()} SELECT site, page_id, url || ': ' || error AS message FROM r WHERE error IS NOT NULL",
)
add(
    "first_pages",
    lambda spark, sf: au.first_pages(ca.analyzable(ov.responses(spark, sf))).select("site", "page_id"),
    f"WITH {o.prelude()} SELECT site, page_id FROM firsts",
)

# Links
_LINKS = (
    # One search for whole constructs: comments and raw text are taken with all that is in them.
    "tags AS (SELECT * EXCLUDE (l), unnest(l) AS tag, unnest(range(len(l))) AS i FROM (SELECT page_id, url, site, scheme, "
    "origin, path, folder, list_filter(regexp_extract_all(html, '(?is)<!--(?:.*?-->|.*)|<script\\b(?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*"
    ">.*?</script>|<style\\b[^>]*>.*?</style>|<[a-z](?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>', 0), lambda t: regexp_matches(t, "
    "'^<[a-zA-Z]') AND NOT regexp_matches(t, '(?i)^<(script|style|noscript)\\b')) AS l FROM {source})), attributes AS (SELECT * EXCLUDE (l), "
    "unnest(l) AS quoted, unnest(range(len(l))) AS j FROM (SELECT *, regexp_extract_all(tag, "
    "'\\s(?:href|src)\\s*=\\s*(\"[^\"]*\"|''[^'']*'')', 1, 'i') AS l FROM tags)), links AS (SELECT *, "
    "replace(quoted[2:-2], '&amp;', '&') AS link FROM attributes)"
)


def _tag_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ov.responses(spark, sf_dir).select(
        "page_id", F.posexplode(tag_links(F.col("html"))).alias("position", "link")
    )


add(
    "link_values",
    _tag_links,
    f"WITH {o.prelude()}, {_LINKS.format(source='r')} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY "
    "i, j) - 1 AS INTEGER) AS position, link FROM links WHERE link <> ''",
)
_ADDRESSES = (
    f"full_links AS (SELECT *, {o.join('link')} AS full_url FROM links WHERE link <> ''), addresses AS (SELECT DISTINCT "
    "site, url, regexp_replace(full_url, '#.*$', '') AS link FROM full_links WHERE "
    "regexp_matches(full_url, '^https?:'))"
)
add(
    "link_addresses",
    lambda spark, sf: page_links(ov.responses(spark, sf), follow_external=True).select("site", "url", "link"),
    f"WITH {o.prelude()}, {_LINKS.format(source='r')}, {_ADDRESSES} SELECT site, url, link FROM addresses",
)
add(
    "link_addresses_same_site",
    lambda spark, sf: page_links(ov.responses(spark, sf)).select("site", "url", "link"),
    f"WITH {o.prelude()}, {_LINKS.format(source='r')}, {_ADDRESSES} SELECT site, url, link FROM addresses "
    "WHERE regexp_extract(link, '^[a-z]+://([^/?#]*)', 1) = site",
)


def _reachable(follow_external: bool, max_pages: int | None = None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = ov.link_graph(spark, sf_dir)
        links = re_.link_table(graph, follow_external)
        found = re_.reachable(re_.start_pages(graph), links, max_depth=3, max_pages=max_pages)
        return found.select("site", "url", "depth") if max_pages is None else found

    return query


def _reachable_sql(same_site: bool) -> str:
    where = " AND t % 5 = c.s" if same_site else ""
    return f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages),
    edges AS (SELECT page_id AS f, unnest([(page_id + 5) % n, (page_id + 35) % n, (page_id * 3 + 1) % n]) AS t
      FROM pages, n),
    crawl AS (SELECT page_id AS s, page_id AS p, 0 AS depth FROM pages WHERE page_id < 5
      UNION SELECT c.s, t, c.depth + 1 FROM crawl c JOIN edges ON f = c.p WHERE c.depth < 3{where})
    SELECT 's' || s || '.example.com' AS site, 'https://s' || (p % 5) || '.example.com/p/' || p AS url,
      min(depth) AS depth FROM crawl GROUP BY ALL"""


add("reachable_pages", _reachable(False), _reachable_sql(True))
add("reachable_pages_external", _reachable(True), _reachable_sql(False))


def _capped_sql(most: int) -> str:
    """The levels one by one: new addresses of a level are numbered by the visit and place of the link that finds them."""
    levels = []
    for d in (1, 2, 3):
        seen = " UNION ALL ".join(f"SELECT s, p, visit FROM l{i}" for i in range(d))
        levels.append(
            f"""c{d} AS (SELECT s, t, min({{'v': visit, 'spot': spot}}) AS first FROM l{d - 1} JOIN edges ON f = p AND t % 5 = s
      WHERE NOT EXISTS (SELECT 1 FROM ({seen}) AS o WHERE o.s = l{d - 1}.s AND o.p = t) GROUP BY ALL),
    l{d} AS (SELECT s, t AS p, {d} AS depth, n.visit + row_number() OVER (PARTITION BY s ORDER BY first, t) AS visit
      FROM c{d} JOIN (SELECT s, max(visit) AS visit FROM ({seen}) AS o GROUP BY s) AS n USING (s)
      QUALIFY n.visit + row_number() OVER (PARTITION BY s ORDER BY first, t) <= {most})"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(4))
    return f"""WITH n AS (SELECT count(*) AS n FROM pages),
    edges AS (SELECT page_id AS f, unnest([(page_id + 5) % n, (page_id + 35) % n, (page_id * 3 + 1) % n]) AS t,
      unnest([0, 1, 2]) AS spot FROM pages, n),
    l0 AS (SELECT page_id AS s, page_id AS p, 0 AS depth, CAST(1 AS BIGINT) AS visit FROM pages WHERE page_id < 5),
    {", ".join(levels)}
    SELECT 's' || s || '.example.com' AS site, 'https://s' || (p % 5) || '.example.com/p/' || p AS url, depth,
      CAST(visit AS BIGINT) AS visit FROM ({every}) AS e"""


add("reachable_pages_capped", _reachable(False, 10), _capped_sql(10))


def _reachable_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = ov.responses(spark, sf_dir)
    found = re_.reachable(re_.start_pages(responses), re_.link_table(responses), max_depth=3)
    return found.select("site", "url", "depth")


# The pages' own links, from the first capture of each address.
add(
    "reachable_stored_pages",
    _reachable_stored,
    f"WITH RECURSIVE {o.prelude()}, captured AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY url ORDER BY "
    f"page_id) = 1), {_LINKS.format(source='captured')}, {_ADDRESSES}, edges AS (SELECT DISTINCT url, link FROM addresses "
    "WHERE regexp_extract(link, '^[a-z]+://([^/?#]*)', 1) = site), crawl AS (SELECT site, arg_min(url, page_id) AS url, 0 AS "
    "depth FROM r GROUP BY site UNION SELECT c.site, e.link, c.depth + 1 FROM crawl c JOIN edges e ON e.url = c.url WHERE "
    "c.depth < 3) SELECT site, url, min(depth) AS depth FROM crawl GROUP BY ALL",
)


# Documents
def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    robots = ov.robots_docs(spark, sf_dir)
    return fetched_sitemaps(sitemap_requests(robots, robots.select("site", "base_url")), ov.sitemap_docs(spark, sf_dir))


_DOCS = f"WITH {o.prelude()}, {o.site_documents()}"
for key, source_name in (
    ("robots_disallow", "robots_disallow"),
    ("robots_sitemap", "robots_sitemap"),
    ("robots_comment", "robots_comment"),
):

    def _robots(spark: SparkSession, sf_dir: str, source: str = source_name) -> DataFrame:
        found = robots_findings(ov.robots_docs(spark, sf_dir))
        return found.where(F.col("source") == source).select(*SITE_COLUMNS)

    add(key, _robots, o.robots_sql(source_name))
add(
    "sitemap_requests",
    lambda spark, sf: sitemap_requests(
        ov.robots_docs(spark, sf), ov.robots_docs(spark, sf).select("site", "base_url")
    ).select("site", "sitemap_url", F.col("position").cast("bigint").alias("position")),
    f"{_DOCS} SELECT site, sitemap_url, CAST(position AS BIGINT) AS position FROM requests",
)
add(
    "sitemap_urls",
    lambda spark, sf: sitemap_urls(_fetched(spark, sf)).select("site", "sitemap_url", "url"),
    f"{_DOCS} SELECT site, sitemap_url, url FROM sitemap_urls",
)
add(
    "sitemap_summary",
    lambda spark, sf: sitemap_findings(_fetched(spark, sf)).select(
        "site", F.col("url").alias("sitemap_url"), "type", "value", "source", "severity", "context"
    ),
    f"{_DOCS} SELECT site, sitemap_url, 'endpoint' AS type, queued || ' URLs from sitemap' AS value, 'sitemap' AS source, "
    f"'info' AS severity, 'Parsed ' || parsed || ' URLs, queued ' || queued || ' for crawling' AS context "
    f"FROM ({o.sitemap_rows()}) AS s",
)


# Audit and reports
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.audit(ov.responses(spark, sf_dir), ov.robots_docs(spark, sf_dir), ov.sitemap_docs(spark, sf_dir))


def visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    robots = ov.robots_docs(spark, sf_dir).select("site", F.concat("base_url", F.lit("/robots.txt")).alias("url"))
    sitemaps = _fetched(spark, sf_dir).select("site", F.col("sitemap_url").alias("url"))
    return ca.visited(load_addresses(spark, sf_dir), robots, sitemaps)


def load_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ov.captures(ov.load(spark, sf_dir, "pages")).select("site", "url")


add(
    "visited_count",
    lambda spark, sf: visited(spark, sf).groupBy("site").agg(F.count("*").alias("urls_visited")),
    o.over_findings("SELECT site, count(*) AS urls_visited FROM visited GROUP BY site"),
)
add(
    "findings_dedup",
    lambda spark, sf: findings(spark, sf).select(
        "site", "visit_order", "type", "value", "source", "severity", "context"
    ),
    o.over_findings("SELECT site, vo AS visit_order, type, value, source, severity, context FROM findings"),
)
add(
    "first_page_technologies",
    lambda spark, sf: au.site_technologies(ov.responses(spark, sf)).select("site", "name", "category", "version"),
    f"WITH {o.prelude()}, detected AS ({o.detected()}) SELECT site, name, category, version FROM detected JOIN firsts "
    "USING (page_id)",
)
add(
    "site_summary",
    lambda spark, sf: rp.summary(
        findings(spark, sf), visited(spark, sf), ca.errors(ov.responses(spark, sf))
    ).select(
        "site",
        "total_findings",
        "urls_visited",
        "errors",
        F.try_element_at("by_type", F.lit("header")).alias("headers"),
        F.try_element_at("by_type", F.lit("secret")).alias("secrets"),
        F.try_element_at("by_severity", F.lit("critical")).alias("critical"),
        F.try_element_at("by_severity", F.lit("info")).alias("info"),
    ),
    o.over_findings(
        "SELECT site, coalesce(total, 0) AS total_findings, urls_visited, coalesce(failed, 0) AS errors, headers, secrets, "
        "critical, info FROM (SELECT site, count(*) AS urls_visited FROM visited GROUP BY site) AS v LEFT JOIN "
        "(SELECT site, count(*) AS total, nullif(count(*) FILTER (type = 'header'), 0) AS headers, "
        "nullif(count(*) FILTER (type = 'secret'), 0) AS secrets, nullif(count(*) FILTER (severity = 'critical'), 0) AS "
        "critical, nullif(count(*) FILTER (severity = 'info'), 0) AS info FROM findings GROUP BY site) AS f USING (site) "
        "LEFT JOIN (SELECT site, count(*) AS failed FROM r WHERE error IS NOT NULL GROUP BY site) AS e USING (site)"
    ),
)
add(
    "summary_counts",
    lambda spark, sf: rp.counts(findings(spark, sf)),
    o.over_findings(
        "SELECT site, type, severity, count(*) AS findings FROM findings GROUP BY GROUPING SETS ((site, type), "
        "(site, severity), (site))"
    ),
)
# The audit of the pages within one link of the first, and of no others.
_NEAR = (
    f"captured AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1), "
    f"{_LINKS.format(source='captured')}, {_ADDRESSES}, crawl AS (SELECT site, arg_min(url, page_id) AS url FROM r GROUP BY site "
    "UNION SELECT c.site, a.link FROM (SELECT site, arg_min(url, page_id) AS url FROM r GROUP BY site) c JOIN addresses a "
    "ON a.url = c.url WHERE regexp_extract(a.link, '^[a-z]+://([^/?#]*)', 1) = a.site), "
    "near AS (SELECT ok.* FROM ok JOIN crawl USING (site, url))"
)
_FIRSTS = "firsts AS (SELECT site, min(page_id) AS page_id FROM {} GROUP BY site)"
add(
    "audit_reachable_summary",
    lambda spark, sf: rp.counts(
        audit_reached(ov.responses(spark, sf), ov.robots_docs(spark, sf), ov.sitemap_docs(spark, sf), max_depth=1)
    ),
    o.over_findings(
        "SELECT site, type, severity, count(*) AS findings FROM findings GROUP BY GROUPING SETS ((site, type), "
        "(site, severity), (site))"
    )
    .replace(_FIRSTS.format("ok"), f"{_NEAR}, {_FIRSTS.format('near')}", 1)
    .replace("IN (SELECT page_id FROM ok)", "IN (SELECT page_id FROM near)"),
)


def _powered(url: str, html: str, headers: dict[str, str]):
    """An extractor as a user writes one; it fails on some pages."""
    if "WordPress" in html:
        raise ValueError("not made for this page")
    yield {"value": f"{len(url)} characters", "type": "info", "severity": "low", "context": headers.get("server", "")}


def _python_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = ca.analyzable(ov.responses(spark, sf_dir))
    register_function("powered", _powered, in_audit=False)
    try:
        found = extract(pages, ["powered"]).select("site", "page_id", F.concat_ws(", ", "severity", "value", "source", "context").alias("message"))
        return found.union(extractor_failures(pages, ["powered"]))
    finally:
        registry.unregister("powered")


add(
    "python_extractor",
    _python_extractor,
    f"WITH {o.prelude()} SELECT ok.site, ok.page_id, CASE WHEN contains(html, 'WordPress') THEN url || ':powered: not made for this "
    "page' ELSE 'low, ' || length(url) || ' characters, powered, ' || coalesce(l.value, '') END AS message FROM ok LEFT JOIN "
    "lower_headers l ON l.hid = ok.hid AND l.name = 'server'",
)
_SCORE = (
    "greatest(100 - 20 * count(*) FILTER (severity = 'critical') - 8 * count(*) FILTER (severity = 'high') - 2 * "
    "least(count(*) FILTER (severity = 'medium'), 5), 0)"
)
_RATING = (
    "CASE WHEN score >= 95 THEN 'A+' WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' "
    "WHEN score >= 30 THEN 'D' ELSE 'F' END"
)
_SCORED = f", scored AS (SELECT site, CAST({_SCORE} AS BIGINT) AS score FROM findings GROUP BY site)"
add(
    "site_score",
    lambda spark, sf: rp.scores(findings(spark, sf)),
    o.over_findings(f"SELECT site, score, {_RATING} AS rating FROM scored", _SCORED),
)
_DEDUCTIONS = """, deducted AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY vo, eo, ro, mo) AS position,
  CASE severity WHEN 'critical' THEN '-20: ' WHEN 'high' THEN '-8: ' ELSE '-2: ' END || left(value, 60) AS deduction
  FROM (SELECT *, row_number() OVER (PARTITION BY site, severity = 'medium' ORDER BY vo, eo, ro, mo) AS n FROM findings
    WHERE severity IN ('critical', 'high', 'medium')) AS c WHERE severity <> 'medium' OR n <= 5)"""
add(
    "score_deductions",
    lambda spark, sf: rp.deductions(findings(spark, sf)),
    o.over_findings("SELECT site, position, deduction FROM deducted WHERE position <= 20", _DEDUCTIONS),
)
add(
    "json_report",
    # Three parts of the report read the findings, so they are written once.
    lambda spark, sf: rp.json_reports(
        settle(findings(spark, sf)),
        visited(spark, sf),
        ca.errors(ov.responses(spark, sf)),
        au.site_technologies(ov.responses(spark, sf)),
    ).select(
        "site",
        F.col("meta.tool").alias("tool"),
        F.col("meta.total_findings").alias("total_findings"),
        F.col("meta.security_score.score").alias("score"),
        F.array_join("meta.security_score.deductions", " | ").alias("deductions"),
        F.array_join(F.transform("tech_stack", lambda t: t["name"]), ",").alias("tech_stack"),
    ),
    o.over_findings(
        "SELECT site, 'sitesieve' AS tool, coalesce(t.n, 0) AS total_findings, score, coalesce(d.deductions, '') AS "
        "deductions, coalesce(s.names, '') AS tech_stack FROM (SELECT DISTINCT site FROM visited) AS v LEFT JOIN "
        "(SELECT site, count(*) AS n FROM findings GROUP BY site) AS t USING (site) LEFT JOIN scored USING (site) LEFT JOIN "
        "(SELECT site, string_agg(deduction, ' | ' ORDER BY position) AS deductions FROM deducted WHERE position <= 20 "
        "GROUP BY site) AS d USING (site) LEFT JOIN (SELECT site, string_agg(name, ',' ORDER BY pos) AS names FROM detected "
        "JOIN firsts USING (page_id) GROUP BY site) AS s USING (site)",
        _SCORED + _DEDUCTIONS,
    ),
)
add(
    "json_findings",
    lambda spark, sf: rp.json_findings(findings(spark, sf)).select("site", "type", "value", "source", "severity"),
    o.over_findings("SELECT site, type, value, source, severity FROM findings"),
)
_ISSUES = (
    "SELECT site, severity, type, left(value, {0}) AS value, left(context, {1}) AS context{2} FROM (SELECT *, row_number() "
    "OVER (PARTITION BY site ORDER BY rank, vo, eo, ro, mo) AS position FROM ranked WHERE rank <= 2) AS i{3}"
)
add(
    "issues_top25",
    lambda spark, sf: rp.issues(findings(spark, sf)),
    o.over_findings(_ISSUES.format(50, 40, ", position", " WHERE position <= 25")),
)
add(
    "issues_all",
    lambda spark, sf: rp.issues(findings(spark, sf), None, 60, 60),
    o.over_findings(_ISSUES.format(60, 60, "", "")),
)
_SECTION = "CASE WHEN type IN ('secret', 'header', 'waf', 'file') THEN 'Security Issues' ELSE 'Surface Findings' END"
add(
    "section_counts",
    lambda spark, sf: rp.section_counts(findings(spark, sf)),
    o.over_findings(f"SELECT site, {_SECTION} AS section, type, count(*) AS findings FROM findings GROUP BY ALL"),
)
add(
    "section_listing",
    lambda spark, sf: rp.section_listing(findings(spark, sf)),
    o.over_findings(
        f"SELECT site, {_SECTION} AS section, severity, type, value, left(context, 100) AS context FROM findings"
    ),
)
add(
    "severity_breakdown",
    lambda spark, sf: rp.severity_breakdown(findings(spark, sf)),
    o.over_findings(
        "SELECT site, severity, CAST(sum(n) AS BIGINT) AS findings, string_agg(type || ':' || n, ', ' ORDER BY type) AS "
        "breakdown FROM (SELECT site, severity, type, count(*) AS n FROM findings GROUP BY ALL) AS t GROUP BY site, severity"
    ),
)
add(
    "report_tiles",
    lambda spark, sf: rp.tiles(findings(spark, sf)),
    o.over_findings(
        "SELECT site, count(*) AS total, count(*) FILTER (severity IN ('critical', 'high')) AS critical_high, "
        "count(*) FILTER (severity = 'medium') AS medium FROM findings GROUP BY site"
    ),
)
add(
    "report_sections",
    lambda spark, sf: rp.report_sections(findings(spark, sf)),
    o.over_findings(
        "SELECT site, section, type, row_number() OVER (PARTITION BY site, type ORDER BY rank, vo, eo, ro, mo) AS position, "
        "severity, left(value, 120) AS value, source, left(context, 90) AS context FROM (SELECT *, CAST(list_position("
        "['secret', 'header', 'subdomain', 'file', 'api_route', 'parameter', 'endpoint', 'javascript', 'info'], type) AS "
        "INTEGER) AS section FROM ranked) AS s WHERE section > 0"
    ),
)
add(
    "report_deductions",
    lambda spark, sf: rp.deductions(findings(spark, sf), 15),
    o.over_findings("SELECT site, position, deduction FROM deducted WHERE position <= 15", _DEDUCTIONS),
)
add(
    "pages_listing",
    lambda spark, sf: rp.pages_listing(visited(spark, sf)),
    o.over_findings(
        "SELECT site, row_number() OVER (PARTITION BY site ORDER BY url) AS position, left(url, 80) AS page FROM visited"
    ),
)
add(
    "endpoint_summary",
    lambda spark, sf: (
        au.deduplicate(extract(ov.responses(spark, sf), ["endpoints"])).groupBy("site").agg(F.count("*").alias("endpoints"))
    ),
    f"WITH {o.prelude()} SELECT site, count(*) AS endpoints FROM (SELECT DISTINCT site, type, value, source FROM "
    f"({o.x_endpoints()}) AS e JOIN r USING (page_id)) AS d GROUP BY site",
)

# Building blocks
add(
    "first_wins",
    lambda spark, sf: extract(ov.responses(spark, sf), ["endpoints", "api_routes"]).select(
        "page_id",
        F.col("extractor_ord").cast("bigint").alias("eo"),
        F.col("rule_ord").cast("bigint").alias("ro"),
        "value",
    ),
    f"WITH {o.prelude()} SELECT page_id, CAST(eo AS BIGINT) AS eo, ro, value FROM (SELECT * FROM ({o.x_endpoints()}) AS a "
    f"UNION ALL SELECT * FROM ({o.x_api_routes()}) AS b) AS c",
)
REFERENCES = (
    "a/b", "../x", "../../z/w", "./here", "?k=2", "", "/a/b/../c", "/a/./b", "//h.com/a", "foo:bar", "x.html#f", "/p?q=1#f",
    "..", ".", "/..", "d/e?x=/../y",
)


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = ov.load(spark, sf_dir, "pages").select("page_id", "url", url_parts(F.col("url")).alias("base"))
    refs = F.array(*[F.lit(r) for r in REFERENCES])
    each = pages.select("page_id", "base", F.explode(refs).alias("ref"))
    return each.select("page_id", "ref", url_join(F.col("base"), F.col("ref")).alias("joined"))


def _joined_sql() -> str:
    # path and the rest apart, since dot segments count in the path only
    path = "regexp_extract(ref, '^([^?#]*)', 1)"
    rest = "regexp_extract(ref, '^[^?#]*(.*)$', 1)"
    closed = f"regexp_replace({{0}}, '/\\.\\.$', '/../')"
    rooted = o.no_dots(closed.format(path))
    relative = o.no_dots(closed.format(f"(folder || {path})"))
    return f"""WITH {o.prelude()} SELECT page_id, ref, CASE WHEN ref = '' THEN url
      WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN ref
      WHEN starts_with(ref, '//') THEN scheme || ':' || ref WHEN starts_with(ref, '?') THEN origin || path || ref
      WHEN starts_with(ref, '/') THEN origin || {rooted} || {rest}
      ELSE origin || {relative} || {rest} END AS joined
      FROM r CROSS JOIN {o.values((r,) for r in REFERENCES)} AS refs(ref)"""


add("url_join", _joined, _joined_sql())
add(
    "url_parts",
    lambda spark, sf: ov.load(spark, sf, "pages")
    .select("page_id", url_parts(F.col("url")).alias("p"))
    .select("page_id", "p.scheme", "p.netloc", "p.path", "p.query", "p.fragment"),
    "SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS netloc, "
    "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query, "
    "regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages",
)
add(
    "query_pairs",
    lambda spark, sf: ov.load(spark, sf, "pages")
    .select("page_id", F.posexplode(query_pairs(F.col("url"))).alias("position", "pair"))
    .select("page_id", "position", "pair.name", "pair.value"),
    "SELECT page_id, CAST(i AS INTEGER) AS position, split_part(pair, '=', 1) AS name, split_part(pair, '=', 2) AS value "
    "FROM (SELECT page_id, unnest(l) AS pair, unnest(range(len(l))) AS i FROM (SELECT page_id, [x FOR x IN "
    "string_split(regexp_extract(url, '\\?([^#]*)', 1), '&') IF regexp_matches(x, '=.')] AS l FROM pages) AS a) AS b",
)
add(
    "text_helpers",
    lambda spark, sf: ov.load(spark, sf, "pages")
    .select("page_id", F.posexplode(find_all(F.col("html"), ">([^<]+)<", 1)).alias("position", "text"))
    .select("page_id", "position", strip(F.col("text")).alias("text"))
    .where("text != ''")
    .select("page_id", "position", F.lower("text").alias("lowered"), cut(F.col("text"), 20).alias("short")),
    f"SELECT page_id, CAST(i AS INTEGER) AS position, lower(t) AS lowered, left(t, 20) AS short FROM (SELECT page_id, i, "
    f"{o.strip('x')} AS t FROM (SELECT page_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT page_id, "
    "regexp_extract_all(html, '>([^<]+)<', 1) AS l FROM pages) AS a) AS b) AS c WHERE t <> ''",
)
_CODED = "['\"]([A-Za-z0-9+/]{16,}={0,2})['\"]"
add(
    "base64_text",
    lambda spark, sf: ov.responses(spark, sf)
    .select("page_id", F.posexplode(find_all(F.col("html"), _CODED, 1)).alias("position", "coded"))
    .select("page_id", "position", "coded", base64_text(F.col("coded")).alias("decoded")),
    f"WITH {o.prelude()} SELECT page_id, CAST(i AS INTEGER) AS position, coded, coalesce(try(decode(from_base64(whole))), "
    # Not UTF-8: the two such texts of the overlay keep their ASCII bytes.
    "array_to_string([chr(CAST('0x' || h AS INTEGER)) FOR h IN regexp_extract_all(hex(from_base64(whole)), '..') IF h < '80'], "
    "'')) AS decoded FROM (SELECT *, CASE WHEN length(coded) % 4 = 0 THEN coded END AS whole FROM (SELECT page_id, unnest(l) AS "
    "coded, unnest(range(len(l))) AS i FROM (SELECT page_id, "
    f"regexp_extract_all(html, {o.q(_CODED)}, 1) AS l FROM r) AS a) AS b) AS c",
)
add(
    "quoted_segments",
    lambda spark, sf: ov.responses(spark, sf)
    .select("page_id", quoted_segments(F.col("html")).alias("s"))
    .select(
        "page_id",
        F.size("s").cast("bigint").alias("segments"),
        F.length(F.array_join("s", "")).cast("bigint").alias("characters"),
    ),
    f"WITH {o.prelude()} SELECT page_id, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS characters FROM segments "
    "GROUP BY page_id",
)
