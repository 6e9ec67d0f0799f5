"""Schemas and fixed vocabularies of the two tables everything is built on: captured responses and findings."""

from __future__ import annotations

# ``page_id`` is unique; ``visit_order`` is unique within a site.
RESPONSES = (
    "site string, page_id bigint, url string, visit_order bigint, depth int, status int, content_type string, "
    "headers map<string,string>, html string, error string"
)
ROBOTS_DOCS = "site string, base_url string, content string"
SITEMAP_DOCS = "site string, sitemap_url string, status int, content string"

FINDING_COLUMNS = (
    "site",
    "url",
    "page_id",
    "type",
    "value",
    "source",
    "severity",
    "context",
    "metadata",
    "visit_order",
    "extractor_ord",
    "rule_ord",
    "match_ord",
)
# The order in which findings of a site are listed.
FINDING_ORDER = ("visit_order", "page_id", "extractor_ord", "rule_ord", "match_ord")

# Fixed values.
SEVERITIES = ("critical", "high", "medium", "low", "info")
ISSUE_SEVERITIES = ("critical", "high", "medium")
SECURITY_TYPES = ("secret", "header", "waf", "file")
SECTION_TYPES = ("secret", "header", "subdomain", "file", "api_route", "parameter", "endpoint", "javascript", "info")

# Findings of the documents read before any page come first.
ROBOTS_VISIT = -2
SITEMAP_VISIT = -1
