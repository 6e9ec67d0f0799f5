"""API addresses named anywhere in a page, by the way they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import (
    contains_any,
    find_all,
    find_groups,
    has_scheme,
    starting,
    starts_with_any,
    strip,
)
from .candidates import each, prefixed, together
from .endpoints import is_call_target
from .page import Page

# Patterns.
WP_URL = r"""['"`](https?://[^'"`]*wp-json[^'"`]*)['"`]"""
WP_PATH = r"""['"`](/wp-json/[^'"`]+)['"`]"""
REST_PATH = (
    r"""['"`](/(?:api|v[0-9]+|graphql|rest|internal|admin|auth|login|register|logout|upload|download|search|users?"""
    r"""|accounts?|settings?|config|health|status|metrics|debug|test)/[a-zA-Z0-9/_-]*)['"`]"""
)
API_LINK = r"""(?:href|src|content)=["'](https?://[^"']*(?:api|rest|graphql|endpoint)[^"']*)["']"""
GRAPHQL = r"""['"`]([^'"`]*graphql[^'"`]*)['"`]"""
WEBSOCKET = r"""(?:wss?://[^\s'"]+)"""
CONFIG = (
    r"""(?:baseUrl|baseURL|apiUrl|apiBase|endpoint|apiEndpoint|API_URL|API_BASE|api_url|api_base)[\s]*[=:]\s*"""
    r"""['"`]([^'"`]+)['"`]"""
)
CALL = (
    r"""(?:fetch\s*\(|\.get\s*\(|\.post\s*\(|\.put\s*\(|\.delete\s*\(|\.patch\s*\()"""
    r"""(?s:.){0,30}?['"`]([^'"`]+)['"`]"""
)
XHR = r"""XMLHttpRequest(?s:.){0,30}?['"`](https?://[^'"`]+)['"`]"""


def _routes(rule: int, source: str, severity: str, found: Column, when: Column | None, label: str, length: int, **fields):
    return each(
        found,
        when=when,
        rule=rule,
        type="api_route",
        source=source,
        severity=severity,
        once=True,
        **{"value": lambda m: m, "context": lambda m: prefixed(label, m, length), **fields},
    )


def api_routes(page: Page) -> Column:
    html, fold = page.html, page.fold

    def config_value(m: Column) -> Column:
        address = strip(m)
        return F.when(starts_with_any(address, "http://", "https://", "/"), address).otherwise(
            F.concat(F.lit("/"), address)
        )

    has_wp = contains_any(fold, "wp-json")
    has_call = contains_any(fold, "fetch", ".get", ".post", ".put", ".delete", ".patch")
    return together(
        _routes(
            0, "wordpress_rest_api", "low", find_all(html, WP_URL, 1, True), has_wp, "WordPress REST API: ", 80
        ),
        _routes(
            1, "wordpress_rest_api", "low", find_all(html, WP_PATH, 1, True), has_wp, "WP REST: ", 60, resolve=True
        ),
        _routes(
            2,
            "rest_api_path",
            "low",
            find_all(html, REST_PATH, 1, True),
            None,
            "REST path: ",
            60,
            resolve=True,
        ),
        _routes(
            3,
            "api_link_tag",
            "low",
            find_all(html, starting("hsc", API_LINK), 1, True),
            contains_any(fold, "://") & contains_any(fold, "api", "rest", "graphql", "endpoint"),
            "API link: ",
            80,
        ),
        _routes(
            4,
            "graphql_reference",
            "medium",
            find_all(html, GRAPHQL, 1, True),
            contains_any(fold, "graphql"),
            "GraphQL: ",
            0,
            resolve=lambda m: ~has_scheme(m),
            context="GraphQL: ",
            context_cut=60,
        ),
        _routes(
            5,
            "websocket",
            "low",
            find_all(html, WEBSOCKET, 0, True),
            contains_any(fold, "ws://", "wss://"),
            "WebSocket: ",
            60,
        ),
        _routes(
            6,
            "config_object",
            "medium",
            find_all(html, starting("abe", CONFIG), 1, True),
            contains_any(fold, "baseurl", "apiurl", "apibase", "endpoint", "api_url", "api_base"),
            "",
            0,
            value=config_value,
            resolve=lambda m: ~has_scheme(strip(m)),
            context="Config API: ",
            context_cut=60,
        ),
        each(
            find_groups(html, starting(".fx", CALL), ignore_case=True),
            when=has_call,
            keep=lambda m: is_call_target(strip(m["g1"])),
            rule=7,
            type="api_route",
            source="fetch_call",
            severity="low",
            value=lambda m: strip(m["g1"]),
            resolve=lambda m: ~has_scheme(strip(m["g1"])),
            context=lambda m: prefixed("Fetch: ", strip(m["g1"]), 60),
            once=True,
        ),
        _routes(
            8, "xhr_request", "low", find_all(html, XHR, 1, True), contains_any(fold, "xmlhttprequest"), "XHR: ", 60
        ),
    )
