"""Parameter names: form fields, query keys, request bodies, browser storage, path placeholders, header values."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import contains_any, cut, find_all, find_groups, starting, strip
from ..functions.urls import query_pairs
from .candidates import each, together
from .page import Page

# Stop lists and patterns. Names are compared in lower case.
IGNORED_PARAMETERS = (
    # campaign tracking
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_cid", "gclid", "gclsrc",
    "dclid", "gbraid", "wbraid",
    # navigation, paging, sorting
    "ref", "source", "from", "back", "return", "redirect", "next", "prev", "page", "per_page", "offset", "limit",
    "skip", "count", "sort", "order", "dir", " asc", "desc", "v", "t", "s", "id", "lang", "locale", "format", "type",
    "action", "callback", "jsonp", "nocache", "_", "timestamp", "rand", "random",
    # protocol and debugging
    "version", "ver", "v_", "debug", "test", "mode", "output", "response_type", "grant_type", "client_id",
    "client_secret",
    # framework tokens
    "_token", "_method", "_csrf", "csrf_token", "csrfmiddlewaretoken", "__RequestVerificationToken", "authenticity_token",
    # searching
    "q", "query", "search", "keyword", "keywords",
    # markup attributes
    "class", "style", "data-", "aria-", "role", "tabindex", "href", "src", "alt", "title", "placeholder", "required",
    "disabled", "checked", "selected", "multiple", "readonly", "autofocus", "autocomplete", "pattern", "min", "max",
    "step", "minlength", "maxlength", "name", "value", "for", "label",
    # forms, referral, media
    "utf8", "commit", "ref_cta", "ref_loc", "ref_page", "w", "h", "fm", "fit", "crop", "auto",
    # keys with an escaped ampersand
    "amp;utm_campaign", "amp;utm_medium", "amp;utm_source", "amp;utm_content", "amp;ref_loc", "amp;ref_page",
    "amp;source", "amp;ct", "amp;st", "amp;is_emu_login", "amp;mobile_ios", "amp;locale", "amp;v",
    # one code host
    "cft", "tags", "with", "disable_signup",
)
IGNORED_NAMES = (
    "width", "height", "max", "min", "size", "scale", "zoom", "top", "left", "right", "bottom", "x", "y", "z",
    "opacity", "alpha", "red", "green", "blue", "color", "padding", "margin", "border", "radius", "gap", "font",
    "font-size", "font-weight", "line-height", "display", "position", "float", "clear", "overflow", "cursor",
    "pointer", "hover", "focus", "active", "animation", "transition", "transform", "duration", "query-builder-test",
    "include_email", "javascript-support", "webauthn-support", "webauthn-conditional", "webauthn-iuvpaa-support",
    "required_field_f2a", "timestamp_secret", "add_account",
)
INPUT = r"""<input[^>]+(?:name|id)=["']([^"']+)["'][^>]*>"""
URL_WITH_QUERY = r"""(?:https?://[^\s"'<>]+|/[^\s"'<>]+\?[^\s"'<>]+)"""
REQUEST_BODY = r"""(?:fetch|axios\.(?:post|put|patch))\s*\([^)]*,\s*\{((?s:.){1,500}?)\}"""
BODY_KEY = r"""["']?(\w+)["']?\s*:"""
STORAGE = r"""(?:localStorage|sessionStorage)\.(?:getItem|setItem|removeItem)\s*\(\s*['"`]([^'"]+)['"`]"""
PLACEHOLDER = r"(?<=/)\{(\w+)\}|(?<=/):(\w+)(?=[/?#]|$)"
AUTH_HEADER = (
    r"""(?:X-[\w-]+-Token|X-[\w-]+-Key|Authorization|X-Api-Key|X-Auth-Token|X-CSRF-Token)"""
    r"""\s*[=:]\s*['"`]([^'"`]+)['"`]"""
)


def _listed(name: Column, *lists: list[str]) -> Column:
    words = sorted({word for words in lists for word in words})
    return F.array_contains(F.from_json(F.lit(json.dumps(words)), "array<string>"), F.lower(name))


def _is_interesting(name: Column) -> Column:
    return ~_listed(name, IGNORED_PARAMETERS, IGNORED_NAMES)


def _form_inputs(page: Page) -> Column:
    def tag_has(m: Column, word: str) -> Column:
        return F.contains(F.lower(m["g0"]), F.lit(word))

    return each(
        find_groups(page.html, INPUT, ignore_case=True),
        when=contains_any(page.fold, "<input"),
        keep=lambda m: _is_interesting(m["g1"]) & ~(m["g1"].startswith("_") & (F.length(m["g1"]) < 20)),
        type="parameter",
        source="form_input",
        severity=lambda m: F.when(tag_has(m, "file") | tag_has(m, "password"), "low")
        .when(tag_has(m, "hidden"), "medium")
        .otherwise("info"),
        value=lambda m: m["g1"],
        context=lambda m: cut(m["g0"], 100),
        once=True,
        metadata={
            "hidden": lambda m: tag_has(m, "hidden"),
            "file_upload": lambda m: tag_has(m, "file"),
            "password": lambda m: tag_has(m, "password"),
        },
    )


def _query_keys(page: Page) -> Column:
    # No address crosses a blank, quote or angle bracket, so only the runs between these that hold a question mark are
    # searched. Searching the page itself would scan a long run, such as an embedded image, once for each of its slashes.
    runs = find_all(page.html, r"""(?<![^\s"'<>])[^\s"'<>?]*+\?[^\s"'<>]*+""")
    urls = F.flatten(F.transform(runs, lambda run: find_all(run, URL_WITH_QUERY)))
    return each(
        F.flatten(F.transform(F.filter(urls, lambda u: F.contains(u, F.lit("?"))), query_pairs)),
        when=contains_any(page.html, "?"),
        keep=lambda m: ~_listed(m["name"], IGNORED_PARAMETERS),
        rule=1,
        type="parameter",
        source="url_query",
        value=lambda m: m["name"],
        context=lambda m: F.concat(m["name"], F.lit("="), cut(m["value"], 30)),
        once=True,
    )


def _body_keys(page: Page) -> Column:
    bodies = find_groups(page.html, starting("fa", REQUEST_BODY), ignore_case=True)
    keys = F.flatten(
        F.transform(
            bodies,
            lambda b: F.transform(
                find_all(b["g1"], BODY_KEY, 1), lambda k: F.struct(k.alias("name"), b["g0"].alias("call"))
            ),
        )
    )
    return each(
        keys,
        when=contains_any(page.fold, "fetch", "axios"),
        keep=lambda m: _is_interesting(m["name"]),
        rule=2,
        type="parameter",
        source="json_body",
        severity="low",
        value=lambda m: m["name"],
        context=lambda m: cut(m["call"], 100),
        once=True,
    )


def _storage_keys(page: Page) -> Column:
    return each(
        find_groups(page.html, STORAGE, ignore_case=True),
        when=contains_any(page.fold, "localstorage", "sessionstorage"),
        keep=lambda m: _is_interesting(m["g1"]),
        rule=3,
        type="parameter",
        source="browser_storage",
        severity="medium",
        value=lambda m: m["g1"],
        context=lambda m: cut(m["g0"], 100),
        once=True,
    )


def _placeholders(page: Page) -> Column:
    def name(m: Column) -> Column:
        return F.regexp_replace(m, r"[{:}]", "")

    return each(
        find_all(page.html, PLACEHOLDER),
        when=contains_any(page.html, "/{", "/:"),
        keep=lambda m: ~_listed(name(m), IGNORED_PARAMETERS),
        rule=4,
        type="parameter",
        source="path_parameter",
        value=name,
        context=lambda m: cut(m, 100),
        once=True,
    )


def _header_values(page: Page) -> Column:
    def header(m: Column) -> Column:
        return strip(F.substring_index(F.substring_index(m["g0"], ":", 1), "=", 1))

    return each(
        find_groups(page.html, starting("xa", AUTH_HEADER), ignore_case=True),
        when=contains_any(page.fold, "authorization", "-token", "-key"),
        keep=lambda m: F.length(m["g1"]) > 5,
        rule=5,
        type="parameter",
        source="header_parameter",
        severity="medium",
        value=lambda m: F.concat(header(m), F.lit(": "), cut(m["g1"], 50)),
        context=lambda m: cut(m["g0"], 100),
        once=True,
        key=lambda m: m["g1"],
        metadata={"header": header},
    )


def parameters(page: Page) -> Column:
    return together(
        _form_inputs(page),
        _query_keys(page),
        _body_keys(page),
        _storage_keys(page),
        _placeholders(page),
        _header_values(page),
    )
