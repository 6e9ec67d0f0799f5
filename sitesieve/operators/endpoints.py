"""Links, call targets and script files a page refers to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import (
    contains_any,
    cut,
    find_all,
    find_groups,
    has_scheme,
    matches,
    starting,
    starts_with_any,
    strip,
)
from .candidates import each, together
from .page import Page

# Patterns.
ATTRIBUTE = r"""(?:href|src|action|data-url|data-action|data-endpoint|data-api)=\s*["']([^"'#]+)["']"""
CALL = (
    r"""(?:fetch\s*\(|\.get\s*\(|\.post\s*\(|\.put\s*\(|\.delete\s*\(|\.patch\s*\(|\.ajax\s*\(|XMLHttpRequest)"""
    r"""(?s:.){0,30}?['"`]([^'"`]+)['"`]"""
)
TEMPLATE = r"""['"`]/((?:api|v[0-9]+|graphql|rest)/[^'"`\s${}]+)['"`]"""
SCRIPT_SRC = r"""<script[^>]+src=["']([^"']+)["']"""
IMPORT = r"""import\(['"`]([^'"`]+)['"`]\)|require\(['"`]([^'"`]+)['"`]\)"""
LARGE_SCRIPT = r"<script(?![^>]*src=)[^>]*>((?s:.){500,}?)</script>"
SCRIPT_FLAGS = (
    ("window_assignments", r"window\.\w+\s*="),
    ("cookie_access", r"document\.cookie"),
    ("storage_access", r"localStorage|sessionStorage"),
    ("eval_usage", r"eval\("),
)
NOT_A_LINK = ("javascript:", "mailto:", "tel:", "data:")
NOT_A_CALL = ("javascript:", "mailto:", "data:")


def is_call_target(target: Column) -> Column:
    looks_like_path = F.contains(target, F.lit(".")) | F.contains(target, F.lit("/"))
    return ~starts_with_any(target, *NOT_A_CALL) & looks_like_path


def endpoints(page: Page) -> Column:
    links = each(
        find_groups(page.html, starting("hsad", ATTRIBUTE), ignore_case=True),
        when=contains_any(page.fold, "href=", "src=", "action=", "data-"),
        keep=lambda m: ~starts_with_any(strip(m["g1"]), *NOT_A_LINK),
        type="endpoint",
        source="html_attribute",
        value=lambda m: strip(m["g1"]),
        resolve=True,
        context=lambda m: cut(m["g0"], 100),
        once=True,
    )
    calls = each(
        find_groups(page.html, starting(".fx", CALL), ignore_case=True),
        when=contains_any(
            page.fold, "fetch", ".get", ".post", ".put", ".delete", ".patch", ".ajax", "xmlhttprequest"
        ),
        keep=lambda m: is_call_target(strip(m["g1"])),
        rule=1,
        type="api_route",
        source="inline_script",
        severity="low",
        value=lambda m: strip(m["g1"]),
        resolve=lambda m: ~has_scheme(strip(m["g1"])),
        context=lambda m: cut(m["g0"], 100),
        once=True,
    )
    templates = each(
        find_groups(page.html, TEMPLATE, ignore_case=True),
        rule=2,
        type="api_route",
        source="template_literal",
        severity="low",
        value=lambda m: F.concat(F.lit("/"), m["g1"]),
        resolve=True,
        context=lambda m: cut(m["g0"], 100),
        once=True,
    )
    return together(links, calls, templates)


def scripts(page: Page) -> Column:
    files = each(
        find_groups(page.html, SCRIPT_SRC, ignore_case=True),
        when=contains_any(page.fold, "src="),
        type="javascript",
        source="script_src",
        value=lambda m: strip(m["g1"]),
        resolve=True,
        context=lambda m: cut(m["g0"], 100),
        once=True,
    )
    imports = each(
        find_groups(page.html, IMPORT, 2, ignore_case=True),
        when=contains_any(page.fold, "import(", "require("),
        rule=1,
        type="javascript",
        source="dynamic_import",
        value=lambda m: F.concat(m["g1"], m["g2"]),
        resolve=lambda m: ~has_scheme(F.concat(m["g1"], m["g2"])),
        context=lambda m: cut(m["g0"], 100),
        once=True,
    )
    flagged = F.transform(
        find_all(page.html, LARGE_SCRIPT, 1, ignore_case=True),
        lambda body: F.struct(
            body.alias("body"),
            F.array_compact(
                F.array(*[F.when(matches(body, pattern), F.lit(flag)) for flag, pattern in SCRIPT_FLAGS])
            ).alias("flags"),
        ),
    )
    # The text between the first start and the last end bounds the length of any script.
    start = F.instr(page.fold, "<script")
    after_last = F.substring_index(page.fold, "</script>", -1)
    longest = F.length(page.fold) - F.length(after_last) - start
    large = each(
        flagged,
        when=(start > 0) & (longest >= 500),
        keep=lambda m: F.size(m["flags"]) > 0,
        rule=2,
        type="javascript",
        source="inline_script_analysis",
        severity=lambda m: F.when(F.array_contains(m["flags"], "eval_usage"), "medium").otherwise("info"),
        value=lambda m: F.concat(F.lit("inline_script ("), F.array_join(m["flags"], ", "), F.lit(")")),
        context=lambda m: cut(m["body"], 200),
        metadata={
            "length": lambda m: F.length(m["body"]),
            "flags": lambda m: F.to_json(m["flags"]),
        },
    )
    return together(files, imports, large)
