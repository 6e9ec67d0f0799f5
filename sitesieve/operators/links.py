"""Links of a page for following: href and src of every start tag, resolved, without fragment."""

from __future__ import annotations

import contextlib
import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE, let
from ..functions.urls import page_address, site_of, url_join, url_parts

# Possessive repetition keeps the matcher from recursing once per repetition.
_SPACE = f"[{WHITESPACE}]"
_NO_NAME = r"\t\n\r\f />\x00"
_SLACK = f"(?:{_SPACE}|/(?!>))*+"
_VALUE = f"(?>{_SPACE}*=+{_SPACE}*(?:'[^']*+'|\"[^\"]*+\"|(?!['\"])[^>{WHITESPACE}]*+))?+"
_ATTRIBUTE = f"(?<=['\"/{WHITESPACE}])[^/>{WHITESPACE}][^/=>{WHITESPACE}]*+{_VALUE}"
#: The same with the value as a group, for an attribute alone.
_TARGET = "(?s)^[^/>" + WHITESPACE + "][^/=>" + WHITESPACE + "]*+" + _VALUE.replace("(?:", "(", 1) + "$"
_ATTRIBUTES = f"(?:{_ATTRIBUTE}{_SLACK})*+{_SPACE}*+"
_INSIDE = f"[/{WHITESPACE}]*+{_ATTRIBUTES}"
_NAME = f"[a-zA-Z][^{_NO_NAME}]*+"


def _markup() -> str:
    """One pattern for every construct that begins with ``<``; its second group holds the attributes of a start tag.

    A search with it reads a page once from left to right and takes each construct whole, so markup inside of a comment, a
    script or a quoted value is not met. A construct that is not closed takes the rest of the page, as nothing after it
    is read. The alternatives are tried in this order.
    """
    rest = "(?s:.*)"
    keyword = "(?![-_.a-zA-Z0-9])"
    return "<(?:" + "|".join(
        (
            # Comments, then marked sections, declarations, instructions and end tags.
            f"!--(?:(?s:.*?)--{_SPACE}*>|{rest})",
            f"!\\[(?:(?i:temp|cdata|ignore|include|rcdata){keyword}(?s:.*?)\\]{_SPACE}*\\]{_SPACE}*>"
            f"|(?i:if|else|endif){keyword}(?s:.*?)\\]{_SPACE}*>|{rest})",
            "[!?/][^>]*+>?",
            # Raw text up to its end tag. A tag that closes itself has none and falls to the next alternatives.
            f"((?i:script|style))(?=[{_NO_NAME}]){_SLACK}{_ATTRIBUTES}>(?:(?s:.*?)</{_SPACE}*(?iu:\\1){_SPACE}*>|{rest})",
            f"(?i:script|style|noscript)(?=[{_NO_NAME}]){_INSIDE}/?>",
            f"{_NAME}({_INSIDE})/?>",
            # Start tags that are not closed, or go on with something that belongs to no tag.
            f"{_NAME}{_INSIDE}(?:(?=[a-zA-Z=/]|\\z){rest})?+",
        )
    ) + ")"


_MARKUP = _markup()
_LINK = f"(?i)^(?:href|src)(?=[={WHITESPACE}])"
_REFERENCE = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[^\t\n\f <&#;]{1,32};?)"


@cache
def _windows_characters() -> list[tuple[int, str]]:
    """What references to the control characters 128 to 159 stand for: the Windows characters of those numbers, if any."""
    pairs = []
    for code in range(0x80, 0xA0):
        with contextlib.suppress(UnicodeDecodeError):
            pairs.append((code, bytes([code]).decode("cp1252")))
    return pairs


def _by_number(reference: Column) -> Column:
    is_hex = F.rlike(reference, F.lit("^&#[xX]"))
    digits = F.regexp_replace(reference, "^&#[xX]?0*|;$", "")
    # Longer numbers than these are beyond the last character.
    known = F.length(digits) <= F.when(is_hex, 6).otherwise(7)
    code = F.when(~known, 0x110000).when(digits == "", 0).otherwise(F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits))
    code = code.cast("bigint")
    control = code.between(1, 8) | (code == 0xB) | code.between(0xE, 0x1F) | code.between(0x7F, 0x9F)
    nothing = control | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    windows = F.create_map(*(F.lit(x) for pair in _windows_characters() for x in pair))
    return (
        F.when((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd")
        .when(code.between(0x80, 0x9F), F.coalesce(windows[code.cast("int")], F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))
        .when(nothing, "")
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def _by_name(reference: Column) -> Column:
    """The public table of names, with and without semicolon as it lists them; else the longest beginning it lists."""
    # One literal, which is read once when the plan is made.
    table = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    name = F.substr(reference, F.lit(2))
    sizes = F.sequence(F.length(name), F.least(F.lit(2), F.length(name)), F.lit(-1))
    listed = F.filter(F.transform(sizes, lambda n: F.substr(name, F.lit(1), n)), lambda n: F.map_contains_key(table, n))
    best = F.get(listed, 0)
    return F.when(best.isNull(), reference).otherwise(F.concat(table[best], F.substr(name, F.length(best) + 1)))


def unescape(text: Column) -> Column:
    """Character references of HTML in one pass from left to right: what one stands for is not read again."""

    def character(reference: Column) -> Column:
        return (
            F.when(reference == "&amp;", "&")
            .when(F.startswith(reference, F.lit("&#")), _by_number(reference))
            .otherwise(_by_name(reference))
        )

    def decoded(whole: Column) -> Column:
        references = F.concat(F.regexp_extract_all(whole, F.lit(_REFERENCE), F.lit(0)), F.array(F.lit("")))
        between = F.split(whole, _REFERENCE)
        return F.array_join(
            F.zip_with(between, references, lambda b, r: F.concat(b, F.when(r == "", "").otherwise(character(r)))), ""
        )

    return F.when(F.contains(text, F.lit("&")), decoded(text)).otherwise(text)


def tag_links(html: Column) -> Column:
    """``array<string>`` of link targets as written, in document order."""
    tags = F.filter(
        F.regexp_extract_all(html, F.lit(_MARKUP), F.lit(2)),
        lambda t: F.rlike(t, F.lit("(?i)href|src")),
    )

    def target(attribute: Column) -> Column:
        # What a bare value begins with is no quote.
        return let(
            F.regexp_extract(attribute, _TARGET, 1),
            lambda v: unescape(F.when(F.rlike(v, F.lit("^['\"]")), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)),
        )

    def targets(tag: Column) -> Column:
        found = F.filter(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: F.rlike(a, F.lit(_LINK)))
        return F.transform(found, target)

    return F.filter(F.flatten(F.transform(tags, targets)), lambda v: v != "")


def page_addresses(responses: DataFrame, follow_external: bool = False) -> DataFrame:
    """``(site, url, visit_order, links)``: the addresses a page links to as an array, first mention each.

    Addresses on other sites are left out unless ``follow_external`` is set.
    """
    pages = responses.select(
        "site", "url", "visit_order", url_parts(F.col("url")).alias("base"), F.coalesce("html", F.lit("")).alias("html")
    )

    def address(ref: Column) -> Column:
        return let(
            url_join(F.col("base"), ref),
            lambda full: F.when(F.rlike(full, F.lit(r"(?i)^\s*https?:")), page_address(full)),
        )

    links = F.array_distinct(F.array_compact(F.transform(tag_links(F.col("html")), address)))
    if not follow_external:
        links = F.filter(links, lambda link: site_of(link) == F.col("site"))
    return pages.select("site", "url", "visit_order", links.alias("links"))


def page_links(responses: DataFrame, follow_external: bool = False) -> DataFrame:
    """``(site, url, link, position)``, one row per address a page links to."""
    pages = page_addresses(responses, follow_external)
    links = F.transform("links", lambda link: link)
    return pages.select("site", "url", F.posexplode(links).alias("position", "link"))
