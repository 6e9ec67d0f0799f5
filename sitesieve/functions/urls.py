"""URL handling as column expressions: split, join (RFC 3986 as Python's ``urljoin`` applies it), query keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_HIERARCHICAL = ("http", "https")
# Leading control characters and blanks are ignored, tab and line ends are dropped anywhere.
_LEADING = r"^[\x00-\x20]+"
_DROPPED = r"[\t\r\n]"

# References that need nothing but the origin in front: an absolute path without dot segments, path parameters,
# or empty query or fragment.
_PLAIN_PATH = r"^/(?![/])[^?#;\t\r\n]*(?:\?[^#\t\r\n]+)?(?:#[^\t\r\n]+)?$"


def clean(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, _LEADING, ""), _DROPPED, "")


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(clean(url), _SCHEME, 1))


def site_of(url: Column) -> Column:
    """The netloc, as written (no lower-casing, port and user info kept)."""
    return F.regexp_extract(clean(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def _parts_of_rest(rest: Column) -> dict[str, Column]:
    """Split what follows the scheme. ``path`` still carries its parameters."""
    return {
        "netloc": F.regexp_extract(rest, r"^//([^/?#]*)", 1),
        "path": F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1),
        "query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1),
        "fragment": F.regexp_extract(rest, r"(?s)^[^#]*#(.*)$", 1),
    }


def _without_params(path: Column) -> Column:
    return F.regexp_replace(path, r";[^/]*$", "")


def _params(path: Column) -> Column:
    return F.regexp_extract(path, r";([^/]*)$", 1)


def url_parts(url: Column) -> Column:
    """``struct<url, scheme, netloc, path, params, query, fragment, origin, folder>`` of an absolute URL.

    ``origin`` is scheme and netloc, ``folder`` the path up to its last slash: the two prefixes a join needs.
    """

    def build(cleaned: Column) -> Column:
        rest = F.regexp_replace(cleaned, _SCHEME, "")
        parts = _parts_of_rest(rest)
        path = _without_params(parts["path"])
        scheme = F.lower(F.regexp_extract(cleaned, _SCHEME, 1))
        return F.struct(
            url.alias("url"),
            scheme.alias("scheme"),
            parts["netloc"].alias("netloc"),
            path.alias("path"),
            _params(parts["path"]).alias("params"),
            parts["query"].alias("query"),
            parts["fragment"].alias("fragment"),
            F.concat(scheme, F.lit("://"), parts["netloc"]).alias("origin"),
            F.concat(F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1), F.lit("/")).alias("folder"),
        )

    return let(clean(url), build)


def _suffix(mark: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(mark), text)).otherwise(F.lit(""))


def _remove_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of a path that starts with a slash."""
    empty = F.array().cast("array<string>")

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(segment == ".", kept)
            .otherwise(F.array_append(kept, segment))
        )

    def finish(kept: Column) -> Column:
        closed = F.when(F.rlike(path, F.lit(r"/\.\.?$")), F.array_append(kept, F.lit(""))).otherwise(kept)
        joined = F.array_join(closed, "/")
        return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))

    return F.when(~F.contains(path, F.lit("/.")), path).otherwise(
        let(F.aggregate(F.split(path, "/"), empty, step), finish)
    )


def url_join(base: Column, ref: Column) -> Column:
    """Resolve ``ref`` against ``base``, a :func:`url_parts` struct of an http(s) page URL."""
    origin = base["origin"]

    def recompose(path: Column, params: Column, query: Column, fragment: Column) -> Column:
        return F.concat(origin, path, _suffix(";", params), _suffix("?", query), _suffix("#", fragment))

    def resolve(split: Column) -> Column:
        parts = _parts_of_rest(split["rest"])
        path = _without_params(parts["path"])
        params = _params(parts["path"])
        rooted = F.when(path.startswith("/"), path).otherwise(
            F.regexp_replace(F.concat(base["folder"], path), r"/{2,}", "/")
        )
        elsewhere = F.concat(
            base["scheme"],
            F.lit("://"),
            parts["netloc"],
            path,
            _suffix(";", params),
            _suffix("?", parts["query"]),
            _suffix("#", parts["fragment"]),
        )
        same_document = recompose(
            base["path"],
            base["params"],
            F.when(parts["query"] != "", parts["query"]).otherwise(base["query"]),
            parts["fragment"],
        )
        return (
            F.when((split["scheme"] != "") & (split["scheme"] != base["scheme"]), ref)
            .when(parts["netloc"] != "", elsewhere)
            .when((path == "") & (params == ""), same_document)
            .otherwise(let(rooted, lambda p: recompose(_remove_dots(p), params, parts["query"], parts["fragment"])))
        )

    def split(cleaned: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(cleaned, _SCHEME, 1)).alias("scheme"),
            F.regexp_replace(cleaned, _SCHEME, "").alias("rest"),
        )

    return (
        F.when(ref == "", base["url"])
        .when(~base["scheme"].isin(*_HIERARCHICAL), ref)
        .when(F.rlike(ref, F.lit(_PLAIN_PATH)) & ~F.contains(ref, F.lit("/.")), F.concat(origin, ref))
        .otherwise(let(let(clean(ref), split), resolve))
    )


def page_address(url: Column) -> Column:
    """The identity of a page for link following: no parameters and no fragment, query kept."""
    return let(
        url_parts(url),
        lambda p: F.concat(p["scheme"], F.lit("://"), p["netloc"], p["path"], _suffix("?", p["query"])),
    )


def unquote_plus(text: Column) -> Column:
    """Decode ``+`` and percent escapes; escapes that are none stay as they are."""
    guarded = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(guarded), text)


def query_pairs(url: Column) -> Column:
    """``array<struct<name, value>>`` of the query of ``url``; blank values are dropped, only ``&`` separates."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    netloc = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    # A bracketed host must be an IP literal, otherwise the URL does not parse at all.
    unparsable = F.rlike(netloc, F.lit(r"[\[\]]")) & ~F.rlike(netloc, F.lit(r"^[^\[\]]*\[[0-9A-Fa-f:.]+\]"))
    pairs = F.filter(
        F.split(F.when(unparsable, F.lit("")).otherwise(query), "&"), lambda pair: F.rlike(pair, F.lit(r"(?s)^[^=]*=."))
    )
    return F.transform(
        pairs,
        lambda pair: F.struct(
            unquote_plus(F.substring_index(pair, "=", 1)).alias("name"),
            unquote_plus(F.regexp_replace(pair, "^[^=]*=", "")).alias("value"),
        ),
    )
