"""Host names of the page's own organisation that a page mentions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import any_literal, contains_any, dialect, find_all, let
from .candidates import each, prefixed, together
from .page import Page

# Third-party hosts.
THIRD_PARTIES = (
    "googleapis.com", "gstatic.com", "google.com", "google-analytics.com", "googletagmanager.com", "facebook.com",
    "facebook.net", "twitter.com", "youtube.com", "ytimg.com", "cloudflare.com", "amazonaws.com", "cloudfront.net",
    "github.com", "github.io", "githubassets.com", "jsdelivr.net", "unpkg.com", "cdnjs.cloudflare.com", "w3.org",
    "schema.org", "sentry.io", "newrelic.com", "fonts.googleapis.com", "fonts.gstatic.com", "apache.org",
    "jquery.com", "wordpress.org",
)
# A label with its dot; a host name has any number of them. Possessive repetition needs no stack for them.
LABEL = r"[a-zA-Z0-9][-a-zA-Z0-9]*+\."
LABELS = f"(?:{LABEL})++"
# Labels up to the last place where two letters follow.
HOST_IN_URL = f"https?://(?:(?:{LABEL}(?![a-zA-Z]{{2}}))*+{LABEL}(?=[a-zA-Z]{{2}}))++[a-zA-Z]{{2,}}+"


def own_name(netloc: Column) -> Column:
    """The label before the last one, or the whole name if it has no dot."""
    labels = F.split(netloc, r"\.")
    return F.when(F.size(labels) > 1, F.get(labels, F.size(labels) - 2)).otherwise(netloc)


def _ends_word(text: Column, own: Column) -> Column:
    """Whether the word ends behind ``own``, with which the text begins."""
    around = F.substr(text, F.length(own), F.lit(2))
    # A site without a name is followed by a word that begins.
    return F.when(own == "", F.rlike(text, F.lit(r"(?U)^\w"))).otherwise(F.rlike(around, F.lit(r"(?Us)^.\b")))


def _named_host(text: Column, own: Column, whole_word: bool) -> Column:
    """The longest host at the beginning of a text that consists of labels and the site's own name, or null.

    The name stands where a label could go on, so it is compared with what follows each dot.
    """

    def within(labels: Column) -> Column:
        parts = F.split(F.rtrim(labels, F.lit(".")), r"\.")
        rest = F.substr(text, F.length(labels) + 1)
        # What follows the first label, the second, and so on; the last is what follows all of them.
        following = F.concat(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.concat(x, F.lit("."))), F.array(rest))
        fits = F.transform(
            following,
            lambda x, i: F.when(F.startswith(x, own) & (_ends_word(x, own) if whole_word else F.lit(True)), i + 1),
        )
        number = F.array_max(fits)
        return F.when(number.isNotNull(), F.concat_ws(".", F.slice(parts, F.lit(1), number), own))

    return let(F.regexp_extract(text, f"^{LABELS}", 0), lambda labels: F.when(labels != "", within(labels)))


def _in_quotes(html: Column, own: Column) -> Column:
    """The last label, with its dot, of every quoted host that ends with the site's own name.

    A quote that ends one host can't begin the next.
    """
    name = F.concat(F.lit("."), own)

    def last_label(piece: Column, i: Column, number: Column) -> Column:
        labels = F.left(piece, F.length(piece) - F.length(own))
        inside = (i > 0) & (i < number - 1) & F.endswith(piece, name)
        host = F.rlike(labels, F.lit(f"^{LABELS}$"))
        return F.when(inside & host, F.struct(i.alias("at"), F.substring_index(F.rtrim(labels, F.lit(".")), ".", -1).alias("label")))

    found = let(
        F.split(html, '"'), lambda pieces: F.array_compact(F.transform(pieces, lambda p, i: last_label(p, i, F.size(pieces))))
    )
    kept = F.aggregate(
        found,
        F.struct(F.lit(-2).alias("last"), F.array().cast("array<string>").alias("labels")),
        lambda state, x: F.when(x["at"] == state["last"] + 1, state).otherwise(
            F.struct(x["at"].alias("last"), F.concat(state["labels"], F.array(F.concat(x["label"], F.lit(".")))).alias("labels"))
        ),
    )
    return kept["labels"]


def subdomains(page: Page) -> Column:
    netloc = page.base["netloc"]
    own = own_name(netloc)

    def after(split_at: str, whole_word: bool = False) -> Column:
        """Hosts with the site's own name behind each place where the page is split."""
        return F.array_compact(
            F.transform(
                F.slice(F.split(page.html, split_at), F.lit(2), F.length(page.html) + 1), lambda t: _named_host(t, own, whole_word)
            )
        )

    def names(rule: int, source: str, found: Column, when: Column, label: str, keep=None) -> Column:
        return each(
            found,
            when=when,
            keep=keep,
            rule=rule,
            type="subdomain",
            source=source,
            value=lambda m: m,
            context=lambda m: prefixed(label, m),
            once=True,
        )

    mentioned = F.contains(page.html, F.concat(F.lit("."), own))
    hosts = F.transform(find_all(page.html, HOST_IN_URL), lambda m: F.regexp_replace(m, "^https?://", ""))
    return together(
        names(
            0,
            "html_subdomain",
            hosts,
            contains_any(page.html, "://"),
            "URL reference: ",
            lambda m: ~F.rlike(m, F.lit(any_literal(THIRD_PARTIES))) & F.contains(m, own) & (m != netloc),
        ),
        names(
            1,
            "email_subdomain",
            after("@", whole_word=True),
            contains_any(page.html, "@") & mentioned,
            "Email domain: ",
        ),
        names(
            2,
            "comment_subdomain",
            # Before ">" the first mark leads nowhere, and the second may begin within it.
            after(dialect(r"(?:<!--(?!>)|-->)\s*")),
            contains_any(page.html, "<!--", "-->") & mentioned,
            "Comment reference: ",
        ),
        names(
            3,
            "json_subdomain",
            _in_quotes(page.html, own),
            mentioned,
            "JSON/meta reference: ",
        ),
    )
