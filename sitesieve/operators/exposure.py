"""What a page gives away in its scripts, comments, tokens and forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.encoding import base64_text, claim, claim_kind, token_part, token_text
from ..functions.tables import table
from ..functions.text import (
    any_literal,
    case_fold,
    contains_any,
    count_of,
    cut,
    find_all,
    find_groups,
    let,
    matches,
    strip,
)
from .candidates import each, no_candidates, prefixed, single, singles, together
from .page import Page

# Word lists and patterns.
REDIRECT_PARAMETERS = (
    "redirect", "redirect_url", "redirect_uri", "return_url", "return_to", "next", "continue", "dest", "destination",
    "redir", "redirect_to", "goto", "url", "link", "go", "out", "view", "to", "ref", "rurl", "return", "returnTo",
    "checkout_url", "return_uri",
)
REDIRECT_CALL = r"(?:window\.location|location\.href|location\.replace|location\.assign)\s*[=(]\s*['\"`]"
CREDENTIALS = (
    r"(?:https?://)([a-zA-Z0-9._-]{3,}):([a-zA-Z0-9._-]{3,})@([a-zA-Z0-9._-]+\.[a-zA-Z]{2,})"
)
PLACEHOLDER_USERS = ("user", "admin", "root", "test", "guest", "demo", "null")
PLACEHOLDER_HOSTS = ("schema.org", "example.com", "localhost", "127.0.0.1")
BASE64 = r"""['"`]([A-Za-z0-9+/]{50,}={0,2})['"`]"""
SECRET_WORDS = ("password", "secret", "token", "key", "api", "auth")
RISKY_CALLS = (
    (r"eval\s*\(", "eval() call", "high"),
    (r"Function\s*\(", "Function constructor", "high"),
    (r"document\.write\s*\(", "document.write()", "medium"),
    (r"innerHTML\s*=", "innerHTML assignment", "low"),
    (r"postMessage\s*\(", "postMessage (check origin)", "low"),
)
GRAPHQL_SIGNS = (
    (r"graphql", "GraphQL endpoint reference"),
    (r"graphiql", "GraphiQL IDE (introspection enabled)"),
    (r"__schema", "GraphQL introspection query"),
    (r"query\s*\{", "GraphQL query"),
    (r"mutation\s*\{", "GraphQL mutation"),
)
COMMENT = r"<!--((?s:.)*?)-->"
COMMENT_WORDS = (
    "todo", "fixme", "hack", "bug", "password", "secret", "token", "api", "key", "admin", "debug", "test", "internal",
    "staging", "deprecated", "remove", "delete", "temp", "temporary",
)
JWT = r"eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}"
HMAC_ALGORITHMS = ("HS256", "HS384", "HS512")
CSRF_FIELD = r"""name=["'](?:csrf|_token|csrf_token|authenticity_token|__RequestVerificationToken)"""


def open_redirects(page: Page) -> Column:
    """Form targets and script navigations that name a redirect parameter; one row per match."""
    # All form targets and navigations of the page in a short text each, on which the searches by parameter then run. One may
    # begin at the quote that ends the one before, so neighbours of that kind are kept in one piece.
    targets = F.array_join(
        find_all(page.html, r"""action=["'][^"']*(?:(?<=action=)["'][^"']*(?=["']))*+["']""", ignore_case=True), "\n"
    )
    places = F.array_join(
        find_all(page.html, rf"""{REDIRECT_CALL}(?:[^'"wl]++|{REDIRECT_CALL}|[^'"])*+['"]?""", ignore_case=True), "\n"
    )
    has_form = contains_any(page.fold, "action=")
    has_call = contains_any(page.fold, "location") & matches(page.html, REDIRECT_CALL, ignore_case=True)

    def by_name(text: Column, before: str, after: str) -> Column:
        def search(i: int, name: str, short: Column, folded: Column) -> Column:
            found = find_all(short, before + name + after, ignore_case=True)
            rows = F.transform(
                found, lambda m: F.struct(F.lit(i).alias("ord"), F.lit(name).alias("name"), m.alias("text"))
            )
            none = F.array().cast("array<struct<ord:int,name:string,text:string>>")
            return F.when(F.contains(folded, F.lit(name.lower())), rows).otherwise(none)

        return let(
            F.struct(text.alias("short"), case_fold(text, F.lower(text)).alias("folded")),
            lambda t: F.concat(*(search(i, n, t["short"], t["folded"]) for i, n in enumerate(REDIRECT_PARAMETERS))),
        )

    form_targets = each(
        by_name(targets, r"""action=["'][^"']*""", r"""[^"']*["']"""),
        when=has_form,
        rule=lambda m: m["ord"] * 2,
        type="endpoint",
        source="open_redirect",
        severity="medium",
        value=lambda m: prefixed("Open redirect form: ", m["name"]),
        context=lambda m: cut(m["text"], 100),
        metadata={"parameter": lambda m: m["name"], "location": "form"},
    )
    navigations = each(
        by_name(places, rf"""{REDIRECT_CALL}[^'"]*""", r"""[^'"]*['"`]"""),
        when=has_call,
        rule=lambda m: m["ord"] * 2 + 1,
        type="endpoint",
        source="open_redirect_js",
        severity="medium",
        value=lambda m: prefixed("Open redirect JS: ", m["name"]),
        context=lambda m: cut(m["text"], 100),
        metadata={"parameter": lambda m: m["name"], "location": "javascript"},
    )
    return together(form_targets, navigations)


def script_secrets(page: Page) -> Column:
    """Credentials in URLs, encoded secrets and risky calls in script bodies of 50 characters and more."""
    bodies = F.filter(
        F.transform(page.scripts, lambda s, i: F.struct(i.alias("i"), s.alias("text"))),
        lambda s: F.length(s["text"]) >= 50,
    )

    def over_bodies(search) -> Column:
        return F.flatten(
            F.transform(
                bodies, lambda b: F.transform(search(b), lambda m: F.struct(b["i"].alias("i"), m.alias("m")))
            )
        )

    def credential_text(m: Column) -> Column:
        return F.concat(
            F.lit("Creds in URL: "), m["m"]["g1"], F.lit(":"), cut(m["m"]["g2"], 20), F.lit("@"), m["m"]["g3"]
        )

    credentials = each(
        over_bodies(lambda b: find_groups(b["text"], CREDENTIALS, 3)),
        when=contains_any(page.html, "@"),
        keep=lambda m: ~F.lower(m["m"]["g1"]).isin(*PLACEHOLDER_USERS)
        & ~F.lower(m["m"]["g3"]).isin(*PLACEHOLDER_HOSTS)
        & ~F.contains(m["m"]["g2"], F.lit("."))
        & ~F.contains(m["m"]["g2"], F.lit("/")),
        rule=lambda m: m["i"] * 10,
        type="secret",
        source="js_url_credentials",
        severity="critical",
        value=credential_text,
        context=lambda m: cut(m["m"]["g0"], 100),
    )
    decoded = F.transform(
        over_bodies(lambda b: find_all(b["text"], BASE64, 1)),
        lambda m: F.struct(m["i"].alias("i"), m["m"].alias("encoded"), base64_text(m["m"]).alias("text")),
    )
    encoded = each(
        decoded,
        keep=lambda m: contains_any(F.lower(m["text"]), *SECRET_WORDS),
        rule=lambda m: m["i"] * 10 + 1,
        type="secret",
        source="js_base64_secret",
        severity="high",
        value=lambda m: F.concat(F.lit("Base64: "), cut(m["text"], 60), F.lit("...")),
        context=lambda m: F.concat(F.lit("Encoded: "), cut(m["encoded"], 50), F.lit("...")),
        once=True,
        key=lambda m: m["encoded"],
        metadata={"decoded": lambda m: cut(m["text"], 100)},
    )

    def risks(b: Column) -> Column:
        # Patterns stand as literals here, so that each is compiled once per task and not once per script.
        tests = [F.when(matches(b["text"], p, ignore_case=True), F.lit(i)) for i, (p, _, _) in enumerate(RISKY_CALLS)]
        return F.transform(F.array_compact(F.array(*tests)), lambda i: F.get(calls, i))

    calls = table("what:string,level:string", [(what, level) for _, what, level in RISKY_CALLS])
    risky = each(
        over_bodies(risks),
        rule=lambda m: m["i"] * 10 + m["m"]["ord"] + 2,
        type="info",
        source="js_analysis",
        severity=lambda m: m["m"]["level"],
        value=lambda m: m["m"]["what"],
        context=lambda m: F.concat(F.lit("Found "), m["m"]["what"], F.lit(" in inline script")),
    )
    return F.when(F.size(page.scripts) > 0, together(credentials, encoded, risky)).otherwise(no_candidates())


def graphql(page: Page) -> Column:
    first = None
    for pattern, what in GRAPHQL_SIGNS:
        word = pattern.split("\\")[0]
        test = contains_any(page.fold, word)
        if word != pattern:
            test = test & matches(page.html, pattern, ignore_case=True)
        hit = F.struct(F.lit(pattern).alias("pattern"), F.lit(what).alias("what"))
        first = F.when(test, hit) if first is None else first.when(test, hit)
    return each(
        F.array_compact(F.array(first)),
        type="api_route",
        source="graphql_detection",
        severity="medium",
        value=lambda m: prefixed("GraphQL: ", m["what"]),
        context=lambda m: prefixed("Pattern: ", m["pattern"]),
    )


def comments(page: Page) -> Column:
    stripped = F.transform(find_all(page.html, COMMENT, 1), strip)
    return each(
        stripped,
        when=contains_any(page.html, "<!--"),
        keep=lambda m: (F.length(m) >= 5) & F.rlike(F.lower(m), F.lit(any_literal(COMMENT_WORDS))),
        type="info",
        source="html_comment",
        severity="low",
        value=lambda m: prefixed("HTML comment: ", m, 100),
        context="Interesting comment found in HTML",
        metadata={"comment": lambda m: cut(m, 200)},
    )


def tokens(page: Page) -> Column:
    """Readable JSON web tokens, and what their algorithm says about them."""
    split = F.transform(
        find_all(page.html, JWT),
        lambda t: F.struct(
            t.alias("token"),
            token_part(F.split_part(t, F.lit("."), F.lit(1))).alias("head"),
            token_part(F.split_part(t, F.lit("."), F.lit(2))).alias("body"),
            token_text(F.split_part(t, F.lit("."), F.lit(1))).alias("head_text"),
            token_text(F.split_part(t, F.lit("."), F.lit(2))).alias("body_text"),
        ),
    )
    # An expiry that is no number makes the token unreadable.
    readable = F.filter(
        split,
        lambda t: t["head"].isNotNull()
        & t["body"].isNotNull()
        & ~F.coalesce(F.rlike(claim_kind(t["body"], "exp"), F.lit("^(?:STRING|ARRAY|OBJECT)")), F.lit(False)),
    )
    described = F.transform(
        readable,
        lambda t, i: F.struct(
            i.alias("i"),
            t["token"].alias("token"),
            claim(t["head"], t["head_text"], "alg", "unknown").alias("alg"),
            claim(t["body"], t["body_text"], "iss", "").alias("iss"),
            claim(t["body"], t["body_text"], "sub", "").alias("sub"),
            F.coalesce(F.try_variant_get(t["body"], "$.exp", "double") < 0, F.lit(False)).alias("expired"),
        ),
    )
    has_token = contains_any(page.html, "eyJ")
    analysed = each(
        described,
        when=has_token,
        rule=lambda t: t["i"] * 2,
        type="secret",
        source="jwt_analysis",
        severity="medium",
        value=lambda t: F.concat(
            F.lit("JWT (alg="), t["alg"], F.lit(", iss="), t["iss"], F.lit(", sub="), t["sub"], F.lit(")")
        ),
        context=lambda t: F.concat(F.lit("Token: "), cut(t["token"], 50), F.lit("...")),
        metadata={
            "algorithm": lambda t: t["alg"],
            "issuer": lambda t: t["iss"],
            "subject": lambda t: t["sub"],
            "expired": lambda t: t["expired"],
            "token": lambda t: cut(t["token"], 100),
        },
    )
    unsigned = each(
        described,
        when=has_token,
        keep=lambda t: t["alg"] == "none",
        rule=lambda t: t["i"] * 2 + 1,
        type="secret",
        source="jwt_vulnerability",
        severity="critical",
        value="JWT with alg=none — signature bypass possible",
        context="Token accepts unsigned JWTs",
    )
    symmetric = each(
        described,
        when=has_token,
        keep=lambda t: t["alg"].isin(*HMAC_ALGORITHMS),
        rule=lambda t: t["i"] * 2 + 1,
        type="info",
        source="jwt_hint",
        severity="low",
        value=lambda t: F.concat(F.lit("JWT uses HMAC ("), t["alg"], F.lit(") — test with common secrets")),
        context="Shared-key signature: use a long random key",
    )
    return together(analysed, unsigned, symmetric)


def forms(page: Page) -> Column:
    count = count_of(page.lower, "<form")
    return singles(
        single(
            contains_any(page.lower, 'type="file"', "type='file'"),
            type="parameter",
            source="file_upload",
            severity="medium",
            value="File upload form detected",
            context="Which types, names and sizes the server takes is worth a look",
        ),
        single(
            contains_any(page.fold, "name=") & matches(page.html, CSRF_FIELD, ignore_case=True),
            rule=1,
            type="parameter",
            source="csrf_token",
            value="CSRF token present",
            context="Whether the server checks the token is worth a look",
        ),
        single(
            contains_any(page.lower, "<form") & (count > 3),
            rule=2,
            type="info",
            source="form_analysis",
            severity="low",
            value=F.concat(count.cast("string"), F.lit(" forms detected — test each endpoint")),
        ),
    )
