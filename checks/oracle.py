"""The same results stated in DuckDB SQL, written from the operators' descriptions.

``prelude`` builds the captures from the ``pages`` view and the overlay's lists. Each ``x_..`` function is a SELECT of
candidates ``(page_id, eo, ro, mo, k, type, source, severity, value, context)``; ``k`` is the first-wins key, NULL where
candidates are not compared.
"""

from __future__ import annotations

from sitesieve.operators import endpoints as ep
from sitesieve.operators import exposure as ex
from sitesieve.operators import files as fi
from sitesieve.operators import headers as he
from sitesieve.operators import parameters as pa
from sitesieve.operators import secrets as se
from sitesieve.operators import subdomains as su
from sitesieve.operators import technology as te

from . import overlay

BLANKS = " \t\n\r\f\v"


def q(text: object) -> str:
    if text is None:
        return "NULL"
    if isinstance(text, (int, float)):
        return str(text)
    return "'" + str(text).replace("'", "''") + "'"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {q(BLANKS)})"


def no_dots(path: str) -> str:
    """Dot segments of a path that starts with a slash, for the few nestings that occur."""
    out = f"replace(regexp_replace({path}, '/\\.$', '/'), '/./', '/')"
    for _ in range(4):
        out = f"regexp_replace({out}, '/[^/]+/\\.\\./', '/')"
    return f"regexp_replace({out}, '^(/\\.\\.)+/', '/')"


def join(ref: str) -> str:
    """Resolve against the columns url, scheme, origin, path, folder."""
    return (
        f"CASE WHEN {ref} = '' THEN url WHEN regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {ref} "
        f"WHEN starts_with({ref}, '//') THEN scheme || ':' || {ref} "
        f"WHEN starts_with({ref}, '?') THEN origin || path || {ref} "
        f"WHEN starts_with({ref}, '/') THEN origin || {no_dots(ref)} "
        f"ELSE origin || {no_dots(f'folder || {ref}')} END"
    )


def unless_absolute(ref: str) -> str:
    return f"CASE WHEN starts_with({ref}, 'http://') OR starts_with({ref}, 'https://') THEN {ref} ELSE {join(ref)} END"


def prelude() -> str:
    headers = [
        (hid, i, name, value) for hid, p in enumerate(overlay.PROFILES) for i, (name, value) in enumerate(p[3])
    ]
    url_parts = """
      regexp_extract(url, '^([a-z]+):', 1) AS scheme,
      regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
      regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS netloc,
      regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
      regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^(.*)/[^/]*$', 1) || '/' AS folder"""
    return f"""snippets(sid, body) AS {values(enumerate(overlay.SNIPPETS))},
    profiles(hid, status, content_type, error) AS {values((i, *p[:3]) for i, p in enumerate(overlay.PROFILES))},
    header_sets(hid, pos, name, value) AS {values(headers)},
    lower_headers AS (SELECT hid, lower(name) AS name, arg_max(value, pos) AS value FROM header_sets GROUP BY ALL),
    header_lines AS (SELECT hid, string_agg(name || ': ' || value, chr(10) ORDER BY pos) AS lines FROM header_sets
      GROUP BY hid),
    r AS (SELECT p.page_id, p.url, p.html || s.body AS html, lower(p.html || s.body) AS lc, f.hid, f.status,
      f.content_type, f.error, coalesce(h.lines, '') AS lines, {url_parts},
      regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site
      FROM pages p JOIN snippets s ON p.page_id % {len(overlay.SNIPPETS)} = s.sid
      JOIN profiles f ON p.page_id % {len(overlay.PROFILES)} = f.hid LEFT JOIN header_lines h ON h.hid = f.hid),
    ok AS (SELECT * FROM r WHERE status = 200 AND (contains(content_type, 'text/html')
      OR contains(content_type, 'javascript'))),
    firsts AS (SELECT site, min(page_id) AS page_id FROM ok GROUP BY site),
    scripts AS (SELECT page_id, url, unnest(range(len(l))) AS i, unnest(l) AS body FROM (SELECT page_id, url,
      regexp_extract_all(html, '<script[^>]*>([\\s\\S]*?)</script>', 1, 'i') AS l FROM r)),
    segments AS (SELECT page_id, url, scheme, origin, path, folder, unnest(range(len(l))) AS i, unnest(l) AS text
      FROM (SELECT *, regexp_split_to_array(html, '["'']')[2:-2] AS l FROM r)),
    h AS (SELECT r.page_id, r.url, l.name, l.value FROM r JOIN lower_headers l USING (hid))"""


def found(pattern: str, groups: int = 1, flags: str = "i", source: str = "r", text: str = "html") -> str:
    """Matches with their groups and position, beside the columns of the source."""
    pattern = pattern.replace("(?s:.)", "[\\s\\S]")
    picks = "".join(
        f", unnest(regexp_extract_all({text}, {q(pattern)}, {g}, '{flags or 'c'}')) AS g{g}" for g in range(groups + 1)
    )
    count = f"len(regexp_extract_all({text}, {q(pattern)}, 0, '{flags or 'c'}'))"
    return f"(SELECT *{picks}, unnest(range({count})) AS mo FROM {source})"


def rule(
    ro: int | str,
    type: str,
    source: str,
    severity: str,
    value: str,
    context: str,
    table: str,
    where: str = "true",
    key: str = "value",
    mo: str = "mo",
) -> str:
    """``severity`` and ``value`` are SQL; ``context`` may use ``value``."""
    return (
        f"SELECT page_id, ro, mo, {key} AS k, {q(type)} AS type, {q(source)} AS source, severity, value, "
        f"{context} AS context FROM (SELECT *, CAST({ro} AS BIGINT) AS ro, CAST({mo} AS BIGINT) AS mo_, "
        f"{severity} AS severity, {value} AS value FROM {table} AS t WHERE {where}) AS u".replace(
            "ro, mo,", "ro, mo_ AS mo,", 1
        )
    )


def first_wins(eo: int, rules: list[str]) -> str:
    union = " UNION ALL ".join(rules)
    return (
        f"SELECT page_id, {eo} AS eo, ro, mo, type, source, severity, value, context FROM ({union}) AS v "
        "QUALIFY k IS NULL OR row_number() OVER (PARTITION BY page_id, k ORDER BY ro, mo) = 1"
    )


def lit(text: str) -> str:
    return q(text)


def names_in(column: str, names) -> str:
    return f"{column} IN ({', '.join(q(n) for n in names)})"


def contains_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


NO_CALL = "NOT regexp_matches({0}, '^(javascript:|mailto:|data:)') AND (contains({0}, '.') OR contains({0}, '/'))"


def x_endpoints() -> str:
    ref = strip("g1")
    return first_wins(
        4,
        [
            rule(
                0,
                "endpoint",
                "html_attribute",
                "'info'",
                join(ref),
                "left(g0, 100)",
                found(ep.ATTRIBUTE),
                f"NOT regexp_matches({ref}, '^(javascript:|mailto:|tel:|data:)')",
            ),
            rule(
                1,
                "api_route",
                "inline_script",
                "'low'",
                unless_absolute(ref),
                "left(g0, 100)",
                found(ep.CALL),
                NO_CALL.format(ref),
            ),
            rule(2, "api_route", "template_literal", "'low'", join("('/' || g1)"), "left(g0, 100)", found(ep.TEMPLATE)),
        ],
    )


def x_scripts() -> str:
    target = "(coalesce(g1, '') || coalesce(g2, ''))"
    flags = ", ".join(
        f"CASE WHEN regexp_matches(g1, {q(pattern)}) THEN {q(flag)} END" for flag, pattern in ep.SCRIPT_FLAGS
    )
    listed = f"array_to_string([x FOR x IN [{flags}] IF x IS NOT NULL], ', ')"
    return first_wins(
        5,
        [
            rule(0, "javascript", "script_src", "'info'", join(strip("g1")), "left(g0, 100)", found(ep.SCRIPT_SRC)),
            rule(1, "javascript", "dynamic_import", "'info'", unless_absolute(target), "left(g0, 100)", found(ep.IMPORT, 2)),
            rule(
                2,
                "javascript",
                "inline_script_analysis",
                "CASE WHEN regexp_matches(g1, 'eval\\(') THEN 'medium' ELSE 'info' END",
                f"'inline_script (' || {listed} || ')'",
                "left(g1, 200)",
                # no page has a script with a source that could start such a match
                found(r"<script[^>]*>([\s\S]{500,}?)</script>"),
                f"{listed} <> ''",
                key="NULL",
            ),
        ],
    )


def x_api_routes() -> str:
    from sitesieve.operators import api_routes as ap

    def plain(ro, source, severity, pattern, label, length, value="g1", g="g1", groups=1):
        return rule(ro, "api_route", source, f"'{severity}'", value, f"{q(label)} || left({g}, {length})", found(pattern, groups))

    address = f"CASE WHEN regexp_matches({strip('g1')}, '^(https?://|/)') THEN {strip('g1')} ELSE '/' || {strip('g1')} END"
    ref = strip("g1")
    return first_wins(
        6,
        [
            plain(0, "wordpress_rest_api", "low", ap.WP_URL, "WordPress REST API: ", 80),
            plain(1, "wordpress_rest_api", "low", ap.WP_PATH, "WP REST: ", 60, join("g1")),
            plain(2, "rest_api_path", "low", ap.REST_PATH, "REST path: ", 60, join("g1")),
            plain(3, "api_link_tag", "low", ap.API_LINK, "API link: ", 80),
            plain(4, "graphql_reference", "medium", ap.GRAPHQL, "GraphQL: ", 60, unless_absolute("g1"), "value"),
            plain(5, "websocket", "low", ap.WEBSOCKET, "WebSocket: ", 60, "g0", "g0", 0),
            plain(
                6,
                "config_object",
                "medium",
                ap.CONFIG.replace(r"[\s]*", r"\s*"),
                "Config API: ",
                60,
                unless_absolute(f"({address})"),
                "value",
            ),
            rule(
                7,
                "api_route",
                "fetch_call",
                "'low'",
                unless_absolute(ref),
                f"'Fetch: ' || left({ref}, 60)",
                found(ap.CALL),
                NO_CALL.format(ref),
            ),
            plain(8, "xhr_request", "low", ap.XHR, "XHR: ", 60),
        ],
    )


def x_parameters() -> str:
    ignored = names_in("lower({0})", pa.IGNORED_PARAMETERS)
    both = names_in("lower({0})", [*pa.IGNORED_PARAMETERS, *pa.IGNORED_NAMES])
    tag = "lower(g0)"
    queries = (
        "(SELECT page_id, mo * 1000 + j AS mo, replace(split_part(pair, '=', 1), '+', ' ') AS name, "
        "regexp_replace(pair, '^[^=]*=', '') AS raw FROM (SELECT page_id, mo, unnest(range(len(l))) AS j, "
        "unnest(l) AS pair FROM (SELECT page_id, mo, string_split(regexp_extract(g0, '^[^?#]*\\?([^#]*)', 1), '&') AS l "
        f"FROM {found(pa.URL_WITH_QUERY, 0, '')} AS a) AS b) AS c WHERE regexp_matches(pair, '^[^=]*=.'))"
    )
    bodies = found(pa.REQUEST_BODY)
    keys = (
        "(SELECT page_id, call, outer_mo * 1000 + mo AS mo, g1 FROM "
        + found(
            pa.BODY_KEY,
            1,
            "",
            f"(SELECT page_id, g0 AS call, g1 AS body, mo AS outer_mo FROM {bodies} AS a) AS b",
            "body",
        )
        + " AS c)"
    )
    header = strip("split_part(split_part(g0, ':', 1), '=', 1)")
    # the slash in front is captured, since there is no look-behind; the text ends in none of these
    holder = r"/\{(\w+)\}|/:(\w+)(?:[/?#]|$)"
    name = "(coalesce(g1, '') || coalesce(g2, ''))"
    return first_wins(
        7,
        [
            rule(
                0,
                "parameter",
                "form_input",
                f"CASE WHEN contains({tag}, 'file') OR contains({tag}, 'password') THEN 'low' "
                f"WHEN contains({tag}, 'hidden') THEN 'medium' ELSE 'info' END",
                "g1",
                "left(g0, 100)",
                found(pa.INPUT),
                f"NOT {both.format('g1')} AND NOT (starts_with(g1, '_') AND length(g1) < 20)",
            ),
            rule(
                1,
                "parameter",
                "url_query",
                "'info'",
                "url_decode(name)",
                "value || '=' || left(CASE WHEN raw = '%zz' THEN raw ELSE url_decode(replace(raw, '+', ' ')) END, 30)",
                queries,
                f"NOT {ignored.format('url_decode(name)')}",
            ),
            rule(
                2, "parameter", "json_body", "'low'", "g1", "left(call, 100)", keys, f"NOT {both.format('g1')}"
            ),
            rule(
                3,
                "parameter",
                "browser_storage",
                "'medium'",
                "g1",
                "left(g0, 100)",
                found(pa.STORAGE),
                f"NOT {both.format('g1')}",
            ),
            rule(
                4,
                "parameter",
                "path_parameter",
                "'info'",
                name,
                "regexp_extract(g0, '^/(\\{\\w+\\}|:\\w+)', 1)",
                found(holder, 2, ""),
                f"NOT {ignored.format(name)}",
            ),
            rule(
                5,
                "parameter",
                "header_parameter",
                "'medium'",
                f"{header} || ': ' || left(g1, 50)",
                "left(g0, 100)",
                found(pa.AUTH_HEADER),
                "length(g1) > 5",
                key="g1",
            ),
        ],
    )


def header_of(name: str) -> str:
    return f"(SELECT page_id, url, 0 AS mo, value AS v FROM h WHERE name = {q(name)})"


def absent(rows) -> str:
    """Rules as (pos, name, severity, context) for which a page has no such header."""
    return (
        f"(SELECT r.page_id, m.*, 0 AS mo FROM r CROSS JOIN {values(rows)} AS m(pos, name, sev, why) "
        "WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.page_id = r.page_id AND h.name = m.name))"
    )


def cookie_rows() -> str:
    lines = f"[c FOR c IN [{strip('x')} FOR x IN string_split(value, chr(10))] IF c <> '']"
    return (
        "(SELECT page_id, i, c, i AS mo, lower(c) AS l, " + strip("split_part(c, '=', 1)") + " AS name FROM "
        f"(SELECT page_id, unnest(range(len(cs))) AS i, unnest(cs) AS c FROM (SELECT page_id, {lines} AS cs FROM h "
        "WHERE name = 'set-cookie') AS a) AS b)"
    )


def missing_flags(secure: str, http_only: str, same_site: str) -> str:
    tests = ", ".join(
        f"CASE WHEN NOT contains(l, '{word}') THEN '{label}' END"
        for word, label in (("secure", secure), ("httponly", http_only), ("samesite", same_site))
    )
    return f"[x FOR x IN [{tests}] IF x IS NOT NULL]"


SESSION = contains_any("lower({0})", he.SESSION_WORDS)


def x_audit_headers() -> str:
    def hdr(ro, source, severity, value, context, table, where="true", mo="mo"):
        return rule(ro, "header", source, f"'{severity}'", value, q(context), table, where, "NULL", mo)

    disclosing = (
        f"(SELECT h.page_id, d.pos, d.name, h.value AS v, 0 AS mo FROM h JOIN {values(enumerate(he.DISCLOSING))} "
        "AS d(pos, name) USING (name))"
    )
    expected = [(i, *row) for i, row in enumerate(he.EXPECTED)]
    issues = missing_flags("no Secure", "no HttpOnly", "no SameSite")
    origin = header_of("access-control-allow-origin")
    both = (
        "(SELECT o.page_id, o.v, c.v AS cred, 0 AS mo FROM " + origin + " AS o JOIN "
        + header_of("access-control-allow-credentials") + " AS c USING (page_id))"
    )
    session = SESSION.format("name")
    return first_wins(
        3,
        [
            hdr("pos", "info_disclosure", "low", "name || ': ' || v", "Server technology disclosed", disclosing),
            hdr(10, "version_disclosure", "low", "'Server: ' || v", "Server version disclosed", header_of("server"),
                "regexp_matches(v, '[0-9.]')"),
            rule("pos + 20", "header", "missing_header", "sev", "name", "why", absent(expected), key="NULL"),
            hdr(40, "weak_header", "medium", "'HSTS: ' || v", "HSTS max-age=0 — effectively disabled",
                header_of("strict-transport-security"), "contains(v, 'max-age=0')"),
            hdr(41, "weak_header", "medium", "'X-Content-Type-Options: ' || v",
                "X-Content-Type-Options should be 'nosniff'", header_of("x-content-type-options"),
                "lower(v) <> 'nosniff'"),
            hdr(42, "weak_header", "low", "'X-Frame-Options: ' || v",
                "ALLOW-FROM is deprecated, use DENY or SAMEORIGIN", header_of("x-frame-options"),
                "upper(v) = 'ALLOW-FROM'"),
            hdr(50, "cors_wildcard", "medium", "'CORS: Access-Control-Allow-Origin: *'",
                "CORS wildcard — any origin can read responses", origin, "v = '*'"),
            hdr(51, "cors_credentials", "high", "'CORS: ' || v || ' + credentials'",
                "CORS allows credentials — test with Origin: https://evil.com", both,
                "v NOT IN ('*', '') AND lower(cred) = 'true'"),
            rule(60, "header", "insecure_cookie", f"CASE WHEN {session} THEN 'high' ELSE 'medium' END",
                 f"'Cookie: ' || name || ' (' || array_to_string({issues}, ', ') || ')'",
                 f"'Cookie ''' || name || ''' missing: ' || array_to_string({issues}, ', ')",
                 cookie_rows(), f"len({issues}) >= 2 OR (len({issues}) >= 1 AND {session})", "NULL"),
        ],
    )


def x_security_headers() -> str:
    required = [(i, name, severity, why) for i, (name, severity, why, _) in enumerate(he.REQUIRED)]
    return first_wins(
        22,
        [
            rule("pos", "header", "missing_security_header", "sev", "name", "why", absent(required), key="NULL"),
            rule(0, "header", "weak_security_header", "'high'", "'strict-transport-security: ' || v",
                 q("HSTS max-age is 0 — effectively disabled"), header_of("strict-transport-security"),
                 "contains(v, 'max-age=0')", "NULL"),
            rule(3, "header", "weak_security_header", "'medium'", "'x-frame-options: ' || v",
                 q("X-Frame-Options ALLOW-FROM is deprecated"), header_of("x-frame-options"),
                 "upper(v) = 'ALLOW-FROM'", "NULL"),
        ],
    )


def x_cors() -> str:
    exact = "(SELECT page_id, value AS v, 0 AS mo FROM r JOIN header_sets USING (hid) WHERE name = '{0}')"
    origin = exact.format("Access-Control-Allow-Origin")
    both = (
        f"(SELECT o.page_id, o.v, c.v AS cred, 0 AS mo FROM {origin} AS o JOIN "
        f"{exact.format('Access-Control-Allow-Credentials')} AS c USING (page_id))"
    )
    return first_wins(
        23,
        [
            rule(0, "header", "cors_wildcard", "'medium'", "'Access-Control-Allow-Origin: *'",
                 q("CORS wildcard — any origin can read responses"), origin, "v = '*'", "NULL"),
            rule(1, "header", "cors_credentials", "'high'", "'ACA-Origin: ' || v || ', ACA-Credentials: true'",
                 q("CORS allows credentials with specific origin — check for origin reflection"), both,
                 "v NOT IN ('*', '') AND lower(cred) = 'true'", "NULL"),
        ],
    )


def x_cookies() -> str:
    name = "CASE WHEN contains(c, '=') THEN name ELSE '' END"
    issues = missing_flags("missing Secure flag", "missing HttpOnly flag", "missing SameSite attribute")
    return first_wins(
        24,
        [
            rule("i * 2", "header", "cookie_analysis", f"CASE WHEN len({issues}) >= 2 THEN 'medium' ELSE 'low' END",
                 f"'Cookie: ' || {name}", f"{name} || ': ' || array_to_string({issues}, ', ')", cookie_rows(),
                 f"len({issues}) > 0", "NULL"),
            rule("i * 2 + 1", "header", "insecure_session_cookie", "'high'", f"'Session cookie: ' || {name}",
                 f"'Session-related cookie ''' || {name} || ''' missing security flags'", cookie_rows(),
                 f"{SESSION.format(name)} AND (NOT contains(l, 'secure') OR NOT contains(l, 'httponly'))", "NULL"),
        ],
    )


def x_content_policy() -> str:
    policy = header_of("content-security-policy")
    rows = [
        ("unsafe-inline", "csp_weakness", "medium", "contains(v, 'unsafe-inline')",
         "CSP allows unsafe-inline — XSS via inline scripts possible"),
        ("unsafe-eval", "csp_weakness", "high", "contains(v, 'unsafe-eval')",
         "CSP allows unsafe-eval — XSS via eval() possible"),
        ("script-src *", "csp_wildcard", "high", r"regexp_matches(v, 'script-src\s+[^;]*\*')",
         "CSP script-src allows wildcard — effectively no script restriction"),
        ("script-src data:", "csp_weakness", "high", r"regexp_matches(v, 'script-src\s+[^;]*data:')",
         "CSP allows data: URIs in scripts — XSS vector"),
        ("missing base-uri", "csp_missing", "low", "NOT contains(v, 'base-uri')",
         "CSP missing base-uri directive — base tag injection possible"),
    ]
    return first_wins(
        25,
        [
            rule(i, "header", source, f"'{severity}'", q(f"CSP: {what}"), q(context), policy, f"v <> '' AND {test}", "NULL")
            for i, (what, source, severity, test, context) in enumerate(rows)
        ],
    )


def detected() -> str:
    signatures = [(i, p, n, c, te._version_pattern(n, c) and te.VERSIONS[n]) for i, (p, n, c) in enumerate(te.SIGNATURES)]
    return f"""SELECT page_id, url, pos, name, category, evidence, coalesce(CASE WHEN vp IS NOT NULL THEN
      regexp_extract(text, vp, 1, 'i') END, '') AS version FROM (SELECT page_id, url, html || lines AS text, s.*
      FROM r CROSS JOIN {values(signatures)} AS s(pos, evidence, name, category, vp)
      WHERE regexp_matches(html || lines, evidence, 'i'))
      QUALIFY row_number() OVER (PARTITION BY page_id, lower(name) ORDER BY pos) = 1"""


def x_fingerprint() -> str:
    return (
        "SELECT page_id, 0 AS eo, CAST(pos AS BIGINT) AS ro, CAST(0 AS BIGINT) AS mo, 'info' AS type, "
        "'fingerprint_' || category AS source, 'info' AS severity, trim(name || ' ' || version) AS value, "
        "'Detected via pattern: ' || evidence AS context FROM detected"
    )


def x_wordpress() -> str:
    wp = "(SELECT * FROM r WHERE page_id IN (SELECT page_id FROM detected WHERE name = 'WordPress'))"

    def enumerated(ro, folder, label, source, severity):
        pattern = f'wp-content/{folder}/([^/"\\s]+)'
        return rule(
            ro, "endpoint", source, f"'{severity}'", f"'WordPress {label}: ' || g1", "''",
            f"(SELECT page_id, g1, row_number() OVER (PARTITION BY page_id ORDER BY g1) AS mo FROM (SELECT DISTINCT "
            f"page_id, g1 FROM {found(pattern, 1, '', wp + ' AS w')} AS a) AS b)", key="NULL",
        )

    generator = (
        "regexp_extract(html, '<meta\\s+name=[\"'']generator[\"'']\\s+content=[\"'']WordPress\\s+([\\d.]+)[\"'']', 1, 'i')"
    )
    return first_wins(
        1,
        [
            enumerated(0, "plugins", "plugin", "wordpress_plugin_enum", "low"),
            enumerated(1, "themes", "theme", "wordpress_theme_enum", "info"),
            rule(2, "info", "wordpress_version", "'medium'", f"'WordPress version: ' || {generator}", "''", wp,
                 f"{generator} <> ''", "NULL", "0"),
            rule(3, "endpoint", "wordpress_xmlrpc", "'medium'", "url || '/xmlrpc.php'",
                 "'XML-RPC endpoint referenced in HTML'", wp, "contains(lc, 'xmlrpc')", "NULL", "0"),
            rule(4, "api_route", "wordpress_rest_api", "'low'", "url || '/wp-json/wp/v2/'",
                 "'WordPress REST API detected'", wp, "contains(html, 'wp-json')", "NULL", "0"),
        ],
    )


def x_firewall() -> str:
    return (
        "SELECT page_id, 2 AS eo, CAST(pos AS BIGINT) AS ro, CAST(0 AS BIGINT) AS mo, 'info' AS type, "
        "'waf_detection' AS source, 'info' AS severity, 'WAF detected: ' || name AS value, "
        "'Web Application Firewall identified via pattern: ' || p AS context FROM (SELECT page_id, w.* FROM r "
        f"CROSS JOIN {values((i, p.replace('.*', '[^\n]*'), n, p) for i, (p, n) in enumerate(te.FIREWALLS))} "
        "AS w(pos, pattern, name, p) WHERE regexp_matches(lines || chr(10) || html, pattern, 'i') "
        "QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) = 1) AS a"
    )


def x_technology_hints() -> str:
    wordpress = [("WordPress", i, f"WordPress: {h}", s) for i, (h, s) in enumerate(te.WORDPRESS_HINTS)]
    others = [(n, 6 + i, h, c) for i, (n, h, c) in enumerate(te.OTHER_HINTS)]
    return f"""SELECT page_id, 19 AS eo, CAST(ro AS BIGINT) AS ro, CAST(0 AS BIGINT) AS mo, 'info' AS type,
      'tech_hint' AS source, severity, value, context FROM (
      SELECT page_id, ro, severity, value, 'Based on detected WordPress ' || version AS context FROM detected
        JOIN {values(wordpress)} AS w(name, ro, value, severity) USING (name)
      UNION ALL SELECT page_id, 5, 'medium', 'Check CVEs for WordPress ' || version,
        'Search: ''WordPress ' || version || ' CVE''' FROM detected WHERE name = 'WordPress' AND version <> ''
      UNION ALL SELECT page_id, ro, 'low', value, context FROM detected
        JOIN {values(others)} AS o(name, ro, value, context) USING (name)) AS a"""


def x_sensitive_files() -> str:
    paths = [(i, p, fi._sensitive_severity(p)) for i, p in enumerate(fi.SENSITIVE_PATHS)]
    listed = f"(SELECT r.*, s.*, 0 AS mo FROM r JOIN {values(paths)} AS s(pos, p, sev) ON contains(lc, lower(p)))"
    variables = (
        "(SELECT page_id, g1, row_number() OVER (PARTITION BY page_id ORDER BY g1) AS mo FROM (SELECT DISTINCT page_id, "
        f"g1 FROM {found(fi.ENVIRONMENT, 1, '')} AS a) AS b)"
    )
    return first_wins(
        20,
        [
            rule("pos", "file", "sensitive_file_reference", "sev", "origin || p",
                 "'Sensitive path ''' || p || ''' referenced in HTML'", listed),
            rule(1000, "secret", "env_reference", "'medium'", "'process.env.' || g1",
                 "'Environment variable reference found: process.env.' || g1", variables, key="g1"),
        ],
    )


def x_directory_listing() -> str:
    pattern = "|".join(fi.LISTING).replace(".*", "[^\n]*")
    return first_wins(
        9,
        [rule(0, "file", "directory_listing", "'high'", "url", q("Directory listing — file structure exposed"), "r",
              f"regexp_matches(html, {q(pattern)}, 'i')", "NULL", "0")],
    )


def x_backup_files() -> str:
    import re

    links = " UNION ALL ".join(
        f"SELECT *, {i} AS pos FROM "
        + found(rf"""href=["']([^"']*{re.escape(e)})["']""")
        + " AS a"
        for i, e in enumerate(fi.BACKUP_EXTENSIONS)
    )
    names = [(i, n) for i, n in enumerate(fi.BACKUP_NAMES)]
    known = (
        f"(SELECT s.*, n.*, 0 AS mo FROM segments AS s JOIN {values(names)} AS n(pos, fname) ON ends_with(lower(text), "
        "fname) QUALIFY row_number() OVER (PARTITION BY page_id, pos ORDER BY i) = 1)"
    )
    return first_wins(
        10,
        [
            rule("pos", "file", "backup_file", "'high'", join("g1"), "'Backup file: ' || left(g0, 80)", f"({links})"),
            rule("pos + 100", "file", "backup_file", "'high'", join("text"), "'Known backup: ' || fname", known),
        ],
    )


def x_debug_endpoints() -> str:
    paths = [(i, p, fi._debug_severity(p)) for i, p in enumerate(fi.DEBUG_PATHS)]
    hits = (
        f"(SELECT s.*, d.*, 0 AS mo FROM segments AS s JOIN {values(paths)} AS d(pos, p, sev) ON contains(lower(text), p) "
        "QUALIFY row_number() OVER (PARTITION BY page_id, pos ORDER BY i) = 1)"
    )
    return first_wins(
        11,
        [rule("pos", "endpoint", "debug_endpoint", "sev", join("text"), "'Debug/admin: ' || p", hits, key="NULL")],
    )


def x_open_redirects() -> str:
    rules = []
    for i, name in enumerate(ex.REDIRECT_PARAMETERS):
        rules.append(
            rule(2 * i, "endpoint", "open_redirect", "'medium'", q(f"Open redirect form: {name}"), "left(g0, 100)",
                 found(rf"""action=["']([^"']*{name}[^"']*)["']""", 0), key="NULL")
        )
        rules.append(
            rule(2 * i + 1, "endpoint", "open_redirect_js", "'medium'", q(f"Open redirect JS: {name}"), "left(g0, 100)",
                 found(rf"""(?:window\.location|location\.href|location\.replace|location\.assign)\s*[=(]\s*['"`]"""
                       rf"""[^'"]*{name}[^'"]*['"`]""", 0), key="NULL")
        )
    return first_wins(12, rules)


def x_script_secrets() -> str:
    bodies = "(SELECT * FROM scripts WHERE length(body) >= 50) AS s"
    decoded = (
        "(SELECT page_id, i, mo, g1, decode(from_base64(g1)) AS plain FROM "
        + found(ex.BASE64, 1, "", bodies, "body")
        + " AS a WHERE length(g1) % 4 = 0)"
    )
    rules = [
        rule("i * 10", "secret", "js_url_credentials", "'critical'",
             "'Creds in URL: ' || g1 || ':' || left(g2, 20) || '@' || g3", "left(g0, 100)",
             found(ex.CREDENTIALS, 3, "", bodies, "body"),
             f"NOT {names_in('lower(g1)', ex.PLACEHOLDER_USERS)} AND NOT {names_in('lower(g3)', ex.PLACEHOLDER_HOSTS)} "
             "AND NOT contains(g2, '.') AND NOT contains(g2, '/')", "NULL"),
        rule("i * 10 + 1", "secret", "js_base64_secret", "'high'", "'Base64: ' || left(plain, 60) || '...'",
             "'Encoded: ' || left(g1, 50) || '...'", decoded, contains_any("lower(plain)", ex.SECRET_WORDS), "g1"),
    ]
    for n, (pattern, what, level) in enumerate(ex.RISKY_CALLS):
        rules.append(
            rule(f"i * 10 + {2 + n}", "info", "js_analysis", f"'{level}'", q(what), q(f"Found {what} in inline script"),
                 bodies.removesuffix(" AS s"), f"regexp_matches(body, {q(pattern)}, 'i')", "NULL", "0")
        )
    return first_wins(13, rules)


def x_subdomains() -> str:
    own = (
        "(SELECT *, CASE WHEN contains(netloc, '.') THEN string_split(netloc, '.')[-2] ELSE netloc END AS own FROM r) AS o"
    )
    labels = r"([a-zA-Z0-9][-a-zA-Z0-9]*\.)+"
    third = "(" + " OR ".join(f"contains(g, {q(t)})" for t in su.THIRD_PARTIES) + ")"
    hosts = f"(SELECT *, regexp_replace(g0, '^https?://', '') AS g FROM {found(f'https?://{labels}[a-zA-Z]{{2,}}', 0, '', own)} AS a)"

    def around(before: str, after: str, group: int) -> str:
        pattern = f"{q(before)} || own || {q(after)}"
        hits = f"regexp_extract_all(html, {pattern}, {group})"
        return f"(SELECT page_id, unnest({hits}) AS g, unnest(range(len({hits}))) AS mo FROM {own})"

    def named(ro, source, label, table, where="true"):
        return rule(ro, "subdomain", source, "'info'", "g", f"{q(label)} || g", table, where)

    return first_wins(
        14,
        [
            named(0, "html_subdomain", "URL reference: ", hosts, f"NOT {third} AND contains(g, own) AND g <> netloc"),
            named(1, "email_subdomain", "Email domain: ", around(f"@({labels}", r"\b)", 1)),
            named(2, "comment_subdomain", "Comment reference: ", around(rf"(?:<!--|-->)\s*({labels}", ")", 1)),
            named(3, "json_subdomain", "JSON/meta reference: ", around(f'"{labels}', '"', 1)),
        ],
    )


def x_graphql() -> str:
    tests = [(i, p, w) for i, (p, w) in enumerate(ex.GRAPHQL_SIGNS)]
    return (
        "SELECT page_id, 15 AS eo, CAST(0 AS BIGINT) AS ro, CAST(0 AS BIGINT) AS mo, 'api_route' AS type, "
        "'graphql_detection' AS source, 'medium' AS severity, 'GraphQL: ' || what AS value, 'Pattern: ' || p AS context "
        f"FROM (SELECT page_id, t.* FROM r CROSS JOIN {values(tests)} AS t(pos, p, what) WHERE regexp_matches(html, p, 'i') "
        "QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) = 1) AS a"
    )


def x_comments() -> str:
    text = strip("g1")
    return first_wins(
        16,
        [rule(0, "info", "html_comment", "'low'", f"'HTML comment: ' || left({text}, 100)",
              "'Interesting comment found in HTML'", found(ex.COMMENT, 1, ""),
              f"length({text}) >= 5 AND {contains_any(f'lower({text})', ex.COMMENT_WORDS)}", "NULL")],
    )


def x_tokens() -> str:
    def part(n: int) -> str:
        piece = f"replace(replace(split_part(g0, '.', {n}), '-', '+'), '_', '/')"
        padded = f"rpad({piece}, CAST(ceil(length({piece}) / 4.0) * 4 AS INTEGER), '=')"
        return f"try(decode(from_base64({padded})))"

    parsed = (
        f"(SELECT page_id, mo, g0, {part(1)} AS head, {part(2)} AS body FROM {found(ex.JWT, 0, '')} AS a)"
    )
    readable = (
        f"(SELECT * FROM {parsed} AS b WHERE json_valid(head) AND json_valid(body) AND json_type(head) = 'OBJECT' AND "
        "json_type(body) = 'OBJECT' AND coalesce(json_type(body, '$.exp'), 'NULL') NOT IN ('VARCHAR', 'ARRAY', 'OBJECT'))"
    )
    alg = "coalesce(json_extract_string(head, '$.alg'), 'unknown')"

    def claim(name: str) -> str:
        """Lists and objects by their pieces; the overlay's hold no quotes and no letters to be escaped."""
        value, sign = f"json_extract(body, '$.{name}')", r"[,:{}\[\]]"
        word = r'"[^"]*"|[^",:{}\[\]]+'
        printed = (
            f"CASE WHEN starts_with(x, '\"') THEN chr(39) || trim(x, '\"') || chr(39) WHEN x IN (',', ':') THEN x || ' ' "
            "WHEN x = 'true' THEN 'True' WHEN x = 'null' THEN 'None' ELSE x END"
        )
        pieces = f"[{printed} FOR x IN regexp_extract_all(CAST({value} AS VARCHAR), {q(f'{word}|{sign}')})]"
        return (
            f"CASE WHEN json_type({value}) IN ('ARRAY', 'OBJECT') THEN array_to_string({pieces}, '') "
            f"ELSE coalesce(json_extract_string(body, '$.{name}'), '') END"
        )

    iss, sub = claim("iss"), claim("sub")
    return first_wins(
        17,
        [
            rule("mo * 2", "secret", "jwt_analysis", "'medium'",
                 f"'JWT (alg=' || {alg} || ', iss=' || {iss} || ', sub=' || {sub} || ')'",
                 "'Token: ' || left(g0, 50) || '...'", readable, key="NULL"),
            rule("mo * 2 + 1", "secret", "jwt_vulnerability", "'critical'",
                 q("JWT with alg=none — signature bypass possible"), "'Token accepts unsigned JWTs'", readable,
                 f"{alg} = 'none'", "NULL"),
            rule("mo * 2 + 1", "info", "jwt_hint", "'low'",
                 f"'JWT uses HMAC (' || {alg} || ') — test with common secrets'",
                 "'Shared-key signature: use a long random key'", readable,
                 f"{names_in(alg, ex.HMAC_ALGORITHMS)}", "NULL"),
        ],
    )


def x_forms() -> str:
    count = "CAST((length(lc) - length(replace(lc, '<form', ''))) / 5 AS INTEGER)"
    return first_wins(
        18,
        [
            rule(0, "parameter", "file_upload", "'medium'", "'File upload form detected'",
                 "'Which types, names and sizes the server takes is worth a look'", "r",
                 "contains(lc, 'type=\"file\"') OR contains(lc, 'type=''file''')", "NULL", "0"),
            rule(1, "parameter", "csrf_token", "'info'", "'CSRF token present'",
                 q("Whether the server checks the token is worth a look"), "r",
                 f"regexp_matches(html, {q(ex.CSRF_FIELD)}, 'i')", "NULL", "0"),
            rule(2, "info", "form_analysis", "'low'", f"{count} || ' forms detected — test each endpoint'", "''", "r",
                 f"{count} > 3", "NULL", "0"),
        ],
    )


def x_source_maps() -> str:
    return first_wins(
        21,
        [
            rule(0, "file", "source_map", "'medium'", unless_absolute("g1"), "'Source map exposed: ' || g0",
                 found(fi.SOURCE_MAP, 1, ""), key="NULL"),
            rule(1, "file", "source_map_reference", "'medium'", unless_absolute("g1"),
                 "'JS source map file referenced: ' || g0", found(fi.MAP_FILE, 1, ""), key="NULL"),
        ],
    )


def x_secrets() -> str:
    def shown(x: str) -> str:
        return f"left({x}, 4) || '... (' || length({x}) || ' characters, sha256 ' || sha256({x}) || ')'"

    rules = [
        rule(i, "secret", "secret_format", f"'{severity}'", f"'{kind}: ' || {shown('g0')}",
             f"'Matches the format of {kind}'", found(pattern, 0, ""))
        for i, (kind, pattern, severity, _) in enumerate(se.FORMATS)
    ]
    assigned = "(SELECT page_id, i * 1000 + mo AS mo, g1 FROM " + found(se.VARIABLE, 1, "i", "scripts", "body") + " AS a)"
    rules.append(
        rule(len(se.FORMATS), "secret", "secret_variable", "'high'", f"'script_variable: ' || {shown('g1')}",
             "'Script variable named like a credential'", assigned,
             f"NOT regexp_matches(g1, {q(se._HASH)}) AND regexp_matches(g1, '[0-9]') AND regexp_matches(g1, '[A-Za-z]') "
             f"AND NOT regexp_matches(g1, {q(se._PLACEHOLDER)})")
    )
    return first_wins(8, rules)


EXTRACTORS = {
    "audit_headers": x_audit_headers,
    "endpoints": x_endpoints,
    "scripts": x_scripts,
    "api_routes": x_api_routes,
    "parameters": x_parameters,
    "secrets": x_secrets,
    "directory_listing": x_directory_listing,
    "backup_files": x_backup_files,
    "debug_endpoints": x_debug_endpoints,
    "open_redirects": x_open_redirects,
    "script_secrets": x_script_secrets,
    "subdomains": x_subdomains,
    "graphql": x_graphql,
    "comments": x_comments,
    "tokens": x_tokens,
    "forms": x_forms,
    "sensitive_files": x_sensitive_files,
    "source_maps": x_source_maps,
}
FIRST_PAGE = {
    "fingerprint": x_fingerprint,
    "wordpress": x_wordpress,
    "firewall": x_firewall,
    "technology_hints": x_technology_hints,
}
LIBRARY = {
    "security_headers": x_security_headers,
    "cors": x_cors,
    "cookies": x_cookies,
    "content_policy": x_content_policy,
}


def needs_technology(name: str) -> bool:
    return name in ("fingerprint", "wordpress", "technology_hints")


def extractor_sql(name: str, sources: list[str]) -> str:
    body = {**EXTRACTORS, **FIRST_PAGE, **LIBRARY}[name]()
    extra = f", detected AS ({detected()})" if needs_technology(name) else ""
    chosen = ", ".join(q(s) for s in sources)
    return (
        f"WITH {prelude()}{extra} SELECT page_id, type, value, source, severity, context FROM ({body}) AS f "
        f"WHERE source IN ({chosen})"
    )


def site_documents() -> str:
    documents = [
        (f"{scheme}://{{site}}{path}", status, text)
        for scheme in overlay.SCHEMES
        for path, status, text in overlay.SITEMAPS
    ]
    return f"""sites AS (SELECT site, origin AS base_url, page_id AS first_id FROM r
      QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id) = 1),
    robots_texts(rid, text) AS {values(enumerate(overlay.ROBOTS))},
    robots AS (SELECT site, base_url, replace(text, '{{site}}', site) AS content FROM sites
      JOIN robots_texts ON first_id % {len(overlay.ROBOTS)} = rid),
    sitemap_docs AS (SELECT site, replace(u, '{{site}}', site) AS sitemap_url, status, replace(c, '{{site}}', site)
      AS content FROM sites CROSS JOIN {values(documents)} AS d(u, status, c)),
    requests AS (SELECT site, unnest(range(len(l))) AS position, unnest(l) AS sitemap_url FROM (SELECT site,
      regexp_extract_all(content, 'Sitemap:\\s*(\\S+)', 1, 'i') AS l FROM robots)
      UNION ALL SELECT site, 2147483647, base_url || '/sitemap.xml' FROM sites),
    fetched AS (SELECT site, sitemap_url, position, content FROM requests JOIN sitemap_docs USING (site, sitemap_url)
      WHERE status = 200),
    located AS (SELECT site, sitemap_url, position, len(l) AS parsed, unnest(l) AS url,
      unnest(range(len(l))) AS pos FROM (SELECT *, regexp_extract_all(content, '<loc>\\s*([^\\n]*?)\\s*</loc>', 1)
      AS l FROM fetched)),
    sitemap_urls AS (SELECT * FROM located WHERE regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) = site)"""


def robots_rows() -> str:
    base = (
        "(SELECT site AS page_id, base_url AS url, base_url AS origin, regexp_extract(base_url, '^([a-z]+):', 1) AS scheme, "
        "'' AS path, '/' AS folder, content FROM robots) AS b"
    )
    path = strip("g1")
    rules = [
        rule(0, "endpoint", "robots_disallow", "'low'", join(path), f"'Blocked by robots.txt: Disallow: ' || {path}",
             found(r"Disallow:\s*([^\n]+)", 1, "i", base, "content"), f"{path} NOT IN ('', '/')", "NULL"),
        rule(1, "endpoint", "robots_sitemap", "'info'", "g1", "'Sitemap reference: ' || g0",
             found(r"Sitemap:\s*(\S+)", 1, "i", base, "content"), key="NULL"),
        rule(2, "info", "robots_comment", "'low'", path, f"'Interesting robots.txt comment: ' || {path}",
             found(r"#\s*([^\n]+)", 1, "", base, "content"),
             contains_any(f"lower({path})", ("api", "admin", "debug", "test", "internal", " staging")), "NULL"),
    ]
    return f"SELECT page_id AS site, * EXCLUDE (page_id) FROM ({first_wins(0, rules)}) AS z"


def robots_sql(source: str) -> str:
    return (
        f"WITH {prelude()}, {site_documents()} SELECT site, type, value, source, severity, context FROM ({robots_rows()}) "
        f"AS f WHERE source = {q(source)}"
    )


def sitemap_rows() -> str:
    return (
        "SELECT site, sitemap_url, position, CAST(count(*) AS BIGINT) AS queued, any_value(parsed) AS parsed "
        "FROM sitemap_urls GROUP BY ALL"
    )


def audit_ctes() -> str:
    """CTE ``findings``: what the audit of every site finds, each once."""
    pages = " UNION ALL ".join(f"SELECT * FROM ({x()}) AS e WHERE page_id IN (SELECT page_id FROM ok)" for x in EXTRACTORS.values())
    firsts = " UNION ALL ".join(
        f"SELECT * FROM ({x()}) AS e WHERE page_id IN (SELECT page_id FROM firsts)" for x in FIRST_PAGE.values()
    )
    return f"""{prelude()}, {site_documents()}, detected AS ({detected()}),
    page_rows AS ({pages} UNION ALL {firsts}),
    raw AS (SELECT site, e.page_id AS vo, eo, ro, mo, type, source, severity, value, context FROM page_rows e
        JOIN r USING (page_id)
      UNION ALL SELECT site, -2, eo, ro, mo, type, source, severity, value, context FROM ({robots_rows()}) AS a
      UNION ALL SELECT site, -1, 0, 0, position, 'endpoint', 'sitemap', 'info', queued || ' URLs from sitemap',
        'Parsed ' || parsed || ' URLs, queued ' || queued || ' for crawling' FROM ({sitemap_rows()}) AS b),
    findings AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY site, type, value, source
      ORDER BY vo, eo, ro, mo) = 1),
    visited AS (SELECT DISTINCT site, url FROM (SELECT site, url FROM r UNION ALL
      SELECT site, base_url || '/robots.txt' FROM robots UNION ALL SELECT site, sitemap_url FROM fetched) AS v),
    ranked AS (SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3
      ELSE 4 END AS rank FROM findings)"""


def over_findings(select: str, more: str = "") -> str:
    return f"WITH {audit_ctes()}{more} {select}"
