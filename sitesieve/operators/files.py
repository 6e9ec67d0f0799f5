"""Files and paths that should not be reachable, as far as a page mentions them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import (
    any_literal,
    contains_any,
    find_all,
    find_groups,
    has_scheme,
    let,
    matches,
)
from ..functions.tables import table
from .candidates import each, prefixed, single, singles, together
from .page import Page, quoted_segments

# Path lists, in reporting order.
SENSITIVE_PATHS = (
    "/.env", "/.env.local", "/.env.production", "/.env.backup", "/.git/config", "/.git/HEAD", "/.gitignore",
    "/.svn/entries", "/.DS_Store", "/.htaccess", "/.htpasswd", "/wp-config.php.bak", "/wp-config.php.save",
    "/wp-config.php~", "/wp-config.php.old", "/config.php.bak", "/config.php.save", "/database.sql",
    "/database.sql.gz", "/backup.sql", "/dump.sql", "/db.sql", "/backup.zip", "/backup.tar.gz", "/site.tar.gz",
    "/www.zip", "/public.zip", "/.aws/credentials", "/.ssh/authorized_keys", "/docker-compose.yml", "/Dockerfile",
    "/package-lock.json", "/yarn.lock", "/composer.lock", "/.npmrc", "/server.key", "/server.crt", "/cert.pem",
    "/key.pem", "/debug.log", "/error.log", "/access.log", "/phpinfo.php", "/info.php", "/test.php", "/admin/",
    "/administrator/", "/phpmyadmin/", "/adminer.php", "/console", "/.well-known/security.txt", "/crossdomain.xml",
    "/clientaccesspolicy.xml", "/swagger.json", "/swagger-ui/", "/api-docs", "/openapi.json", "/graphql",
    "/_debugToolbar/", "/elmah.axd", "/trace.axd", "/web.config", "/robots.txt", "/sitemap.xml", "/.well-known/",
)
PUBLIC_PATHS = ("/robots.txt", "/sitemap.xml", "/.well-known/security.txt", "/crossdomain.xml")
BACKUP_EXTENSIONS = (
    ".bak", ".backup", ".old", ".orig", ".save", ".swp", ".swo", ".tmp", "~", ".copy", ".dist", ".php~", ".php.bak",
    ".php.old", ".php.save", ".php.swp", ".sql", ".sql.gz", ".dump", ".export", ".bak.php", ".old.php",
)
BACKUP_NAMES = (
    "backup.sql", "dump.sql", "database.sql", "db.sql", "backup.zip", "backup.tar.gz", "site.zip", "www.zip",
    "backup.tar", "backup.rar", "backup.7z", "config.php.bak", "wp-config.php.bak", "settings.py.bak", ".env.backup",
    ".env.old", ".env.local", ".env.production", "credentials.json", "secrets.json", "service-account.json",
)
DEBUG_PATHS = (
    "/debug", "/debug/", "/debug/vars", "/debug/pprof", "/debug/requests", "/admin", "/admin/", "/administrator",
    "/adminer.php", "/phpinfo.php", "/info.php", "/test.php", "/php-test.php", "/server-status", "/server-info",
    "/.env", "/.env.local", "/.env.production", "/.env.development", "/actuator", "/actuator/env", "/actuator/health",
    "/actuator/beans", "/swagger-ui", "/swagger-ui.html", "/api-docs", "/swagger.json", "/graphql", "/graphiql",
    "/playground", "/voyager", "/elmah.axd", "/trace.axd", "/metrics", "/prometheus", "/stats", "/console",
    "/_console", "/manage", "/phpmyadmin", "/pma", "/adminer", "/dbadmin", "/wp-admin", "/wp-login.php",
    "/remote/fgt_lang?lang=/../../../..//////////dev/cmdb/sslvpn_websession",
)
LISTING = (
    r"<title>Index of /",
    r"<h1>Index of /",
    r"Parent Directory</a>",
    r"<pre><a href=.*?>\.\./</a>",
    r"Directory listing for",
    r"Apache.*at.*Port",
    r"nginx.*directory listing",
    r"<title>[^<]*Index of[^<]*</title>",
)


def _in_one_line(pattern: str) -> str:
    """For a test only: the parts around ``.*`` in order on one line, each at its next place, once per line.

    Equal to the pattern as a test, and linear on lines of any length.
    """
    parts = re.split(r"\.\*\??", pattern)
    return "(?m:^" + "".join(f"(?>.*?{part})" for part in parts) + ")" if len(parts) > 1 else pattern


_LISTING_TEST = "|".join(_in_one_line(p) for p in LISTING)
ENVIRONMENT = r"(?:process\.env\.|import\.meta\.env\.)(\w+)"
SOURCE_MAP = r"//#\s*sourceMappingURL=(\S+)"
MAP_FILE = r"""["']([^"']*\.js\.map)["']"""



def _any_path(paths: list[str]) -> str:
    """A search for any of the paths. The slash stands in front once, so that alternatives are tried after slashes only."""
    return f"/(?:{any_literal([path[1:].lower() for path in paths])})"


# Where a table of literals is tested against a page, one search for any of them runs first.
_ANY_SENSITIVE = _any_path(SENSITIVE_PATHS)
_ANY_DEBUG = _any_path(DEBUG_PATHS)
_ANY_BACKUP_NAME = any_literal(BACKUP_NAMES)
# Every backup extension contains one of these.
_EXTENSION_MARKS = [e for e in BACKUP_EXTENSIONS if not any(o in e for o in BACKUP_EXTENSIONS if o != e)]
# Every backup name contains one of these.
_BACKUP_MARKS = ("backup.", ".sql", ".zip", ".bak", ".env.", "credentials.json", "secrets.json", "service-account.json")


def _sensitive_severity(path: str) -> str:
    if path in PUBLIC_PATHS:
        return "info"
    return "medium" if path.endswith((".lock", ".json")) else "high"


def _debug_severity(path: str) -> str:
    critical = path.startswith(("/debug", "/.env")) or "actuator" in path
    return "critical" if critical else "high"


def sensitive_files(page: Page) -> Column:
    paths = table(
        "path:string,lower:string,severity:string",
        [(path, path.lower(), _sensitive_severity(path)) for path in SENSITIVE_PATHS],
    )
    mentioned = each(
        F.filter(paths, lambda t: F.contains(page.lower, t["lower"])),
        when=F.rlike(page.lower, F.lit(_ANY_SENSITIVE)),
        rule=lambda t: t["ord"],
        type="file",
        source="sensitive_file_reference",
        severity=lambda t: t["severity"],
        value=lambda t: t["path"],
        resolve=True,
        context=lambda t: F.concat(F.lit("Sensitive path '"), t["path"], F.lit("' referenced in HTML")),
        once=True,
        metadata={"path": lambda t: t["path"]},
    )
    environment = each(
        F.sort_array(F.array_distinct(find_all(page.html, ENVIRONMENT, 1))),
        when=contains_any(page.html, "process.env.", "import.meta.env."),
        rule=len(SENSITIVE_PATHS),
        type="secret",
        source="env_reference",
        severity="medium",
        value=lambda m: prefixed("process.env.", m),
        context=lambda m: prefixed("Environment variable reference found: process.env.", m),
        once=True,
        key=lambda m: m,
        metadata={"variable": lambda m: m},
    )
    return together(mentioned, environment)


def directory_listing(page: Page) -> Column:
    gated = contains_any(page.fold, "index of", "parent directory", "../</a>", "directory listing", "apache")
    return singles(
        single(
            gated & matches(page.html, _LISTING_TEST, ignore_case=True),
            type="file",
            source="directory_listing",
            severity="high",
            value=page.url,
            context="Directory listing — file structure exposed",
        )
    )


def _first(segments: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(segments, test), F.lit(0))


def backup_files(page: Page) -> Column:
    """Links that end like a backup copy, then known backup names in quotes."""
    extensions = table("text:string", [(extension,) for extension in BACKUP_EXTENSIONS])

    def first_extension(value: Column) -> Column:
        return _first(extensions, lambda t: F.endswith(F.lower(value), t["text"]))["ord"]

    links = each(
        find_groups(
            # a value reaches to the next quote anyway, so its end is tested once and not at every character
            page.html,
            rf"""href=["']([^"']++(?<=(?:{any_literal(BACKUP_EXTENSIONS)})))["']""",
            ignore_case=True,
        ),
        when=contains_any(page.fold, *_EXTENSION_MARKS),
        rule=lambda m: first_extension(m["g1"]),
        type="file",
        source="backup_file",
        severity="high",
        value=lambda m: m["g1"],
        resolve=True,
        context=lambda m: prefixed("Backup file: ", m["g0"], 80),
        once=True,
    )
    known = table("name:string", [(name,) for name in BACKUP_NAMES])

    def named(segments: Column) -> Column:
        return F.transform(
            known,
            lambda t: F.struct(
                (t["ord"] + len(BACKUP_EXTENSIONS)).alias("rule"),
                t["name"].alias("name"),
                _first(segments, lambda s: F.endswith(F.lower(s), t["name"])).alias("path"),
            ),
        )

    # Only segments that end in some known name are looked at again, name by name.
    endings = F.filter(
        quoted_segments(page.html), lambda s: matches(s, rf"(?:{_ANY_BACKUP_NAME})\z", ignore_case=True)
    )
    names = each(
        let(endings, named),
        when=contains_any(page.fold, *_BACKUP_MARKS),
        keep=lambda m: m["path"].isNotNull(),
        rule=lambda m: m["rule"],
        type="file",
        source="backup_file",
        severity="high",
        value=lambda m: m["path"],
        resolve=True,
        context=lambda m: prefixed("Known backup: ", m["name"]),
        once=True,
    )
    return together(links, names)


def debug_endpoints(page: Page) -> Column:
    """For each listed path the first quoted text that contains it."""

    paths = table("name:string,severity:string", [(path, _debug_severity(path)) for path in DEBUG_PATHS])

    def listed(segments: Column) -> Column:
        return F.transform(
            paths,
            lambda t: F.struct(
                t["ord"].alias("rule"),
                t["name"].alias("name"),
                t["severity"].alias("severity"),
                _first(segments, lambda s: F.contains(F.lower(s), t["name"])).alias("path"),
            ),
        )

    mentioning = F.filter(quoted_segments(page.html), lambda s: matches(s, _ANY_DEBUG, ignore_case=True))
    return each(
        let(mentioning, listed),
        when=F.rlike(page.fold, F.lit(_ANY_DEBUG)),
        keep=lambda m: m["path"].isNotNull(),
        rule=lambda m: m["rule"],
        type="endpoint",
        source="debug_endpoint",
        severity=lambda m: m["severity"],
        value=lambda m: m["path"],
        resolve=True,
        context=lambda m: prefixed("Debug/admin: ", m["name"]),
    )


def source_maps(page: Page) -> Column:
    declared = each(
        find_groups(page.html, SOURCE_MAP),
        when=contains_any(page.html, "sourceMappingURL="),
        type="file",
        source="source_map",
        severity="medium",
        value=lambda m: m["g1"],
        resolve=lambda m: ~has_scheme(m["g1"]),
        context=lambda m: prefixed("Source map exposed: ", m["g0"]),
        metadata={"type": "sourceMappingURL"},
    )
    referenced = each(
        find_groups(page.html, MAP_FILE),
        when=contains_any(page.html, ".js.map"),
        rule=1,
        type="file",
        source="source_map_reference",
        severity="medium",
        value=lambda m: m["g1"],
        resolve=lambda m: ~has_scheme(m["g1"]),
        context=lambda m: prefixed("JS source map file referenced: ", m["g0"]),
        metadata={"type": "js_map_file"},
    )
    return together(declared, referenced)
