"""Credentials by the published formats of their issuers.

Values are masked: the first four characters, the length and a digest that lets equal secrets be matched without
storing them. ``secrets_unmasked`` gives the text as found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.tables import table
from ..functions.text import contains_any, cut, find_all, starting
from .candidates import each, prefixed, together
from .page import Page

# (type, pattern, severity, plain texts of which the page must contain one)
FORMATS = (
    ("github_pat", r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}", "critical", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
    ("gitlab_pat", r"glpat-[A-Za-z0-9_-]{20,}", "critical", ("glpat-",)),
    ("aws_access_key", r"(?:AKIA|ASIA)[A-Z0-9]{16}", "critical", ("AKIA", "ASIA")),
    ("stripe_key", r"(?:sk|rk)_(?:test|live)_[A-Za-z0-9]{24,}", "critical", ("k_test_", "k_live_")),
    ("google_api_key", r"AIza[A-Za-z0-9_-]{35,}", "high", ("AIza",)),
    ("slack_token", r"xox[abprs]-[0-9]+-[0-9]+-[A-Za-z0-9-]+", "critical", ("xox",)),
    (
        "private_key",
        r"-----BEGIN (?:[A-Z0-9][A-Z0-9 ]* )?PRIVATE KEY-----(?s:.)*?-----END (?:[A-Z0-9][A-Z0-9 ]* )?PRIVATE KEY-----",
        "critical",
        ("PRIVATE KEY-----",),
    ),
    (
        "jwt_token",
        r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
        "high",
        ("eyJ",),
    ),
    (
        "connection_string",
        r"(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^:@/ \t\r\n\"'<>]+:[^@/ \t\r\n\"'<>]+@[^ \t\r\n\"'<>]+",
        "critical",
        ("postgres", "mysql", "mongodb", "redis", "amqp"),
    ),
)
# In script bodies: a variable named like a credential, given a long text of letters and digits.
VARIABLE = (
    r"(?:api_?key|secret|token|password|passwd|access_?key|auth_?key|private_?key|credential)[A-Za-z0-9_]*"
    r"""[ \t\r\n]*[:=][ \t\r\n]*["'`]([A-Za-z0-9_.+/=-]{20,})["'`]"""
)
_HASH = r"^[0-9a-fA-F]+$"
_PLACEHOLDER = r"(?i)placeholder|example|your[_-]|xxxx|changeme|dummy|sample"


def masked(secret: Column) -> Column:
    return F.concat(
        cut(secret, 4),
        F.lit("... ("),
        F.length(secret).cast("string"),
        F.lit(" characters, sha256 "),
        F.sha2(secret, 256),
        F.lit(")"),
    )


def _secrets(page: Page, show: Callable[[Column], Column]) -> Column:
    kinds = table("kind:string,severity:string", [(kind, severity) for kind, _, severity, _ in FORMATS])

    def of_format(place: int, pattern: str, needed: tuple[str, ...]) -> Column:
        """A format is searched only on pages that hold one of its fixed texts."""
        found = F.regexp_extract_all(page.html, F.lit(pattern), F.lit(0))
        rows = F.transform(found, lambda m: F.struct(F.lit(place).alias("place"), m.alias("text")))
        return F.when(contains_any(page.html, *needed), rows).otherwise(F.array().cast("array<struct<place:int,text:string>>"))

    texts = F.concat(*(of_format(i, pattern, needed) for i, (_, pattern, _, needed) in enumerate(FORMATS)))
    found = F.transform(texts, lambda m: F.struct(F.get(kinds, m["place"]).alias("t"), m["text"].alias("text")))
    by_format = each(
        found,
        rule=lambda m: m["t"]["ord"],
        type="secret",
        source="secret_format",
        severity=lambda m: m["t"]["severity"],
        value=lambda m: F.concat(m["t"]["kind"], F.lit(": "), show(m["text"])),
        context=lambda m: prefixed("Matches the format of ", m["t"]["kind"]),
        once=True,
        metadata={"secret_type": lambda m: m["t"]["kind"]},
    )
    assigned = F.flatten(F.transform(page.scripts, lambda s: find_all(s, starting("astpc", VARIABLE), 1, ignore_case=True)))
    by_variable = each(
        assigned,
        when=(F.size(page.scripts) > 0)
        & contains_any(page.fold, "key", "secret", "token", "password", "passwd", "credential"),
        keep=lambda m: ~F.rlike(m, F.lit(_HASH))
        & F.rlike(m, F.lit("[0-9]"))
        & F.rlike(m, F.lit("[A-Za-z]"))
        & ~F.rlike(m, F.lit(_PLACEHOLDER)),
        rule=len(FORMATS),
        type="secret",
        source="secret_variable",
        severity="high",
        value=lambda m: F.concat(F.lit("script_variable: "), show(m)),
        context="Script variable named like a credential",
        once=True,
        metadata={"secret_type": "script_variable"},
    )
    return together(by_format, by_variable)


def secrets(page: Page) -> Column:
    return _secrets(page, masked)


def secrets_unmasked(page: Page) -> Column:
    return _secrets(page, lambda m: m)
