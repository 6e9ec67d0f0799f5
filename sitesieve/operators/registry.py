"""The extractors by name, in the order in which a page's findings are listed.

Own extractors can be added with :func:`register`: a function from :class:`Page` to a candidates column. Python functions are
added with ``operators.python.register_function``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from . import api_routes, endpoints, exposure, files, headers, parameters, secrets, subdomains, technology
from .page import Page

Extractor = Callable[[Page], Column]


@dataclass(frozen=True)
class Entry:
    order: int
    extract: Extractor
    in_audit: bool = True
    first_page_only: bool = False
    #: Message of a failure on a page, null without one; column functions do not fail.
    failed: Extractor | None = None


_REGISTRY: dict[str, Entry] = {}


def register(
    name: str,
    extract: Extractor,
    *,
    in_audit: bool = True,
    first_page_only: bool = False,
    failed: Extractor | None = None,
) -> None:
    """Add an extractor after all registered ones."""
    if name in _REGISTRY:
        raise ValueError(f"extractor {name!r} is registered already")
    _REGISTRY[name] = Entry(len(_REGISTRY), extract, in_audit, first_page_only, failed)


def unregister(name: str) -> None:
    del _REGISTRY[name]


def entry(name: str) -> Entry:
    return _REGISTRY[name]


def names(*, in_audit: bool | None = None, first_page_only: bool | None = None) -> list[str]:
    return [
        name
        for name, e in _REGISTRY.items()
        if (in_audit is None or e.in_audit == in_audit)
        and (first_page_only is None or e.first_page_only == first_page_only)
    ]


register("fingerprint", technology.fingerprint, first_page_only=True)
register("wordpress", technology.wordpress_if_detected, first_page_only=True)
register("firewall", technology.firewall, first_page_only=True)
register("audit_headers", headers.audit_headers)
register("endpoints", endpoints.endpoints)
register("scripts", endpoints.scripts)
register("api_routes", api_routes.api_routes)
register("parameters", parameters.parameters)
register("secrets", secrets.secrets)
register("directory_listing", files.directory_listing)
register("backup_files", files.backup_files)
register("debug_endpoints", files.debug_endpoints)
register("open_redirects", exposure.open_redirects)
register("script_secrets", exposure.script_secrets)
register("subdomains", subdomains.subdomains)
register("graphql", exposure.graphql)
register("comments", exposure.comments)
register("tokens", exposure.tokens)
register("forms", exposure.forms)
register("technology_hints", technology.technology_hints, first_page_only=True)
register("sensitive_files", files.sensitive_files)
register("source_maps", files.source_maps)
# Library functions the site audit does not call.
register("security_headers", headers.security_headers, in_audit=False)
register("cors", headers.cors, in_audit=False)
register("cookies", headers.cookies, in_audit=False)
register("content_policy", headers.content_policy, in_audit=False)
register("wordpress_extras", technology.wordpress, in_audit=False, first_page_only=True)
register("secrets_unmasked", secrets.secrets_unmasked, in_audit=False)
