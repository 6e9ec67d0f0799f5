"""From rules to finding rows, within one page row and without a shuffle.

An extractor is a column function: it takes a :class:`~sitesieve.operators.page.Page` and returns an array of
*candidates*. A candidate is a finding whose value may still be a reference to resolve. All extractors of a run are
resolved in one pass, duplicates are dropped within the page, and one ``explode`` makes the rows. Since a page is a row,
none of this moves data between tasks, and it works the same on a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reuse import per_session
from ..functions.text import cut
from ..functions.urls import url_join

_METADATA = "array<struct<key:string,value:string>>"
CANDIDATES = (
    "array<struct<rule_ord:int,match_ord:int,type:string,source:string,severity:string,value:string,resolve:boolean,"
    f"context:string,context_cut:int,once:boolean,key:string,metadata:{_METADATA}>>"
)

ColumnLike = Column | str
Field = Callable[[Column], ColumnLike] | ColumnLike


def _column(field: Field, match: Column | None) -> Column:
    if callable(field) and not isinstance(field, Column):
        field = field(match)
    return field if isinstance(field, Column) else F.lit(field)


def no_candidates() -> Column:
    return F.array().cast(CANDIDATES)


def candidate(
    match: Column | None,
    position: Column,
    *,
    type: str,
    source: Field,
    value: Field,
    rule: Column | int = 0,
    severity: Field = "info",
    resolve: Field | bool = False,
    context: Field = "",
    context_cut: int = 0,
    once: bool = False,
    key: Field | None = None,
    metadata: dict[str, Field] | None = None,
) -> Column:
    """One candidate.

    ``resolve``: join the value with the page URL. ``context_cut``: append that much of the final value to the context.
    ``once``: keep only the first candidate per extractor and key, where the key is the final value unless ``key`` is
    given.
    """
    if metadata:
        described = F.array(
            *[
                F.struct(F.lit(k).alias("key"), _column(v, match).cast("string").alias("value"))
                for k, v in metadata.items()
            ]
        )
    else:
        described = F.lit(None)
    return F.struct(
        _column(rule, match).cast("int").alias("rule_ord"),
        position.cast("int").alias("match_ord"),
        F.lit(type).alias("type"),
        _column(source, match).alias("source"),
        _column(severity, match).alias("severity"),
        _column(value, match).alias("value"),
        _column(resolve, match).alias("resolve"),
        _column(context, match).alias("context"),
        F.lit(context_cut).alias("context_cut"),
        F.lit(once).alias("once"),
        (F.lit(None) if key is None else _column(key, match)).cast("string").alias("key"),
        described.cast(_METADATA).alias("metadata"),
    )


def each(found: Column, *, when: Column | None = None, keep: Callable[[Column], Column] | None = None, **fields) -> Column:
    """One candidate per element of ``found``.

    ``when`` is a cheap necessary condition on the page: where it is false, the search behind ``found`` is not run.
    """
    kept = found if keep is None else F.filter(found, keep)
    made = F.transform(kept, lambda m, i: candidate(m, i, **fields)).cast(CANDIDATES)
    return made if when is None else F.when(when, made).otherwise(no_candidates())


def single(condition: Column, **fields) -> Column:
    """A candidate struct where the condition holds, NULL elsewhere; a list of them goes to :func:`singles`."""
    return F.when(condition, candidate(None, F.lit(0), **fields))


def singles(*rows: Column, when: Column | None = None) -> Column:
    made = F.array_compact(F.array(*rows)).cast(CANDIDATES)
    return made if when is None else F.when(when, made).otherwise(no_candidates())


def together(*arrays: Column) -> Column:
    return F.concat(*arrays) if len(arrays) > 1 else arrays[0]


def merge_candidates(arrays: Sequence[tuple[int, Column]], base: Column) -> Column:
    """All candidates of a page as one array, values resolved, sorted by extractor, key and order.

    ``arrays`` pairs each candidates column with its extractor's position; ``base`` is the page's ``url_parts``.
    """
    orders = F.array(*[F.lit(order) for order, _ in arrays])

    def resolved(c: Column, order: Column) -> Column:
        value = F.when(c["resolve"], url_join(base, c["value"])).otherwise(c["value"])
        return F.struct(order.alias("extractor_ord"), value.alias("value"), c.alias("c"))

    def keyed(r: Column) -> Column:
        c = r["c"]
        return F.struct(
            r["extractor_ord"].alias("extractor_ord"),
            F.when(c["once"], F.coalesce(c["key"], r["value"])).alias("key"),
            c["rule_ord"].alias("rule_ord"),
            c["match_ord"].alias("match_ord"),
            c["type"].alias("type"),
            r["value"].alias("value"),
            c["source"].alias("source"),
            c["severity"].alias("severity"),
            F.when(
                c["context_cut"] > 0, F.concat(c["context"], F.substring(r["value"], F.lit(1), c["context_cut"]))
            )
            .otherwise(c["context"])
            .alias("context"),
            c["metadata"].alias("metadata"),
        )

    per_extractor = F.transform(
        F.array(*[a for _, a in arrays]),
        lambda candidates, i: F.transform(candidates, lambda c: resolved(c, F.get(orders, i))),
    )
    return F.sort_array(F.transform(F.flatten(per_extractor), keyed))


def first_candidates(candidates: str) -> Column:
    """Finding structs of a sorted candidates column, without those whose key equals their predecessor's."""

    def is_first(c: Column, i: Column) -> Column:
        before = F.get(F.col(candidates), i - 1)
        return (
            c["key"].isNull()
            | (i == 0)
            | (before["extractor_ord"] != c["extractor_ord"])
            | ~c["key"].eqNullSafe(before["key"])
        )

    def finished(c: Column) -> Column:
        names = ("type", "value", "source", "severity", "context", "extractor_ord", "rule_ord", "match_ord")
        return F.struct(*[c[n].alias(n) for n in names], F.map_from_entries(c["metadata"]).alias("metadata"))

    return F.transform(F.filter(candidates, is_first), finished)


def explode_candidates(pages: DataFrame, candidates: Column, keys: Sequence[str]) -> DataFrame:
    """Finding rows of the pages, from their merged candidates: the first-wins rule without a shuffle."""
    # The filter stands inside the generator on purpose: over a plain attribute the optimizer would infer a
    # not-empty predicate and push it below, computing everything twice.
    kept = per_session("first_candidates", lambda: first_candidates("candidates"))
    return pages.select(*keys, candidates.alias("candidates")).select(*keys, F.inline(kept))


def prefixed(prefix: str, text: Column, length: int | None = None) -> Column:
    return F.concat(F.lit(prefix), text if length is None else cut(text, length))
