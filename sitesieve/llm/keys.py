"""Small column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that part words: space, tab, newline, vertical tab, form feed, carriage return.
SPACES = r"\x20\x09-\x0D"
WORD = f"[^{SPACES}]+"


def text_key(text: str = "text") -> tuple[Column, Column]:
    """Two independent 64-bit hashes that together name a text; a null text is named like an empty one.

    A single 64-bit hash would name two different texts alike a few hundred times among 10^11 documents.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2")


def share_of(mark: Column, wanted: int, total: int) -> Column:
    """Whether a row's 64-bit hash is among about ``wanted`` of ``total``; all rows if there are no more than that.

    A threshold needs no sort, so a small sample of a large table is drawn where the rows are.
    """
    if total <= wanted:
        return F.lit(True)
    return F.pmod(mark, F.lit(1 << 40)) < F.lit(max(1, wanted * (1 << 40) // total))


def boxed(frame: DataFrame, *columns: Column) -> DataFrame:
    """The rows as one struct ``row`` beside ``columns``, so that no name of theirs can clash with one of an operator."""
    return frame.select(F.struct("*").alias("row"), *columns)


def unrolled(counted: DataFrame, copies: int) -> DataFrame:
    """A row per row again where ``_n`` counts equal ones: ``_nth`` numbers them from 0. No task unrolls more than ``copies`` of a
    group, so a group of any size spans many tasks.
    """
    numbers = lambda first, last: F.explode(F.sequence(first, last)).alias("_nth")
    zero = F.lit(0).cast("long")
    few = counted.filter(F.col("_n") <= copies).select("*", numbers(zero, F.col("_n") - 1))
    # A large group is cut into parts that are dealt out first.
    parts = F.explode(F.sequence(zero, F.expr(f"(_n - 1) div {copies}"))).alias("_part")
    many = counted.filter(F.col("_n") > copies).select("*", parts)
    many = many.repartition(F.xxhash64(*(c for c in counted.columns if c != "_n"), "_part"))
    last = F.least(F.col("_n"), (F.col("_part") + 1) * copies) - 1
    return few.union(many.select(*counted.columns, numbers(F.col("_part") * copies, last))).drop("_n")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other letter as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
