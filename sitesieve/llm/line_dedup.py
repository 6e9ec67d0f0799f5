"""Boilerplate lines by the number of distinct sites that have them.

A line is what stands between newlines, without spaces at its ends; empty lines are no lines. Per name of a line a HyperLogLog
sketch of its sites is made in every task, and the sketches of a line merge by aggregation. Lines whose estimate lies within
``MARGIN`` standard errors of ``SITES`` get an exact distinct count. Lines of at least ``SITES`` sites are boilerplate, and
every document loses them.

Counting sees only names and sites. The one shuffle of texts is that in which documents meet the list of the lines they lose.

Nulls: a null text has no lines and stays null; a null source is no site. Repeated rows count as what they are: more lines of the
same site. Sites that differ only in case are different. An empty table gives no rows. Extra columns are carried along,
but for those of the names ``n_lines`` and ``n_removed``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from .keys import boxed, text_key

SITES = 5
#: Sketch of 2^LOG registers; its standard error is 1.04 / sqrt(2^LOG).
LOG = 10
MARGIN = 4.0


def lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n")


def line_name(line: Column) -> Column:
    """128 bits: with 64, some of 10^12 lines would share a name, and a wrong line would go."""
    return F.md5(F.btrim(line, F.lit(" \t\r\x0b\x0c")))


def _marked(documents: DataFrame) -> DataFrame:
    """``line`` (name), ``site``, ``k1``, ``k2``: one row per distinct line of a document."""
    names = F.transform(F.filter(lines(), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")) != ""), line_name)
    rows = documents.select(F.col("source").cast("string").alias("site"), *text_key(), F.array_distinct(names).alias("all"))
    return rows.select("site", "k1", "k2", F.explode("all").alias("line")).withColumn("line", F.unhex("line"))


def boilerplate(marked: DataFrame, sites: int = SITES, log: int = LOG, margin: float = MARGIN) -> DataFrame:
    """``line``, ``sites``: lines of at least ``sites`` distinct sites; the number is exact near the threshold only."""
    error = margin * 1.04 / 2 ** (log / 2)
    sketches = marked.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(log)).alias("sketch"))
    estimates = sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites"))
    estimates = estimates.filter(F.col("sites") >= sites * (1 - error) - 0.5)
    estimates = stored(estimates, "estimates")
    near = F.col("sites") <= sites * (1 + error) + 0.5
    exact = marked.join(estimates.filter(near).select("line"), "line", "left_semi")
    exact = exact.select("line", "site").distinct().groupBy("line").agg(F.count("site").alias("sites"))
    return estimates.filter(~near).union(exact.filter(F.col("sites") >= sites))


def without_boilerplate(
    documents: DataFrame, sites: int = SITES, log: int = LOG, margin: float = MARGIN
) -> DataFrame:
    """``documents`` with the lines removed from ``text``, and ``n_lines`` and ``n_removed`` (lines that are not empty)."""
    marked = stored(_marked(documents), "lines")
    common = boilerplate(marked, sites, log, margin).select("line")
    lost = marked.select("line", "k1", "k2").join(common, "line").groupBy("k1", "k2")
    lost = lost.agg(F.collect_set("line").alias("_lost"))  # bounded by the lines of a text
    k1, k2 = text_key()
    keyed = boxed(documents, F.col("text"), k1.alias("_k1"), k2.alias("_k2"))
    met = keyed.join(lost, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left")
    full = F.filter(lines(), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")) != "")
    keeps = lambda x: ~F.array_contains("_lost", F.unhex(line_name(x)))
    own = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    out = met.withColumns(
        {
            "_kept": F.when(F.col("_lost").isNull(), F.col("text")).otherwise(
                F.array_join(F.filter(lines(), lambda x: (F.btrim(x, F.lit(" \t\r\x0b\x0c")) == "") | keeps(x)), "\n")
            ),
            "_lines": F.coalesce(F.size(full), F.lit(0)).cast("long"),
            "_removed": F.when(F.col("_lost").isNull(), 0).otherwise(F.size(F.filter(full, lambda x: ~keeps(x)))).cast("long"),
        }
    )
    kept = [F.col("_kept").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in own]
    return out.select(*kept, F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, text, list_filter(string_split(text, chr(10)), lambda x: trim(x, E' \t\r\x0b\x0c') <> '') AS ls
  FROM documents
), l AS (
  SELECT DISTINCT source, trim(unnest(ls), E' \t\r\x0b\x0c') AS line FROM d
), b AS (
  SELECT coalesce(list(line), []) AS lost FROM (SELECT line FROM l GROUP BY line HAVING count(DISTINCT source) >= 5)
)
SELECT doc_id,
  CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(list_filter(ls, lambda x: list_contains(lost, trim(x, E' \t\r\x0b\x0c')))), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(string_split(text, chr(10)),
    lambda x: NOT list_contains(lost, trim(x, E' \t\r\x0b\x0c'))), chr(10)), '')) AS kept_sha256
FROM d, b
"""
