"""Breadth-first reachability over stored pages."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.links import page_addresses
from ..sources.captures import analyzable
from ..sources.storage import Buckets


def link_table(responses: DataFrame, follow_external: bool = False) -> DataFrame:
    """``(url, link, position)`` of the analyzable pages; of several captures of an address the first counts."""
    pages = page_addresses(analyzable(responses), follow_external)
    first = pages.groupBy("url").agg(F.min_by("links", F.struct("visit_order", "site")).alias("links"))
    return first.select("url", F.posexplode(F.transform("links", lambda link: link)).alias("position", "link"))


def reachable(
    starts: DataFrame,
    links: DataFrame,
    sitemap_urls: DataFrame | None = None,
    *,
    max_depth: int | None = None,
    max_pages: int | None = None,
) -> DataFrame:
    """``(site, url, depth, visit)``: addresses reached from the start pages ``(site, url)``.

    Sitemap addresses ``(site, url, pos)`` enter at depth 1, before the links of the start page. An address is reached
    once, at its smallest depth, whether or not it was captured. ``max_pages`` keeps the first so many per site in
    breadth-first order (``visit`` numbers them); ``None`` keeps all, and then ``visit`` is NULL. ``max_depth`` is the most
    links from a start page; ``None`` follows them until no new address is found.

    The links lie in buckets of their address and what was seen in buckets of site and address, so neither is shuffled at any
    level: a level meets the links by one exchange of its own rows, and what they lead to meets what was seen by one
    exchange of the distinct addresses. Every level is written, so that the plan does not grow and a lost executor costs at
    most one level.
    """
    spark = links.sparkSession
    by_address = Buckets(spark, "links", "url")
    by_address.add(links)
    links = by_address.read()
    seen = Buckets(spark, "seen", "site", "url")
    numbered = max_pages is not None
    seen.add(starts.select("site", "url").distinct().select(*_placed(0, F.lit(1) if numbered else None)))
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        found = seen.read(depth - 1).join(links, "url").select(
            "site", F.col("link").alias("url"), F.col("visit").alias("parent"), F.col("position").cast("bigint").alias("position")
        )
        if depth == 1 and sitemap_urls is not None:
            listed = sitemap_urls.select("site", "url", F.lit(0).cast("bigint").alias("parent"), F.col("pos").cast("bigint").alias("position"))
            found = found.unionByName(listed)
        so_far = seen.read()
        if not numbered:
            fresh = found.select("site", "url").distinct().join(so_far.select("site", "url"), ["site", "url"], "left_anti")
            level = fresh.select(*_placed(depth, None))
        else:
            # Parent and position as one number, which a hash aggregate can keep.
            place = F.col("parent").cast("decimal(18,0)") * F.lit(str(10**19)).cast("decimal(20,0)") + F.col("position")
            first = found.groupBy("site", "url").agg(F.min(place).alias("first"))
            fresh = first.join(so_far.select("site", "url"), ["site", "url"], "left_anti")
            # No more than max_pages per site pass the window; tasks drop the others before the shuffle.
            order = F.row_number().over(W.partitionBy("site").orderBy("first", "url"))
            ranked = fresh.withColumn("place", order).where(F.col("place") <= max_pages)
            last = so_far.groupBy("site").agg(F.max("visit").alias("last"))
            level = ranked.join(last, "site").select(*_placed(depth, F.col("last") + F.col("place")))
            level = level.where(F.col("visit") <= max_pages)
        seen.add(level, depth)
        if seen.read(depth).isEmpty():
            break
    by_address.done()
    return seen.done()


def _placed(depth: int, visit: Column | None) -> list[Column]:
    visit = F.lit(None) if visit is None else visit
    return [F.col("site"), F.col("url"), F.lit(depth).alias("depth"), visit.cast("bigint").alias("visit")]


def start_pages(responses: DataFrame) -> DataFrame:
    """``(site, url)``: the first capture of every site."""
    return responses.groupBy("site").agg(F.min_by("url", "visit_order").alias("url"))
