"""Verdicts on URLs: path rules first, then logistic regression on hashed character n-grams of host and path.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: then up to ``?``, ``#`` or the end. A
rule fits its host and all subdomains if the URL's path starts with the rule's; of the rules that fit, the longest wins. URLs
without a rule are judged by the classifier.

The classifier is Spark's logistic regression over the n-grams of ``GRAMS`` letters of host and path, marked by part, hashed
to ``FEATURES`` places. It is trained from a small table of labelled URLs, ``labelled_urls`` unless another is given, in one
partition, so that reruns give the same weights.

Nulls: a null URL, and one without ``://``, has an empty host and an empty path, fits no rule and is judged by the classifier's
level alone. Rows with a null ``page_id`` and repeated rows are judged like any other. An empty table gives no rows. Extra columns
are carried along, but for those of the names ``host``, ``path``, ``rule``, ``blocking`` and ``verdict``, in any case, which are
replaced.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .keys import ascii_lower, boxed

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
GRAMS = (3, 4, 5)
FEATURES = 1 << 14
PULL = 0.01
THRESHOLD = 0.5

#: Names of junk sites and of ordinary ones, for the labelled table. Both get the same domains and paths, so that only what
#: a name is made of tells them apart.
JUNK = (
    "cheap-pills", "cheap-meds", "buy-viagra", "online-pharmacy", "spam-farm", "spam-links", "link-farm", "seo-backlinks",
    "casino-bonus", "online-casino", "casino-win", "poker-bets", "free-bets", "bet-now", "free-spins", "jackpot-win",
    "replica-watches", "replica-bags", "adult-cams", "adult-x", "xxx-videos", "free-porn", "payday-loans", "quick-loan",
    "fast-cash", "warez-crack", "keygen-download", "claim-prize", "free-iphone", "lottery-winner", "get-rich-quick",
    "weight-loss-pills", "miracle-diet", "click-here", "popup-ads", "ads-track", "ad-tracker", "track-clicks",
    "verify-account", "crypto-doubler", "forex-profit", "escort-dating", "hot-singles", "cheap-traffic",
)
ORDINARY = (
    "university", "library", "encyclopedia", "software", "writer", "dailynews", "weather", "museum", "cooking", "citycouncil",
    "health", "school", "music", "gardening", "photography", "science", "railway", "hotel", "football", "opensource",
    "archive", "theatre", "language", "bank", "astronomy", "recipes", "reader", "parliament", "thinking", "another", "therein",
    "nation", "station", "mother", "than", "onion", "history", "travel-notes", "open-air", "village", "orchestra", "bakery",
    "mathematics", "bicycles",
)
DOMAINS = ("example.com", "example.net", "example.org")
PLACES = ("", "www.", "blog.", "m.")
PATHS = ("/en/425", "/de/533/", "/fr/65.html", "/es/978", "/", "/about/contact")


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table: each name under every domain, with places and paths in turn."""
    rows = []
    for label, names in ((1, JUNK), (0, ORDINARY)):
        for i, name in enumerate(names):
            for j, domain in enumerate(DOMAINS):
                place, path_ = PLACES[(i + j) % len(PLACES)], PATHS[(i + 2 * j) % len(PATHS)]
                rows.append((f"https://{place}{name}.{domain}{path_}", label))
    return rows


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(rules: tuple[tuple[str, str, str], ...], of: str) -> Column:
    """Name or verdict of the longest rule that fits ``host`` and ``path``; null if none does."""
    found = F.lit(None).cast("string")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(start)
        found = F.when(fits, name + start if of == "rule" else verdict).otherwise(found)
    return found


def _runs(whole: Column, mark: str, n: int) -> Column:
    last = F.length(whole) - n + 1
    places = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
    runs = F.transform(places, lambda i: F.concat(F.lit(mark), F.substring(whole, i, F.lit(n))))
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<string>"))


def _grams(part: Column, mark: str) -> list[Column]:
    """The n-grams of a part with its ends marked."""
    whole = F.concat(F.lit(mark), part, F.lit("$"))
    return [_runs(whole, mark, n) for n in GRAMS]


def grams() -> Column:
    return F.concat(*_grams(F.col("host"), "^"), *_grams(F.col("path"), "/"))


def trained(spark: SparkSession, labelled: DataFrame | None = None) -> PipelineModel:
    """The classifier from a table of ``url`` and ``label`` (1: block). The table must be small; it is trained in one task."""
    if labelled is None:
        labelled = spark.createDataFrame(labelled_urls(), "url string, label int")
    rows = labelled.filter("url IS NOT NULL AND label IN (0, 1)").coalesce(1)
    rows = rows.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.col("label").cast("double"))
    rows = rows.withColumn("grams", grams())
    counted = HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features")
    regression = LogisticRegression(
        regParam=PULL, maxIter=100, standardization=False, probabilityCol="probability", rawPredictionCol="raw"
    )
    return PipelineModel([counted, regression.fit(counted.transform(rows))])


def judged(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    model: PipelineModel | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``blocking`` (the classifier's probability) and ``verdict``."""
    model = model or trained(pages.sparkSession)
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "blocking", "verdict")]
    # A row's host and path are made before its n-grams, or Spark would make them again for each.
    both = F.struct(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    parts = boxed(pages, F.explode(F.array(both)).alias("_parts")).select("row", "_parts.host", "_parts.path")
    scored = model.transform(parts.withColumn("grams", grams()))
    return scored.withColumn("blocking", vector_to_array("probability")[1]).select(
        *(F.col("row")[c].alias(c) for c in own),
        "host",
        "path",
        matched(rules, "rule").alias("rule"),
        "blocking",
        F.coalesce(matched(rules, "verdict"), F.when(F.col("blocking") >= threshold, "block").otherwise("allow")).alias(
            "verdict"
        ),
    )
