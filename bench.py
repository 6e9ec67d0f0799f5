"""Times of the headline queries; prints one JSON line.

Each query runs once to warm up and then once more for the measure, with all result rows computed and counted. The value
is the sum over the queries.

The given ``pages`` are one file of one row group, which one task reads whatever the settings are. Captures of a crawl are stored in
many files; so the pages are first written as two files per core, outside of the times.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from checks import overlay  # noqa: E402
from checks.queries import QUERIES  # noqa: E402
from sitesieve.session import tuned  # noqa: E402

HEADLINES = (
    "findings_dedup",
    "site_score",
    "site_summary",
    "issues_top25",
    "report_sections",
    "endpoints_html_attribute",
    "api_routes_fetch_call",
    "params_form_input",
    "tech_fingerprint_cms",
    "headers_missing",
    "debug_endpoints",
    "js_risky_calls",
    "subdomains_html",
    "link_addresses_same_site",
    "reachable_pages",
)


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    builder = builder.config("spark.sql.shuffle.partitions", cpus)
    spark = tuned(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.TemporaryDirectory(prefix="bench-")
    files = 2 * int(cpus)
    overlay.load(spark, sf_dir, "pages").repartition(files).write.parquet(f"{folder.name}/pages.parquet")
    times = {}
    for name in HEADLINES:
        run(spark, name, folder.name)
        times[name] = round(run(spark, name, folder.name), 3)
    pages = overlay.load(spark, sf_dir, "pages").count()
    print(
        json.dumps(
            {
                "metric": "sum of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "pages": pages,
                "pages_in_files": files,
                "audited_pages_per_second": round(pages / times["findings_dedup"], 1),
            }
        )
    )
    spark.stop()
    folder.cleanup()


if __name__ == "__main__":
    main()
