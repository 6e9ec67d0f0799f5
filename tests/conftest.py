import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from sitesieve.operators.extract import extract  # noqa: E402
from sitesieve.schema import RESPONSES  # noqa: E402
from sitesieve.session import tuned  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
    builder = builder.config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
    session = tuned(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def responses(spark):
    """Responses from dicts; what is not given gets a neutral value."""

    def build(*rows):
        full = []
        for i, row in enumerate(rows):
            url = row.get("url", "https://example.com")
            full.append(
                (
                    row.get("site", url.split("//")[1].split("/")[0].split("?")[0]),
                    row.get("page_id", i),
                    url,
                    row.get("visit_order", row.get("page_id", i)),
                    row.get("depth", 0),
                    row.get("status", 200),
                    row.get("content_type", "text/html"),
                    list(row.get("headers", {}).items()),
                    row.get("html", ""),
                    row.get("error"),
                )
            )
        # A map made from a Python dict loses its order on the way, so headers travel as pairs.
        pairs = RESPONSES.replace("map<string,string>", "array<struct<key:string,value:string>>")
        return spark.createDataFrame(full, pairs).withColumn("headers", F.map_from_entries("headers"))

    return build


@pytest.fixture(scope="session")
def find(responses):
    """Findings of one extractor on one page, in order."""

    def run(extractor, html="", headers=None, url="https://example.com"):
        frame = extract(responses({"html": html, "headers": headers or {}, "url": url}), [extractor])
        return frame.orderBy("extractor_ord", "rule_ord", "match_ord").collect()

    return run
