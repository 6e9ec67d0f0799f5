"""The registered queries: each has rows on both sides, and a few are compared here in full."""

import duckdb
import pytest

from checks.compare import TABLES
from checks.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_has_rows(con, name):
    assert con.execute(f"SELECT count(*) FROM ({SQL[name]}) AS q").fetchone()[0] > 0


@pytest.mark.parametrize(
    "name", ["endpoints_html_attribute", "findings_dedup", "site_summary", "link_addresses", "report_sections", "url_join"]
)
def test_query_equals_sql(spark, con, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    ours = sorted(tuple(str(row[c]) for c in columns) for row in frame.collect())
    result = con.execute(SQL[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    theirs = sorted(tuple(str(row[found.index(c)]) for c in columns) for row in result.fetchall())
    assert ours == theirs


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
