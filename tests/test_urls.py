from urllib.parse import parse_qs, urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from sitesieve.functions.urls import page_address, query_pairs, site_of, url_join, url_parts

BASES = [
    "https://example.com",
    "https://e.com/x/y?q=1#f",
    "https://e.com/a/b/c",
    "http://e.com/a/b/;p?z",
    "https://u:p@e.com:8080/a/b;v=1/c;d?x=1",
    "https://e.com/a//b/",
    "HTTPS://E.com/Up/Case",
]
REFERENCES = [
    "a/b", "../../z//w", "?k=2", "//h.com/a", "foo:bar", "", "/a//b/../c", ".", "..", "./", "../", "d//e", "http:b",
    "https:b", "https://o.org/p?", "https://o.org", "HTTP://X.org/a/../b", "#frag", "a#frag", "/p;x=1?y#z", ";x", "a;",
    "/../../a", "/a/./b/.", "/a/..", "g;x=1/../y", "?", "/a?", "/a#", " /lead", "/a b", "a:b", "1:2", "/x/..;y", "...",
    "/a/.../b", "\t/tab\nline", "mailto:x@y.z", "a/b/../../../..//c", "http://o.org//x//y", "/für/é", "javascript:void(0)",
    "https:///a", "//", "///a", "a?b/../c", "?a=../b", "/a//",
]


def test_join_equals_the_standard_library(spark):
    frame = spark.createDataFrame([(b, r) for b in BASES for r in REFERENCES], "base string, ref string")
    rows = frame.select("base", "ref", url_join(url_parts(F.col("base")), F.col("ref")).alias("joined")).collect()
    wrong = [(r.base, r.ref, r.joined, urljoin(r.base, r.ref)) for r in rows if r.joined != urljoin(r.base, r.ref)]
    assert wrong == []


@pytest.mark.parametrize(
    "base, ref, joined",
    [
        ("https://example.com", "a/b", "https://example.com/a/b"),
        ("https://e.com/x/y?q#f", "../../z//w", "https://e.com/z/w"),
        ("https://e.com/x/y?q=1#f", "?k=2", "https://e.com/x/y?k=2"),
        ("https://e.com/a/b/c", "/a//b/../c", "https://e.com/a//c"),
        ("https://e.com/a/b/c", ".", "https://e.com/a/b/"),
        ("https://e.com/a/b", "d//e", "https://e.com/a/d/e"),
    ],
)
def test_join_goldens(spark, base, ref, joined):
    row = spark.range(1).select(url_join(url_parts(F.lit(base)), F.lit(ref)).alias("x")).first()
    assert row.x == joined


def test_parts_equal_the_standard_library(spark):
    urls = [*BASES, "http://[::1]:80/x", "https://e.com?x", "https://e.com#y", "ftp://f/g"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    for row in frame.select("url", url_parts(F.col("url")).alias("p"), site_of(F.col("url")).alias("site")).collect():
        expected = urlsplit(row.url)
        assert (row.p.scheme, row.p.netloc, row.p.query, row.p.fragment) == (
            expected.scheme,
            expected.netloc,
            expected.query,
            expected.fragment,
        )
        assert row.site == expected.netloc


def test_query_pairs_equal_the_standard_library(spark):
    urls = [
        "https://e.com/?a=1&b=&c&d=x+y%20z&a=2&%6eame=%C3%BC#h=1",
        "/p?x=%zz&y=100%&=v&q=a=b",
        "https://e.com/p",
        "/s?amp=1&amp;u=2",
    ]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    for row in frame.select("url", query_pairs(F.col("url")).alias("p")).collect():
        found = {}
        for pair in row.p:
            found.setdefault(pair.name, []).append(pair.value)
        assert found == parse_qs(urlsplit(row.url).query)


def test_page_address_keeps_the_query_and_drops_the_rest(spark):
    row = spark.range(1).select(page_address(F.lit("https://e.com/a;p=1?q=2#f")).alias("x")).first()
    assert row.x == "https://e.com/a?q=2"
