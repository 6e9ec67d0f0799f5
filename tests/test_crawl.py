"""Links and reachability, against the standard library's parser and a plain queue."""

import contextlib
import html
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from sitesieve.operators.links import page_links, tag_links, unescape
from sitesieve.plans import reachability as re_
from sitesieve.sources import storage


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.links = []

    def handle_starttag(self, tag, attrs):
        if tag not in ("script", "style", "noscript"):
            self.links += [value for name, value in attrs if name in ("href", "src") and value]


@pytest.mark.parametrize(
    "html",
    [
        '<a href="/a">x</a><img src=/b.png alt=x><A HREF=\'/c?x=1&amp;y=2\'>',
        '<script src="no.js">"<a href=no>"</script><style>a{}</style><noscript><a href="/in"></noscript><a href=/after>',
        '<!-- <a href="/no"> --><a title="a > b href=\'no\'" href="/yes"><br/><link rel=x href="/l"/>',
        '<a data-href="/no" xsrc="/no" href = "/spaced"><a href=""><a href><area href="/x" src="/y">',
        '<a href="/n&#47;m&#x2F;&#252;&lt;&quot;">',
        "text < 5 and href='/no' <a\nhref='/multi'\n>",
        '<a href="/unclosed',
        '<style>a{content:"<!--"}</style><a href="/s">1</a>--><a href="/t">',
        '<a title="<!--" href="/q">1</a><a href="/r" title="-->">',
        '<a href="/m">1</a><!-- unterminated <a href="/n">',
        '<script>"<!--"</script ><a href=/a></script><SCRIPT src=x/><a href=/no></script><a href=/b><script/><a href=/c>',
        '<![CDATA[<a href=/no>]]><![if x]><a href=/a><!doctype "<a>"><?php <a href=/no> ?><a href=/b></a href="/no"><a href==/c>',
    ],
)
def test_tag_links_equal_the_standard_parser(spark, html):
    parser = Links()
    parser.feed(html)
    row = spark.createDataFrame([(html,)], "html string").select(tag_links(F.col("html")).alias("l")).first()
    assert row.l == parser.links


def parsed(html):
    parser = Links()
    with contextlib.suppress(AssertionError):  # unknown marked sections end a parse
        parser.feed(html)
    return parser.links


PIECES = (
    "<!--|-->|--|<!-|<!-->|-- >|<script>|</script>|</script |<SCRIPT src=s/>|<script/>|<script a='>'>|<style>|</style >|<noscript>|"
    "</noscript>|<a href=/a>|<a href='/b'>|<A HREF=\"/c?x=1&amp;y\">|<img src = /d />|<a href='/e\"|\">|'>|<a title='<!--' href=/f>|"
    "<a title=\"-->\" src='/g'/>|<a href=/h|<a href|=|/|>|<|</|</a>|</a href='/no'>|</ >|<!doctype html>|<!x|<?php|?>|<![cdata[|]]>|"
    "<![if a]>|<![endif]|]>|<![odd]>| |\n|x|&lt;|<b\x0bc href=/i>|<a\xa0href=/j>|<a b=c/href=/k>|<a 'href=/l>|<a =href=/m>|"
    "<a href==\"/n\">|<a href=\"\" src>|<a href= \"/o|<a href==\"/p|<a\x00href=/q>|<a xhref=/no href\t=\t'/r'class=z src=/s>|\x1c"
).split("|")


def test_tag_links_equal_the_standard_parser_on_mixes(spark):
    rng = random.Random(12)
    pages = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    frame = spark.createDataFrame(list(enumerate(pages)), "i int, html string").select("i", tag_links(F.col("html")).alias("l"))
    found = {r.i: r.l for r in frame.collect()}
    wrong = [(page, found[i], parsed(page)) for i, page in enumerate(pages) if found[i] != parsed(page)]
    assert wrong == []


def test_long_constructs(spark):
    """No construct needs a stack that grows with it."""
    n = 200_000
    pages = [
        "<!--" + "<a href=/no>" * n + "--><a href=/a>",
        "<script>" + "</scrip>" * n + "</script><a href=/a>",
        "<a " + "x=1 " * n + "href=/a>",
        "<a " + "'" * n + " href=/a>",
        "<" * n + "a href=/a>",
        "<a href=/a>" + "<!--" * n,
    ]
    frame = spark.createDataFrame([(p,) for p in pages], "html string").select(tag_links(F.col("html")).alias("l"))
    assert [r.l for r in frame.collect()] == [["/a"]] * len(pages)


def test_page_links(responses):
    html = (
        '<a href="/x;p?q=1#f"><a href="/x?q=1"><a href="mailto:a@b.c"><a href="https://o.org/y"><a href="//e.com/z">'
        '<a href="#top">'
    )
    frame = responses({"url": "https://e.com/dir/page", "html": html})
    rows = page_links(frame).orderBy("position").collect()
    assert [r.link for r in rows] == ["https://e.com/x?q=1", "https://e.com/z", "https://e.com/dir/page"]
    rows = page_links(frame, follow_external=True).orderBy("position").collect()
    assert [r.link for r in rows][1] == "https://o.org/y"


def test_first_capture_of_an_address_counts(responses):
    frame = responses(
        {"url": "https://e.com/", "html": '<a href="/late">', "visit_order": 5},
        {"url": "https://e.com/", "html": '<a href="/early"><a href="/too">', "visit_order": 2},
        {"url": "https://e.com/", "html": '<a href="/failed">', "visit_order": 1, "status": 500},
    )
    rows = re_.link_table(frame).orderBy("position").collect()
    assert [(r.position, r.link) for r in rows] == [(0, "https://e.com/early"), (1, "https://e.com/too")]


def breadth_first(starts, graph, sitemaps, max_depth, max_pages, same_site):
    """Level by level, one address after the other, sitemap entries in front of level 1."""
    out = []
    for site, start in starts:
        order, seen = [], set()
        levels = {0: [start], 1: [u for s, u in sitemaps if s == site]}
        for depth in range(max_depth + 1):
            following = []
            for url in levels.get(depth, []):
                if url in seen or (max_pages is not None and len(order) >= max_pages):
                    continue
                seen.add(url)
                order.append((site, url, depth))
                following += [t for t in graph.get(url, []) if not same_site or t.split("/")[2] == site]
            levels[depth + 1] = levels.get(depth + 1, []) + following
        out += order
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("same_site", [True, False])
@pytest.mark.parametrize("max_pages", [None, 6])
def test_reachable_equals_a_queue(spark, responses, seed, same_site, max_pages):
    rng = random.Random(seed)
    urls = [f"https://s{i % 2}.org/{i}" for i in range(40)]
    graph = {u: [rng.choice(urls) for _ in range(rng.randint(0, 4))] for u in urls[:36]}
    rows = [
        {"url": u, "html": "".join(f'<a href="{t}">' for t in targets), "page_id": i}
        for i, (u, targets) in enumerate(graph.items())
    ]
    sitemaps = [("s0.org", "https://s0.org/8"), ("s0.org", "https://s0.org/not-captured")]
    frame = responses(*rows)
    starts = re_.start_pages(frame)
    listed = spark.createDataFrame([(s, u, i) for i, (s, u) in enumerate(sitemaps)], "site string, url string, pos int")
    found = re_.reachable(starts, re_.link_table(frame, not same_site), listed, max_depth=3, max_pages=max_pages).collect()
    expected = breadth_first([(r.site, r.url) for r in starts.collect()], graph, sitemaps, 3, max_pages, same_site)
    assert sorted((r.site, r.url, r.depth) for r in found) == sorted(expected)
    if max_pages is not None:
        for site in ("s0.org", "s1.org"):
            order = [r.url for r in sorted(found, key=lambda r: r.visit) if r.site == site]
            assert order == [u for s, u, _ in expected if s == site]


@pytest.mark.parametrize("max_pages", [None, 6])
def test_levels_move_only_their_own_rows(spark, responses, monkeypatch, max_pages):
    """Without broadcasts neither the links nor what was seen is behind an exchange that sorts or meets addresses."""
    plans = []
    add = storage.Buckets.add

    def planned(self, frame, step=0):
        dealt = frame.repartition(self.number, *self.keys)
        plans.append((step, dealt._jdf.queryExecution().executedPlan().toString()))
        add(self, frame, step)

    monkeypatch.setattr(storage.Buckets, "add", planned)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [{"url": f"https://s.org/{i}", "html": f'<a href="/{i + 1}">', "page_id": i} for i in range(5)]
        frame = responses(*rows)
        found = re_.reachable(re_.start_pages(frame), re_.link_table(frame), max_depth=2, max_pages=max_pages)
        assert sorted((r.url, r.depth) for r in found.collect()) == [(f"https://s.org/{i}", i) for i in range(3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    levels = [plan.splitlines() for step, plan in plans if step > 0]
    assert len(levels) == 2
    for lines in levels:
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        for i, line in enumerate(lines):
            if "FileScan" not in line or "links_" not in line:
                continue
            above, at = [], depth(line)
            for other in reversed(lines[:i]):
                if depth(other) < at:
                    at = depth(other)
                    above.append(other)
            met = next(j for j, other in enumerate(above) if "SortMergeJoin" in other)
            assert not any("Exchange" in other for other in above[:met])
        assert sum("Exchange hashpartitioning(url" in line for line in lines) == 1
        assert sum("Exchange hashpartitioning(site" in line and ", url" in line for line in lines) == (1 if max_pages is None else 2)


def test_nothing_stays_in_the_catalog(spark, responses):
    frame = responses({"url": "https://s.org/", "html": '<a href="/a">'})
    found = re_.reachable(re_.start_pages(frame), re_.link_table(frame))
    assert spark.sql("SHOW TABLES").count() == 0
    assert sorted(r.depth for r in found.collect()) == [0, 1]


def test_character_references_equal_the_standard_library(spark):
    rng = random.Random(4)
    parts = ["&#38;lt;", "&#38;#60;", "&#60;", "&lt;", "&lt", "&amp", "&eacute;", "&eacute", "&notit;", "&notin;", "&nosuch;", "&", "&;"]
    parts += ["&#x80;", "&#129;", "&#xD800;", "&#x110000;", "&#0;", "&#00000000065;", "&#x" + "0" * 40 + "41;", "&#" + "9" * 60, "&#1;"]
    parts += ["&#xFFFE;", "&#65", "&#x41g", "&#x;", "&#;", "&CounterClockwiseContourIntegral;", "&" + "a" * 40 + ";", "x", " ", "/a?b=1&c=2"]
    parts += ["&sol;", "&nbsp;", "&copy2", "&NotEqualTilde;", "é", "\U0001F600", "&#x1F600;"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(300)] + parts
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(unescape(F.col("t"))).collect()] == [html.unescape(t) for t in texts]
