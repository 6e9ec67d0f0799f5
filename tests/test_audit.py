"""From captures to findings, scores and reports."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitesieve.operators import registry
from sitesieve.operators.candidates import each
from sitesieve.operators.documents import (
    fetched_sitemaps,
    robots_findings,
    sitemap_findings,
    sitemap_requests,
    sitemap_urls,
)
from sitesieve.operators.extract import extract
from sitesieve.operators.python import register_function
from sitesieve.plans import audit as au
from sitesieve.plans import reports as rp
from sitesieve.plans.crawl import audit_reached
from sitesieve.plans.numbering import number_rows
from sitesieve.plans.pipeline import TABLES, run, visited_addresses
from sitesieve.schema import FINDING_COLUMNS
from sitesieve.sources import captures as ca
from sitesieve.sources.storage import settle, write_findings, write_reports

FINDING = (
    "site string, url string, page_id bigint, type string, value string, source string, severity string, context string, "
    "metadata map<string,string>, visit_order bigint, extractor_ord int, rule_ord int, match_ord int"
)


def finding(site="s", type="info", value="v", source="x", severity="info", visit=0, ord=0, context="c"):
    return (site, f"https://{site}/", visit, type, value, source, severity, context, None, visit, 0, 0, ord)


@pytest.fixture
def findings(spark):
    return lambda *rows: spark.createDataFrame(list(rows), FINDING)


class TestCaptures:
    def test_only_answered_text_is_analysed(self, responses):
        frame = responses(
            {"content_type": "text/html; charset=utf-8"},
            {"content_type": "application/javascript"},
            {"content_type": "TEXT/HTML"},
            {"status": 404},
            {"content_type": "image/png"},
            {"status": 0, "error": "refused"},
        )
        assert sorted(r.page_id for r in ca.analyzable(frame).collect()) == [0, 1]
        assert [r.message for r in ca.errors(frame).collect()] == ["https://example.com: refused"]

    def test_normalise_fills_in_what_is_missing(self, spark):
        frame = spark.createDataFrame([(3, "https://A.org:8/x", "h")], "page_id long, url string, html string")
        row = ca.normalise(frame).first()
        assert (row.site, row.visit_order, row.status, row.content_type, row.headers) == (
            "A.org:8", 3, 200, "text/html", None,
        )
        assert extract(ca.normalise(frame), ["audit_headers"]).count() == 9

    def test_round_trip(self, spark, responses, tmp_path):
        responses({"html": "x", "headers": {"B": "1", "A": "2"}}).write.parquet(str(tmp_path / "r"))
        frame = ca.read_responses(spark, str(tmp_path / "r"))
        row = frame.select("html", F.map_entries("headers").alias("headers")).first()
        assert (row.html, [tuple(e) for e in row.headers]) == ("x", [("B", "1"), ("A", "2")])

    def test_filter_reaches_the_files(self, spark, responses, tmp_path):
        responses({"html": "x"}).write.parquet(str(tmp_path / "r"))
        frame = ca.analyzable(ca.read_responses(spark, str(tmp_path / "r")))
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(status,200)" in plan


class TestDocuments:
    def robots(self, spark, content):
        return spark.createDataFrame([("e.com", "https://e.com", content)], "site string, base_url string, content string")

    def test_robots(self, spark):
        content = (
            "User-agent: *\nDisallow: /admin/ \nDisallow:\nAllow: /x\nDISALLOW: /\nSitemap: https://e.com/m.xml\n"
            "# nothing\nCrawl: 1 # the api of\r\n#staging\n"
        )
        rows = robots_findings(self.robots(spark, content)).orderBy("rule_ord", "match_ord").collect()
        assert [(r.value, r.source, r.visit_order) for r in rows] == [
            ("https://e.com/admin/", "robots_disallow", -2),
            # an empty line takes the next one as its value, which then is no relative address
            ("Allow: /x", "robots_disallow", -2),
            ("https://e.com/m.xml", "robots_sitemap", -2),
            ("the api of", "robots_comment", -2),
        ]

    def test_sitemaps(self, spark):
        robots = self.robots(spark, "\n".join(f"Sitemap: https://e.com/{i}.xml" for i in range(7)))
        requests = sitemap_requests(robots, robots.select("site", "base_url"))
        for limit, number in ((None, 7), (5, 5)):
            asked = sitemap_requests(robots, robots.select("site", "base_url"), limit)
            assert [r.sitemap_url for r in asked.orderBy("position").collect()] == [
                *[f"https://e.com/{i}.xml" for i in range(number)],
                "https://e.com/sitemap.xml",
            ]
        many = "".join(f"<loc> https://e.com/p{i}\n</loc><loc>https://o.org/{i}</loc>" for i in range(150))
        docs = spark.createDataFrame(
            [
                ("e.com", "https://e.com/0.xml", 200, many),
                ("e.com", "https://e.com/1.xml", 404, many),
                ("e.com", "https://e.com/2.xml", 200, "<loc>https://o.org/</loc>"),
            ],
            "site string, sitemap_url string, status int, content string",
        )
        fetched = fetched_sitemaps(requests, docs)
        urls = sitemap_urls(fetched).collect()
        assert len(urls) == 150 and urls[0].url == "https://e.com/p0"
        assert sitemap_urls(fetched, 200).count() == 100
        for limit, number in ((None, 150), (200, 100)):
            rows = sitemap_findings(fetched, limit).collect()
            assert [(r.value, r.context, r.visit_order) for r in rows] == [
                (f"{number} URLs from sitemap", f"Parsed 300 URLs, queued {number} for crawling", -1)
            ]


class TestAudit:
    def test_first_page_extractors_run_on_the_first_analysable_page(self, responses):
        frame = responses(
            {"url": "https://a.org/0", "html": "jquery", "status": 500, "visit_order": 0},
            {"url": "https://a.org/1", "html": "svelte", "visit_order": 1},
            {"url": "https://a.org/2", "html": "django", "visit_order": 2},
            {"url": "https://b.org/9", "html": "gatsby", "visit_order": 9, "page_id": 1009},
            {"url": "https://b.org/7", "html": "hugo", "visit_order": 7, "page_id": 1010},
        )
        rows = au.audit(frame).where("source like 'fingerprint%'").collect()
        assert sorted((r.site, r.value) for r in rows) == [("a.org", "Svelte"), ("b.org", "Hugo")]
        stack = au.site_technologies(frame).collect()
        assert sorted((r.site, r.name) for r in stack) == [("a.org", "Svelte"), ("b.org", "Hugo")]

    def test_deduplication_keeps_the_first(self, findings):
        frame = findings(
            finding(value="a", visit=2, context="late"),
            finding(value="a", visit=1, ord=5, context="later on the page"),
            finding(value="a", visit=1, ord=4, context="first"),
            finding(value="a", source="other", visit=3),
            finding(site="t", value="a", visit=9),
        )
        rows = au.deduplicate(frame).collect()
        assert sorted((r.site, r.source, r.context) for r in rows) == [
            ("s", "other", "c"),
            ("s", "x", "first"),
            ("t", "x", "c"),
        ]
        assert au.deduplicate(frame).columns == list(FINDING_COLUMNS)

    def test_documents_come_first_and_can_be_left_out(self, spark, responses):
        frame = responses({"url": "https://e.com/p", "html": '<a href="/x">'})
        robots = spark.createDataFrame(
            [("e.com", "https://e.com", "Disallow: /x\nSitemap: https://e.com/a.xml")],
            "site string, base_url string, content string",
        )
        docs = spark.createDataFrame(
            [("e.com", u, 200, "<loc>https://e.com/1</loc>") for u in ("https://e.com/a.xml", "https://e.com/sitemap.xml")],
            "site string, sitemap_url string, status int, content string",
        )

        def sources(**options):
            found = au.audit(frame, robots, docs, **options)
            return sorted(r.source for r in found.where("type = 'endpoint'").collect())

        assert sources() == ["html_attribute", "robots_disallow", "robots_sitemap", "sitemap"]
        assert sources(check_robots=False) == ["html_attribute", "sitemap"]
        assert sources(check_sitemap=False) == ["html_attribute", "robots_disallow", "robots_sitemap", "sitemap"]
        assert sources(check_robots=False, check_sitemap=False) == ["html_attribute"]
        visited = lambda **options: {r.url for r in visited_addresses(frame, robots, docs, **options).collect()}
        page, listed = "https://e.com/p", {"https://e.com/a.xml", "https://e.com/sitemap.xml"}
        assert visited() == {page, "https://e.com/robots.txt", *listed}
        assert visited(check_robots=False) == {page, "https://e.com/sitemap.xml"}
        assert visited(check_robots=False, check_sitemap=False) == {page}

    def test_one_scan_with_text_and_no_shuffle_of_pages(self, spark, responses, tmp_path):
        """Extraction is narrow: the only exchange of the page findings is the one that finds first pages."""
        responses(*[{"html": "x", "visit_order": i} for i in range(20)]).write.parquet(str(tmp_path / "r"))
        frame = ca.read_responses(spark, str(tmp_path / "r"))
        plan = extract(frame, registry.names(in_audit=True, first_page_only=False))._jdf.queryExecution().executedPlan()
        assert "Exchange" not in plan.toString()
        plan = au.first_pages(ca.analyzable(frame))._jdf.queryExecution().executedPlan().toString()
        lookup = plan[plan.index("Aggregate") :]
        assert "html" not in lookup[lookup.index("FileScan") :].split("ReadSchema")[1]

    def test_flagged_captures_are_read_once_and_not_moved(self, spark, responses, tmp_path):
        rows = [{"html": f"jquery <a href=/x{i}>", "site": f"s{i % 3}.org", "visit_order": i % 11, "status": 500 if i < 3 else 200} for i in range(30)]
        rows = [r | {"visit_order": i} for i, r in enumerate(rows)]
        plain = responses(*rows)
        ca.write_captures(plain, str(tmp_path / "flagged"))
        stored = ca.read_flagged(spark, str(tmp_path / "flagged"))
        assert sorted(r.page_id for r in stored.where("first_page").collect()) == [3, 4, 5]
        columns = ["site", "page_id", "type", "value", "source", "severity", "context"]
        found = sorted(map(tuple, au.audit(stored).select(*columns).collect()))
        assert found and found == sorted(map(tuple, au.audit(plain).select(*columns).collect()))
        settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
        before = {k: spark.conf.get(k) for k in settings}
        try:
            for key, value in settings.items():
                spark.conf.set(key, value)
            plan = au.audit(stored)._jdf.queryExecution().executedPlan()
            scans = plan.toString().split("FileScan")[1:]
            assert len(scans) == 1 and "html#" in scans[0].split("Batched")[0]
            assert "html" not in " ".join(outputs_of_exchanges(plan))
            stack = au.site_technologies(stored)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in stack, [line[:200] for line in stack.split("\n")]
            assert "first_page" in stack.split("PartitionFilters: ")[1].split("]")[0]
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)

    def test_bucketed_captures_are_not_moved_for_the_lookup(self, spark, responses):
        frame = responses(*[{"html": "x", "site": f"s{i % 3}", "visit_order": i} for i in range(30)])
        ca.write_bucketed(frame, "captures_by_page", 4)
        stored = spark.table("captures_by_page")
        settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
        before = {k: spark.conf.get(k) for k in settings}
        try:
            for key, value in settings.items():
                spark.conf.set(key, value)
            firsts = au.first_pages(stored)
            plan = firsts._jdf.queryExecution().executedPlan().toString()
            assert sorted(r.page_id for r in firsts.collect()) == [0, 1, 2]
            assert plan.count("Exchange hashpartitioning(page_id") == 1  # the small side only
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)

    def test_python_extractor_that_fails(self, responses, tmp_path, spark):
        def odd(url, html, headers):
            yield {"value": headers["x"], "metadata": {"n": len(html)}}
            if "bad" in html:
                raise ValueError("no")
            yield {"value": "second", "severity": "low"}

        register_function("odd", odd)
        register_function("wrong_field", lambda url, html, headers: [{"value": 1, "colour": "red"}], first_page_only=True)
        try:
            rows = [{"html": h, "headers": {"X": str(i)}, "visit_order": i, "url": f"https://e.com/{i}"} for i, h in enumerate(("a", "bad", None, "b"))]
            frame = responses(*rows, {"html": "a", "url": "https://e.com/4", "visit_order": 4}, {"html": "bad", "status": 500, "visit_order": 5})
            found = au.audit(frame)
            mine = found.where("source = 'odd'").orderBy("visit_order", "match_ord").collect()
            assert [(r.page_id, r.value, r.severity) for r in mine] == [(0, "0", "info"), (0, "second", "low"), (2, "2", "info"), (3, "3", "info")]
            assert mine[0].metadata == {"n": "1"}
            failed = sorted((r.page_id, r.message) for r in au.extractor_errors(frame).collect())
            assert failed == [
                (0, "https://e.com/0:wrong_field: unknown fields ['colour']"), (1, "https://e.com/1:odd: no"), (4, "https://e.com/4:odd: 'x'"),
            ]
            others = found.where("source NOT IN ('odd')").count()
            paths = run(frame, str(tmp_path / "out"))
            assert spark.read.parquet(paths["errors"]).count() == 3
        finally:
            registry.unregister("odd")
            registry.unregister("wrong_field")
        assert au.audit(frame).count() == others
        assert au.extractor_errors(frame).count() == 0

    def test_audit_of_reached_pages(self, spark, responses):
        page = lambda site, i, *links, **more: {
            "site": f"{site}.org", "url": f"https://{site}.org/{i}", "visit_order": i, "page_id": i + 100 * (site == "b"),
            "html": "".join(f'<a href="{t}">' for t in links) + f'<input name="field_{site}{i}">', **more,
        }
        frame = responses(
            page("a", 0, "/1", "/2", "https://b.org/7"), page("a", 1, "/3"), page("a", 2), page("a", 3, "/4"), page("a", 4), page("a", 9),
            page("b", 0, "/7", status=404), page("b", 7),
        )

        def fields(**options):
            rows = audit_reached(frame, **options).where("value LIKE '%field_%'").collect()
            return sorted((r.site[0], r.value.split("field_")[1]) for r in rows)

        every = [("a", f"a{i}") for i in (0, 1, 2, 3, 4)]
        assert fields() == every
        assert fields(max_depth=0) == every[:1]
        assert fields(max_depth=2) == every[:4]
        assert fields(max_depth=2, max_pages=2) == every[:2]
        assert fields(max_depth=1, follow_external=True) == [*every[:3], ("a", "b7")]
        maps = spark.createDataFrame(
            [("a.org", "https://a.org/sitemap.xml", 200, "<loc>https://a.org/9</loc>")],
            "site string, sitemap_url string, status int, content string",
        )
        assert fields(sitemaps=maps, max_depth=1, max_pages=2) == [("a", "a0"), ("a", "a9")]
        assert fields(sitemaps=maps, max_depth=1, check_sitemap=False) == every[:3]

    def test_own_extractor(self, responses):
        def shouting(page):
            return each(F.regexp_extract_all(page.html, F.lit("[A-Z]{3,}"), F.lit(0)), type="info", source="shouting",
                        value=lambda m: m, once=True)

        registry.register("shouting", shouting)
        try:
            rows = extract(responses({"html": "STOP it NOW STOP"}), ["shouting"]).orderBy("match_ord").collect()
            assert [r.value for r in rows] == ["STOP", "NOW"]
            assert "shouting" in {r.source for r in au.audit(responses({"html": "WOW"})).collect()}
            with pytest.raises(ValueError):
                registry.register("shouting", shouting)
        finally:
            registry.unregister("shouting")


    def test_pipeline_stores_what_the_parts_compute(self, spark, responses, tmp_path):
        frame = responses(
            {"url": "https://a.org/1", "html": "jquery <a href='/x'>", "headers": {"Server": "nginx/1.2"}},
            {"url": "https://a.org/2", "html": "/.git/config", "visit_order": 2},
            {"url": "https://b.org/9", "error": "refused", "status": 0, "page_id": 9},
        )
        paths = run(frame, str(tmp_path))
        stored = spark.read.parquet(paths["findings"])
        columns = ["site", "type", "value", "source", "severity"]
        direct = sorted(map(tuple, au.audit(frame).select(*columns).collect()))
        assert sorted(map(tuple, stored.select(*columns).collect())) == direct
        report = {r.meta.target: r for r in spark.read.json(paths["reports"]).collect()}
        assert report["a.org"].meta.total_findings == len(direct)
        assert [t.name for t in report["a.org"].tech_stack] == ["jQuery", "Nginx"]
        assert (report["b.org"].meta.errors, report["b.org"].meta.urls_visited) == (1, 1)
        tables = {name: spark.read.parquet(path) for name, path in paths.items() if name not in ("reports", "findings")}
        for name, table in TABLES.items():
            assert sorted(map(str, tables[name].collect())) == sorted(map(str, table(stored).select(*tables[name].columns).collect()))
        assert {r.site: r.total_findings for r in tables["summary"].collect()}["a.org"] == len(direct)
        assert tables["pages"].count() == tables["visited"].count()
        score = tables["scores"].first()
        assert score.score == rp.scores(stored).first().score


def outputs_of_exchanges(plan):
    """The columns that every exchange of a plan moves."""
    found = [plan.output().mkString(" ")] if "Exchange" in plan.nodeName() else []
    children = plan.children()
    return found + [o for i in range(children.size()) for o in outputs_of_exchanges(children.apply(i))]


class TestPlans:
    """What must hold however large the tables and however uneven the sites are."""

    def plan(self, frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    def test_limited_lists_drop_rows_before_the_shuffle(self, findings):
        frame = findings(finding(severity="high"))
        for listed in (rp.issues(frame), rp.deductions(frame)):
            plan = self.plan(listed)
            assert plan.index("WindowGroupLimit") > plan.index("Window [")
            partial = plan[plan.rindex("Exchange hashpartitioning(site") :]
            assert "WindowGroupLimit" in partial and "Partial" in partial

    def test_counts_are_aggregated_before_the_shuffle(self, findings):
        frame = findings(finding())
        for counted in (rp.scores(frame), rp.counts(frame), rp.section_counts(frame), rp.tiles(frame)):
            assert "partial_count" in self.plan(counted)

    def test_unlimited_lists_are_range_sorted(self, findings):
        frame = findings(finding(severity="high"))
        for listed in (rp.issues(frame, None), rp.section_listing(frame), rp.json_findings(frame)):
            plan = self.plan(listed)
            assert "rangepartitioning(site" in plan and "Window" not in plan

    def test_patterns_are_literals(self, responses, monkeypatch):
        """No search with a pattern that stands in the data, which would be compiled row by row."""
        from sitesieve.functions import reuse

        def checked(name):
            real, literal = getattr(F, name), "Literal"

            def run(text, pattern, *rest):
                node = pattern._jc.node().getClass().getSimpleName() if hasattr(pattern, "_jc") else literal
                assert isinstance(pattern, str) or node == literal, (name, node)
                return real(text, pattern, *rest)

            return run

        for name in ("rlike", "regexp_extract", "regexp_extract_all", "regexp_replace", "regexp_count", "split"):
            monkeypatch.setattr(F, name, checked(name))
        monkeypatch.setattr(reuse, "_built", type(reuse._built)())
        assert extract(responses({"html": "x"}), registry.names()).count() > 0

    def test_no_cross_join_and_no_python_in_the_audit(self, responses):
        plan = self.plan(au.audit(responses({"html": "x"})))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


class TestReports:
    def test_score(self, findings):
        rows = [finding(value=f"m{i}", severity="medium", ord=i) for i in range(7)]
        rows += [finding(value="h", severity="high", ord=10), finding(value="c" * 80, severity="critical", ord=20)]
        rows += [finding(site="low", severity="low")]
        rows += [finding(site="bad", value=str(i), severity="critical", ord=i) for i in range(30)]
        found = {r.site: r for r in rp.security_scores(findings(*rows)).collect()}
        assert (found["s"].score, found["s"].rating) == (62, "C")
        assert found["s"].deductions == [*[f"-2: m{i}" for i in range(5)], "-8: h", "-20: " + "c" * 60]
        assert (found["low"].score, found["low"].rating, found["low"].deductions) == (100, "A+", [])
        assert (found["bad"].score, found["bad"].rating) == (0, "F")
        assert found["bad"].deductions == [f"-20: {i}" for i in range(20)]

    @pytest.mark.parametrize(
        "score, letter", [(100, "A+"), (95, "A+"), (94, "A"), (85, "A"), (84, "B"), (70, "B"), (69, "C"), (50, "C"), (49, "D"), (30, "D"), (29, "F")]
    )
    def test_rating(self, spark, score, letter):
        assert spark.range(1).select(rp.rating(F.lit(score)).alias("r")).first().r == letter

    def test_summary(self, spark, findings):
        frame = findings(
            finding(type="header", severity="low", value="1"),
            finding(type="header", severity="high", value="2"),
            finding(type="secret", severity="high", value="3"),
        )
        visited = spark.createDataFrame([("s", "u1"), ("s", "u2"), ("quiet", "u3")], "site string, url string")
        errors = spark.createDataFrame([("s", 1, "m")], "site string, page_id long, message string")
        found = {r.site: r for r in rp.summary(frame, visited, errors).collect()}
        assert found["s"].by_type == {"header": 2, "secret": 1}
        assert found["s"].by_severity == {"high": 2, "low": 1}
        assert (found["s"].total_findings, found["s"].urls_visited, found["s"].errors) == (3, 2, 1)
        assert (found["quiet"].total_findings, found["quiet"].urls_visited, found["quiet"].by_type) == (0, 1, None)

    def test_issue_lists(self, findings):
        rows = [finding(value=f"m{i}", severity="medium", ord=i) for i in range(30)]
        rows += [finding(value="late but critical", severity="critical", ord=99), finding(value="low", severity="low")]
        top = rp.issues(findings(*rows)).orderBy("position").collect()
        assert [r.value for r in top] == ["late but critical", *[f"m{i}" for i in range(24)]]
        assert [r.value for r in rp.issues(findings(*rows), None).collect()] == [
            "late but critical", *[f"m{i}" for i in range(30)]
        ]

    def test_sections_and_breakdown(self, findings):
        frame = findings(
            finding(type="secret", severity="high", value="1"),
            finding(type="file", severity="high", value="2"),
            finding(type="file", severity="low", value="3", ord=1),
            finding(type="file", severity="critical", value="4", ord=2),
            finding(type="tech", severity="info", value="5"),
        )
        assert {(r.section, r.type, r.findings) for r in rp.section_counts(frame).collect()} == {
            ("Security Issues", "secret", 1), ("Security Issues", "file", 3), ("Surface Findings", "tech", 1),
        }
        assert {(r.severity, r.findings, r.breakdown) for r in rp.severity_breakdown(frame).collect()} == {
            ("high", 2, "file:1, secret:1"), ("low", 1, "file:1"), ("critical", 1, "file:1"), ("info", 1, "tech:1"),
        }
        rows = rp.report_sections(frame).orderBy("section", "position").collect()
        assert [(r.type, r.position, r.value) for r in rows] == [
            ("secret", 1, "1"), ("file", 1, "4"), ("file", 2, "2"), ("file", 3, "3"),
        ]
        assert rp.tiles(frame).first().critical_high == 3

    def test_numbering_equals_a_window_on_a_skewed_table(self, spark):
        frame = spark.range(3000).select(
            F.when(F.col("id") % 3 > 0, "big").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
            (F.col("id") * 7919 % 3001).alias("o"),
        )
        window = frame.withColumn("position", F.row_number().over(W.partitionBy("g").orderBy("o")).cast("bigint"))
        numbered = number_rows(frame, ["g"], ["o"])
        assert sorted(map(tuple, numbered.collect())) == sorted(map(tuple, window.collect()))

    def test_sinks(self, spark, findings, tmp_path):
        frame = findings(finding(type="file", value="a"), finding(type="secret", value="b"))
        write_findings(frame, str(tmp_path / "f"))
        stored = spark.read.parquet(str(tmp_path / "f")).where("type = 'secret'")
        assert [r.value for r in stored.collect()] == ["b"]
        assert "PartitionFilters: [isnotnull(type" in stored._jdf.queryExecution().executedPlan().toString()
        visited = spark.createDataFrame([("s", "u")], "site string, url string")
        errors = spark.createDataFrame([], "site string, page_id long, message string")
        stack = spark.createDataFrame(
            [("s", 1, 5, "WordPress", "cms", "6.4"), ("s", 1, 2, "React", "framework", "")],
            "site string, page_id long, ord int, name string, category string, version string",
        )
        write_reports(rp.json_reports(frame, visited, errors, stack), str(tmp_path / "j"))
        row = spark.read.json(str(tmp_path / "j")).first()
        assert (row.meta.total_findings, row.meta.security_score.score) == (2, 100)
        assert [t.name for t in row.tech_stack] == ["React", "WordPress"]

    def test_settle_uses_the_configured_folder(self, spark):
        folder = spark.sparkContext.getCheckpointDir()
        assert settle(spark.range(5)).count() == 5
        assert spark.sparkContext.getCheckpointDir() == folder
