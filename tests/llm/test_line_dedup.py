"""Boilerplate lines against plain counting."""

from collections import defaultdict

from pyspark.sql import functions as F

from sitesieve.llm import line_dedup as ld


def test_equals_counting(documents):
    rows = []
    for i in range(120):
        lines = [f"own {i}", "everywhere" if i % 2 else " everywhere\t", f"of {i % 7} sites"]
        lines += ["on five sites"] * (i % 12 < 5) + ["on four sites"] * (i % 12 < 4) + ["", "  "]
        rows.append((i, "\n".join(lines), f"site{i % 12}"))
    rows += [(500, None, "site1"), (501, "", "site2"), (502, "everywhere", None), (503, "everywhere\neverywhere", "site3")]
    rows += [(503, "everywhere\neverywhere", "site3"), (None, "only here", "site4")]
    sites = defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(" \t\r\x0b\x0c") and site is not None:
                sites[line.strip(" \t\r\x0b\x0c")].add(site)
    expected = []
    for i, text, _ in rows:
        lines = [] if text is None else text.split("\n")
        full = [x for x in lines if x.strip(" \t\r\x0b\x0c")]
        gone = [x for x in full if len(sites[x.strip(" \t\r\x0b\x0c")]) >= 5]
        kept = None if text is None else "\n".join(x for x in lines if x not in gone)
        expected.append((str(i), kept, len(full), len(gone)))
    frame = documents(rows, extra=True)
    out = ld.without_boilerplate(frame)
    assert out.columns == [*frame.columns, "n_lines", "n_removed"]
    got = [(str(r["doc_id"]), r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert sum(e[3] for e in expected) > 100


def test_estimates_far_from_the_threshold_are_not_counted(spark):
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("line"), F.concat(F.lit("s"), "id").alias("site"))
    marked = rows.withColumns({"k1": F.lit(0), "k2": F.lit(0)})
    found = ld.boilerplate(marked).collect()
    assert len(found) == 1 and 2500 < found[0]["sites"] < 3500


def test_empty_table(documents):
    assert ld.without_boilerplate(documents([])).count() == 0
