"""Planted notices are found, in other words too, and prose is left alone."""

import random

from pyspark.sql import functions as F

from sitesieve.llm import license_scan as ls


def test_notices(documents):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["the", "er", "ing", "on", "st", "ha"]) for _ in range(rng.randint(1, 3)))
    prose = lambda: "\n".join(" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(3))
    rows = [(i, prose()) for i in range(150)]
    rows += [
        (200, prose() + "\nReleased under the MIT License."),
        (201, "This work is licensed under the GNU General Public License, version 3.\n" + prose()),
        (202, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0\nLicensed under CC BY-NC 4.0."),
        (203, None), (204, ""), (205, "\n\n"), (206, "word"), (None, "Released under the MIT License."),
        (207, "Released under the MIT License."), (207, "Released under the MIT License."),
        (208, "the licence of the house was the permission of a copyright that nobody had"),
    ]
    found = {r["doc_id"]: (r["paragraphs"], r["notices"], r["families"]) for r in ls.licences(documents(rows, extra=True)).collect()}
    assert found[200] == (4, 1, "mit")
    assert found[201][1:] == (1, "gpl")
    assert found[202] == (2, 2, "apache,cc-by-nc")
    assert found[207] == (2, 2, "mit") and found[None] == (1, 1, "mit")
    assert [found[i] for i in (203, 204, 205, 206)] == [(0, 0, ""), (0, 0, ""), (0, 0, ""), (1, 0, "")]
    assert found[208][1] == 0
    assert all(found[i][1] == 0 for i in range(150))


def test_short_and_embedded_notices(documents):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["the", "er", "ing", "on", "st", "ha"]) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, "\n".join(prose(rng.randint(3, 30)) for _ in range(3))) for i in range(150)]
    rows += [
        (200, prose(20) + "\nAll rights reserved."),
        (201, prose(100) + ". Licensed under CC BY-NC 4.0. " + prose(100)),
        (202, prose(100) + " released under the MIT License " + prose(60) + " all rights reserved " + prose(60)),
        (203, "Copyright 2021 Example. All rights reserved."),
        (204, "the rights of all were reserved in the house of the publisher and by any of the means"),
    ]
    found = {r["doc_id"]: (r["notices"], r["families"]) for r in ls.licences(documents(rows)).collect()}
    expected = {200: "proprietary", 201: "cc-by-nc", 202: "mit,proprietary", 203: "proprietary", 204: ""}
    assert {i: found[i] for i in expected} == {i: (len([x for x in f.split(",") if x]), f) for i, f in expected.items()}
    assert all(found[i][0] == 0 for i in range(150))


def test_lines_of_words(spark):
    """One search of the text finds the words that a search of each line finds."""
    rng = random.Random(9)
    pieces = ["a", "B", "é", "1", ".", "-", "..", " ", "\n", "\t", "!", "\r", "x.y", "2.0", "\u2028", "İ", "日"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(500)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = ls._lines_of_words(F.col("text"))
    each = F.transform(F.split("text", "\n"), ls.words_of)
    assert frame.filter(~whole.eqNullSafe(each)).count() == 0


def test_paragraphs_without_a_known_pair_are_never_confirmed(spark, documents):
    """What is left out before the classifier is what no template confirms."""
    rng = random.Random(10)
    words = "all rights reserved licensed under the mit license of this work is and public gpl version 3 house".split()
    rows = [(i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(3))) for i in range(200)]
    templates = ls._templates(spark).select("family", "pairs").collect()
    known = {p for r in templates for p in r["pairs"]}
    judged = ls._judged(documents(rows), sorted(known)).collect()
    kept = {(r["doc_id"], r["paragraph"]) for r in judged}
    pairs = lambda line: list(zip(line.split(), line.split()[1:]))
    expected = {(i, k) for i, t in rows for k, line in enumerate(t.split("\n")) if any(" ".join(p) in known for p in pairs(line))}
    assert kept == expected


def test_empty_table(documents):
    assert ls.licences(documents([])).count() == 0
