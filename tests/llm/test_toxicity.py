"""Segments against all segments, and a model on planted passages."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sitesieve.llm import toxicity as tx


def all_maximal(scores):
    """The definition: the best segment, then the same left and right of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a, len(scores)):
            s = sum(scores[a : b + 1])
            if s > 0 and (best is None or s > best[2] or (s == best[2] and b - a < best[1] - best[0])):
                best = (a, b, s)
    if best is None:
        return []
    a, b, s = best
    left = all_maximal(scores[:a])
    right = [(x + b + 1, y + b + 1, z) for x, y, z in all_maximal(scores[b + 1 :])]
    return [*left, best, *right]


def test_segments():
    rng = np.random.default_rng(5)
    for _ in range(200):
        scores = rng.normal(-0.3, 1, rng.integers(0, 14))
        expected = all_maximal(scores.tolist())
        found = tx.segments(scores)
        assert [x[:2] for x in found] == [x[:2] for x in expected]
        assert np.allclose([x[2] for x in found], [x[2] for x in expected])


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    docs, labels = [], []
    for i in range(900):
        body = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = rng.random() < 0.3
        if toxic:
            at = rng.randrange(len(body))
            body[at:at] = [rng.choice(["vile", "rotten", "filthy"]) for _ in range(3)]
        docs.append((i, " ".join(body)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_model(spark, documents, planted):
    docs, labels = planted
    odd = [(2000, None), (2001, ""), (2002, "??"), (None, "vile rotten filthy"), (2003, "word " * 60_000 + "vile rotten filthy")]
    frame = documents(docs + odd + [docs[0]], extra=True)
    table = spark.createDataFrame(labels + [(7, 1, None), (8, 1, 5), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = tx.fit(frame, table)
    rows = tx.scored(frame, table).collect()
    assert len(rows) == len(docs) + len(odd) + 1
    scores = {r["doc_id"]: r["toxicity"] for r in rows}
    assert all(0 <= s["score"] <= 1 for s in scores.values())
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((scores[i]["score"] >= tx.THRESHOLD) == bool(truth[i]) for i in held)
    for i in held:
        text = docs[i][1]
        for p in scores[i]["passages"]:
            assert set(text[p["start"] : p["end"]].split()) & {"vile", "rotten", "filthy"}
    assert scores[2000]["score"] == scores[2001]["score"] == scores[2002]["score"] < tx.THRESHOLD
    assert scores[None]["score"] >= tx.THRESHOLD and scores[2003]["passages"]
    # Held-out labels change nothing.
    turned = [(i, q, 1 - t if i in held else t) for i, q, t in labels]
    again = tx.fit(frame, spark.createDataFrame(turned, "doc_id long, quality int, toxic int"))
    assert again.odds == model.odds and again.level == model.level


def test_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["toxicity"]["score"] for r in tx.scored(documents([(1, "a b")]), none).collect()] == [0.0]
    assert tx.scored(documents([]), none).count() == 0


def test_rare_insults(spark, documents):
    """Insults that stand in about five learned documents each are enough to find a document that has no other."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    plain, often, rare = [word() for _ in range(600)], ["vile", "rotten", "filthy"], [word() + "zz" for _ in range(60)]
    rows, labels = [], []
    for i in range(2400):
        body = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        toxic = i % 8 == 0
        if toxic:
            at = rng.randrange(len(body))
            body[at:at] = [rng.choice(rare if i % 16 else often) for _ in range(3)]
        rows.append((i, " ".join(body)))
        labels.append((i, 1, int(toxic)))
    frame, table = documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["toxicity"]["score"] >= tx.THRESHOLD for r in tx.scored(frame, table).collect()}
    held = [i for i in found if zlib.crc32(str(i).encode()) % 4 == 2]
    with_rare = [i for i in held if i % 16 == 8]
    assert len(with_rare) > 20 and sum(found[i] for i in with_rare) >= 0.9 * len(with_rare)
    assert sum(found[i] for i in held if i % 8) <= 0.02 * len(held)


def test_many_partitions(spark, documents, planted):
    """Tasks without documents of a class, or without any, change nothing; rows that share an id are drawn by their text."""
    docs, labels = planted
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scores = lambda frame: {r["doc_id"]: r["toxicity"]["score"] for r in tx.scored(frame, table).collect()}
    few = scores(documents(docs[:300]).coalesce(1))
    many = scores(documents(docs[:300]).repartition(400))
    assert few.keys() == many.keys() and all(abs(few[i] - many[i]) < 1e-9 for i in few)
    empty = documents(docs[:100]).repartition(40).union(documents([]).repartition(3))
    assert len(scores(empty)) == 100
    rows = [(1, f"{t} {i}") for i in range(300) for t in ("fair",)] + [(i, t) for i, t in docs[2:300]]
    model = tx.fit(documents(rows), table, sample=200)
    assert model.odds


def test_fitted_on_every_label(spark):
    """More labelled rows than any sample had: the log-odds are those of the counts over all of them, held-out rows left out."""
    ids = range(30_000)
    word = lambda i: "vile" if i % 5 == 0 else "rotten" if i % 7 == 0 else "fair"
    frame = spark.range(30_000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 5 = 0 THEN 'vile' WHEN id % 7 = 0 THEN 'rotten' ELSE 'fair' END || ' day' AS text"
    )
    table = spark.range(30_000).selectExpr("id AS doc_id", "1 AS quality", "int(id % 5 = 0 OR id % 70 = 7) AS toxic")
    model = tx.fit(frame, table)
    learned = [i for i in ids if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(learned) > 20_000
    toxic = lambda i: i % 5 == 0 or i % 70 == 7
    n1 = sum(map(toxic, learned))
    n0 = len(learned) - n1
    a0, a1 = tx.PRIOR * n0 / len(learned), tx.PRIOR * n1 / len(learned)
    assert set(model.odds) >= {"vile", "fair"}
    for name, odds in model.odds.items():
        held = [i for i in learned if name in (word(i), "day")]
        y1 = sum(map(toxic, held))
        y0 = len(held) - y1
        expected = np.log((y1 + a1) / (n1 + 2 * a1 - y1 - a1)) - np.log((y0 + a0) / (n0 + 2 * a0 - y0 - a0))
        assert abs(odds - expected) < 1e-9


def test_curve_from_sums(spark):
    """The curve through points in several tasks against Newton steps over all points at once."""
    rng = np.random.default_rng(4)
    x = np.round(rng.exponential(2, (300, 2)), 1)
    y = (rng.random(300) < 1 / (1 + np.exp(3 - 2 * x[:, 0]))).astype(int)
    n = rng.integers(1, 9, 300)
    rows = [(a, int(b), int(c)) for a, b, c in zip(x.tolist(), y, n, strict=True)]
    points = spark.createDataFrame(rows, "x array<double>, _label long, n long").repartition(5)
    for i, (level, slope, misfit) in enumerate(tx._logistic(points, 2)):
        at = level + slope * np.log1p(x[:, i])
        p = 1 / (1 + np.exp(-at))
        assert abs((n * (y - p)).sum()) < 1e-5
        assert abs((n * (y - p) * np.log1p(x[:, i])).sum() - 0.01 * slope) < 1e-5
        assert abs(misfit + (n * np.log(np.where(y == 1, p, 1 - p))).sum()) < 1e-6


def test_counts_are_handed_on(monkeypatch):
    """A task that hands its counts on early counts the same."""
    batch = pa.record_batch([pa.array(["a b", "b c", "b d"]), pa.array([0, 0, 1]), pa.array([False] * 3)], names=["text", "_label", "_late"])
    monkeypatch.setattr(tx, "HELD", 1)
    found = {}
    for part in tx._counted(iter([batch])):
        for row in part.to_pylist():
            key = (row["word"], row["label"])
            found[key] = found.get(key, 0) + row["n"]
    assert found == {("a", 0): 1, ("b", 0): 2, ("c", 0): 1, ("b", 1): 1, ("d", 1): 1}
