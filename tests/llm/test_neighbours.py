"""Neighbours against brute force."""

import numpy as np
import pytest

from sitesieve.llm import neighbours as nb


def exact(ids, vectors, asked, k):
    out = {}
    for q in asked:
        scores = vectors @ vectors[ids.tolist().index(q)]
        best = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(scores[i])) for i in best]
    return out


@pytest.mark.parametrize(("cell", "scale"), [(10_000, False), (150, False), (150, True)])
def test_recall(spark, cell, scale):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((1200, 24)) + 2 * rng.standard_normal((12, 24))[rng.integers(0, 12, 1200)]
    vectors[900:] = vectors[5]  # a third of all vectors are equal
    if scale:
        vectors *= rng.uniform(0.5, 2, (1200, 1))
    ids = np.arange(1200) * 3
    frame = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, label int")
    asked = frame.filter("vec_id % 20 = 0")
    found = nb.nearest(frame, asked, k=10, cell_size=cell, sample=400).collect()
    expected = exact(ids, vectors, [int(i) for i in ids if i % 20 == 0], 10)
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(expected)
    hits = total = 0
    for q, best in expected.items():
        assert len(got[q]) == 10 and [x[1] for x in got[q]] == sorted((x[1] for x in got[q]), reverse=True)
        hits += sum(a[1] >= best[-1][1] - 1e-9 for a in got[q])
        total += len(best)
        for i, s in got[q]:
            assert abs(s - vectors[i // 3] @ vectors[q // 3]) < 1e-9
    assert hits / total >= 0.95


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.5, 0.5]), (40, None), (60, [0.0, 0.0]), (80, [None, 1.0])]
    rows += [(100, [inf, 0.0]), (120, [nan, 0.0]), (None, [1.0, 1.0]), (140, []), (3, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS v", "2 AS cell", "3 AS p")
    found = nb.nearest(frame, frame.filter("vec_id % 20 = 0"), k=3).collect()
    got = {q: [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 20)}
    assert {r["query_id"] for r in found} == {0, 20}
    assert got[0] == [(1, 1.0), (2, 1.0), (20, 0.5)]
    assert got[20] == [(0, 0.5), (1, 0.5), (2, 0.5)]


@pytest.mark.parametrize("cell", [10_000, 700, 130])
def test_ties(spark, cell):
    """Equal vectors have equal scores, so the smaller ids come first wherever the vectors stand."""
    rng = np.random.default_rng(cell)
    base = rng.standard_normal((4, 37))
    vectors = np.concatenate([np.repeat(base, [3000, 40, 25, 1], axis=0), 0.3 * rng.standard_normal((900, 37))])
    order = rng.permutation(len(vectors))
    vectors = vectors[order]
    ids = np.arange(len(vectors))
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    found = nb.nearest(frame.repartition(7), frame.filter("vec_id % 200 = 0"), cell_size=cell, sample=500).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q, rows in got.items():
        scores = nb.inner_products(vectors, vectors[q])
        assert len(rows) == 20 and rows == sorted(rows, key=lambda x: (-x[1], x[0]))
        assert all(s == scores[i] for i, s in rows)
        same = {}
        for i, s in rows:
            same.setdefault(s, []).append(i)
        last = rows[-1][1]
        for s, members in same.items():
            every = [int(i) for i in np.flatnonzero(scores == s) if i != q]
            assert members == every[: len(members)] and (s == last or members == every)


def test_one_vector_of_another_length(spark):
    rows = [(0, [1.0]), *((i, [1.0, float(i)]) for i in range(1, 30))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nb.nearest(frame, frame.filter("vec_id % 20 = 0")).collect()
    assert {r["query_id"] for r in found} == {20} and [r["vec_id"] for r in found if r["rank"] == 1] == [29]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nb.nearest(frame, frame).count() == 0


def test_chi_square():
    for share, degrees, value in ((0.95, 1, 3.841459), (0.9, 6, 10.644641), (0.99, 16, 31.999927)):
        assert abs(nb.chi_square_quantile(share, degrees) - value) < 1e-5
