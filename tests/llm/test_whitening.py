"""Whitening against exact rational arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from sitesieve.llm import whitening as wh

SHAPE = "vec_id long, embedding array<double>, label int"


def exact(vectors):
    """n, sums and covariance of x by the definition."""
    rows = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, size = len(rows), len(rows[0])
    sums = [sum(r[d] for r in rows) for d in range(size)]
    mean = [Fraction(s, n) for s in sums]
    centred = [[x - m for x, m in zip(r, mean)] for r in rows]
    covariance = [[sum(c[a] * c[b] for c in centred) / n for b in range(size)] for a in range(size)]
    return n, rows, sums, covariance


def check(found, vectors, ids, components=32):
    n, rows, sums, covariance = exact(vectors)
    size = len(sums)
    values, directions = np.linalg.eigh(np.array([[float(v) for v in r] for r in covariance]))
    values, directions = values[::-1], directions[:, ::-1]
    kept = min(components, size)
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], []).append(r)
    assert set(by_id) == set(ids) and len(found) == len(ids) * kept
    trace = float(sum(covariance[d][d] for d in range(size)))
    signs = None
    for i, row in zip(ids, rows, strict=True):
        mine = sorted(by_id[i], key=lambda r: r["component"])
        assert [r["component"] for r in mine] == list(range(1, kept + 1))
        assert {r["n"] for r in mine} == {n}
        assert {r["deviation"] for r in mine} == {sum((n * x - s) ** 2 for x, s in zip(row, sums))}
        centred = np.array([float(x - Fraction(s, n)) for x, s in zip(row, sums)])
        expected = centred @ directions[:, :kept] / np.sqrt(values[:kept])
        got = np.array([r["whitened"] for r in mine])
        if signs is None and (np.abs(expected) > 1e-3).all():
            signs = np.sign(got / expected)
        if signs is not None:
            assert np.allclose(got, expected * signs, atol=1e-8)
        assert np.allclose([r["explained"] for r in mine], values[:kept] / trace, rtol=1e-9)
        assert all(r["identity_error"] < 1e-9 for r in mine)


def test_against_definition(spark):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(40, 40))
    vectors = (rng.normal(size=(333, 40)) @ mixed * 0.3).tolist()
    vectors += [vectors[0]] * 100  # equal rows
    frame = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SHAPE)
    for parts in (1, 7, 600):
        check(wh.whitened(frame.repartition(parts)).collect(), vectors, list(range(len(vectors))))


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    vectors = [[float(x) for x in rng.normal(size=3)] for _ in range(50)]
    odd = [None, [], [1.0, None, 2.0], [1.0, math.nan, 2.0], [math.inf, 1.0, 2.0], [1.0], [1.0, 2.0]]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(100 + i, v, 0) for i, v in enumerate(odd)]
    frame = spark.createDataFrame(rows, SHAPE)
    for name in ("n", "component", "id", "vector", "deviation", "size"):
        frame = frame.selectExpr("*", f"'x' AS `{name}`")
    check(wh.whitened(frame.repartition(5)).collect(), vectors, list(range(50)))
    single = wh.whitened(spark.createDataFrame([(None, [1.0, 2.0], 0), (None, [2.0, 4.5], 0)], SHAPE)).collect()
    assert {r["vec_id"] for r in single} == {None} and len(single) == 2  # one direction has all the variance


def test_wide_entries(spark):
    """Sums and squares beyond 64 bits stay exact; a deviation beyond a long is null."""
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in rng.integers(-(1 << 52), 1 << 52, 2)] for _ in range(30)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SHAPE)
    model = wh.fit(frame)
    n, _, sums, covariance = exact(vectors)
    assert [s + n * int(low) for s, low in zip(model.sums, model.least)] == sums
    assert model.trace == float(covariance[0][0] + covariance[1][1])
    found = wh.whitened(frame).collect()
    assert all(r["deviation"] is None and r["identity_error"] < 1e-9 for r in found)
    assert wh.deviations(np.array([[1 << 61, 0]]), wh.Whitening(3, [5, 5], np.zeros(2, dtype=np.int64), None, None, 0.0))[1] == [None]


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]])
def test_nothing_to_whiten(spark, rows):
    found = wh.whitened(spark.createDataFrame(rows, SHAPE))
    assert found.count() == 0
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_planes():
    rng = np.random.default_rng(6)
    for bits in ([1, 3, 0, 7], [12, 12], [0]):
        x = np.stack([rng.integers(0, 1 << b, 130) for b in bits], axis=1)
        total = wh.Scatter(np.array(bits))
        total.add(x[:70])
        total.add(x[70:])
        weigh = lambda row: sum(int(c) << e for e, c in enumerate(row))
        for a in range(len(bits)):
            assert weigh(total.sums[a]) == int(x[:, a].sum())
            for b in range(a, len(bits)):
                assert weigh(total.counts[a][b - a]) == int((x[:, a] * x[:, b]).sum())
