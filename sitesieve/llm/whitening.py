"""Whitening of embeddings from exact cross-products of bit planes.

1. Integers. An entry c becomes x = floor(``scale`` * c) + ``shift``, as a long.
2. Range. One pass finds the least and largest x of every dimension. Less its least value, a dimension's x needs as many bits
   as its range; each of them is a plane.
3. Scatter. A task packs the planes of its rows into words of 64 rows. The rows in which two planes are both set are counted by
   the population count of their words' conjunction. A pair of dimensions has its counts added up by the sum of the two planes'
   exponents, and those are weighed by their powers of two at the end, so every cross-product and sum is an exact integer,
   whatever the number of rows. Only such counts leave a task.
4. Centring. With n rows, sums S and cross-products P, the numerators n * P - S S' of the covariance are integers; each is divided
   by n * n once, and the result goes to ``eigh``.
5. Projection. n * x - S is an exact integer too; divided by n it is a row's deviation from the mean, rounded once.

The identity error is measured, not derived: a pass over the rows sums the products of their whitened entries. Their mean is the
projection of the mean of x - S/n, which is zero, so they are centred as they are.

Bound: the driver and each task hold a number for every pair of dimensions and exponent (64 dimensions of 11 bits: 44,000 numbers;
1,024 of 11 bits: 11 million). Rows are held in blocks.

Nulls and odd rows: a vector that is null, empty, or holds a null or a non-finite entry takes no part and gets no rows. Vectors of
a length other than the most common one (of equally common ones the longest) take no part either. Entries beyond 2^62 / scale are
taken as that. A null id is carried along; repeated rows count and are returned each. An empty table gives no rows.
Components whose eigenvalue is zero, up to rounding (``NOTHING`` of the largest), can't be scaled to one and are left out, so
equal vectors alone give no rows. A deviation too large for a long is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Rows of a block whose planes are packed at a time; a multiple of 64.
BLOCK = 1 << 14
#: Share of the largest eigenvalue below which one is nothing but rounding.
NOTHING = 1e-12
LARGEST = 1 << 62


@dataclass
class Ranges:
    rows: int
    least: np.ndarray
    #: Planes by dimension.
    bits: np.ndarray


@dataclass
class Whitening:
    rows: int
    #: Sums of x less its least value, by dimension, as Python integers.
    sums: list[int]
    least: np.ndarray
    #: Dimensions by components, unit columns.
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        return self.directions / np.sqrt(self.eigenvalues)


def _blocks(batch: pa.RecordBatch, size: int | None, scale: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the rows that take part their places in the batch, and their x as a table; lengths apart if no ``size`` is given."""
    column = batch.column(batch.schema.get_field_index("vector"))
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths) if size is None else [size]:
        place = np.flatnonzero(lengths == length)
        if not length or not len(place):
            continue
        for at in range(0, len(place), BLOCK):
            some = place[at : at + BLOCK]
            # A null entry becomes not-a-number on the way and leaves with the non-finite ones.
            values = column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), length)
            good = np.isfinite(values).all(axis=1)
            if good.any():
                whole = np.clip(np.floor(values[good] * scale), -float(LARGEST), float(LARGEST))
                yield some[good], whole.astype(np.int64) + shift


def _vectors(frame: DataFrame, vector: str, *more: str) -> DataFrame:
    return frame.select(*more, F.col(vector).cast("array<double>").alias("vector"))


def ranges(frame: DataFrame, vector: str, scale: int, shift: int) -> Ranges | None:
    """Least values and bits by dimension over the rows that take part; None if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for _, x in _blocks(batch, None, scale, shift):
                low, high = x.min(axis=0), x.max(axis=0)
                if before := seen.get(x.shape[1]):
                    low, high = np.minimum(low, before[1]), np.maximum(high, before[2])
                seen[x.shape[1]] = ((before[0] if before else 0) + len(x), low, high)
        for size, (number, low, high) in seen.items():
            every = [size] * size, [number] * size, range(size), low.tolist(), high.tolist()
            yield pa.record_batch([pa.array(c, pa.int64()) for c in every], names=["size", "n", "d", "low", "high"])

    found = _vectors(frame, vector).mapInArrow(run, "size long, n long, d long, low long, high long")
    found = found.groupBy("size", "d").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    # The most common length is chosen before anything comes to the driver, where one row per dimension arrives.
    chosen = found.filter("d = 0").orderBy(F.desc("n"), F.desc("size")).limit(1).select("size")
    rows = found.join(F.broadcast(chosen), "size").orderBy("d").collect()
    if not rows:
        return None
    bits = [(r["high"] - r["low"]).bit_length() for r in rows]
    return Ranges(rows[0]["n"], np.array([r["low"] for r in rows]), np.array(bits))


class Scatter:
    """Counts of rows in which two planes are both set, by pair of dimensions and sum of exponents."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.width = 2 * int(bits.max(initial=1)) - 1
        self.dimension = np.repeat(np.arange(len(bits)), bits)
        self.exponent = np.concatenate([np.arange(b) for b in bits]) if len(bits) else np.zeros(0, dtype=int)
        #: For every dimension those from it on, by exponents.
        self.counts = [np.zeros((len(bits) - d, self.width), dtype=np.int64) for d in range(len(bits))]
        self.sums = np.zeros((len(bits), self.width), dtype=np.int64)

    def add(self, x: np.ndarray) -> None:
        """Rows of values from zero on."""
        rows = -(-len(x) // 64) * 64
        planes = np.empty((len(self.dimension), rows // 64), dtype=np.uint64)
        for k, (d, e) in enumerate(zip(self.dimension, self.exponent, strict=True)):
            flags = np.zeros(rows, dtype=np.uint8)
            flags[: len(x)] = (x[:, d] >> e) & 1
            planes[k] = np.packbits(flags, bitorder="little").view(np.uint64)
        for k, (d, e) in enumerate(zip(self.dimension, self.exponent, strict=True)):
            first = k - e  # the first plane of this dimension
            both = np.bitwise_count(planes[k] & planes[first:]).sum(axis=1, dtype=np.int64)
            # Planes of one dimension have different exponents, so no place is met twice.
            self.counts[d][self.dimension[first:] - d, self.exponent[first:] + e] += both
            self.sums[d, e] += int(np.bitwise_count(planes[k]).sum(dtype=np.int64))


def scatter(frame: DataFrame, vector: str, span: Ranges, scale: int, shift: int) -> tuple[list[int], list[list[int]]]:
    """Sums by dimension and cross-products by pair of dimensions, of x less its least value; exact."""
    size, least = len(span.least), span.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Scatter(span.bits)
        for batch in batches:
            for _, x in _blocks(batch, size, scale, shift):
                total.add(x - least)
        for d in range(size):
            rows = [total.sums[d], *total.counts[d]]
            flat = np.concatenate(rows)
            place = np.flatnonzero(flat)
            yield pa.record_batch(
                [
                    pa.array(np.full(len(place), d), pa.int64()),
                    pa.array(place // total.width - 1 + d, pa.int64()),
                    pa.array(place % total.width, pa.int64()),
                    pa.array(flat[place], pa.int64()),
                ],
                names=["d", "other", "exponent", "n"],
            )

    found = _vectors(frame, vector).mapInArrow(run, "d long, other long, exponent long, n long")
    found = found.groupBy("d", "other", "exponent").agg(F.sum("n").alias("n"))
    sums, products = [0] * size, [[0] * size for _ in range(size)]
    for d, other, exponent, n in found.collect():  # a row per pair of dimensions and exponent
        if other < d:
            sums[d] += n << exponent
        else:
            products[d][other] += n << exponent
            if other > d:
                products[other][d] += n << exponent
    return sums, products


def fit(
    frame: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT
) -> Whitening | None:
    """The whitening of the rows that take part; None if there are none or all are equal."""
    span = ranges(frame, vector, scale, shift)
    if span is None:
        return None
    sums, products = scatter(frame, vector, span, scale, shift)
    n, size = span.rows, len(sums)
    # Integers are centred; the division of two integers is rounded once.
    covariance = np.array([[(n * products[a][b] - sums[a] * sums[b]) / (n * n) for b in range(size)] for a in range(size)])
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1], directions[:, ::-1]
    kept = min(components, int((values > NOTHING * values[0]).sum()) if values[0] > 0 else 0)
    if not kept:
        return None
    trace = sum(n * products[a][a] - sums[a] * sums[a] for a in range(size)) / (n * n)
    return Whitening(n, sums, span.least, directions[:, :kept], values[:kept], trace)


def deviations(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, list[int | None]]:
    """x - S/n, each entry rounded once, and the exact sums of squares of n * x - S, null beyond a long."""
    n, low = model.rows, x - model.least
    largest = max(n * int(low.max(initial=0)), max(model.sums))
    if largest < 1 << 62:
        exact = n * low - np.array(model.sums, dtype=np.int64)
        # Longs hold the squares too if a bound of them does.
        if int(np.abs(exact).max(initial=0)) ** 2 * exact.shape[1] < 1 << 63:
            return exact / n, (exact * exact).sum(axis=1).tolist()
        wide = exact.astype(object)
    else:
        wide = n * low.astype(object) - np.array(model.sums, dtype=object)
    squares = [s if s < 1 << 63 else None for s in (wide * wide).sum(axis=1)]
    return (wide / n).astype(float), squares


def identity_error(frame: DataFrame, model: Whitening, vector: str, scale: int, shift: int) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, measured over all rows."""
    size, scaled = len(model.least), model.scaled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((scaled.shape[1],) * 2)
        for batch in batches:
            for _, x in _blocks(batch, size, scale, shift):
                white = deviations(x, model)[0] @ scaled
                total += white.T @ white
        a, b = np.triu_indices(len(total))
        yield pa.record_batch([pa.array(a), pa.array(b), pa.array(total[a, b])], names=["a", "b", "v"])

    found = _vectors(frame, vector).mapInArrow(run, "a long, b long, v double").groupBy("a", "b").agg(F.sum("v").alias("v"))
    entry = F.abs(F.col("v") / model.rows - F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0))
    return found.agg(F.max(entry)).first()[0]


SHAPE = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(
    frame: DataFrame,
    vector: str = "embedding",
    name: str = "vec_id",
    components: int = COMPONENTS,
    scale: int = SCALE,
    shift: int = SHIFT,
) -> DataFrame:
    """A row per vector and component: ``name``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    narrow = _vectors(frame, vector, F.col(name).cast("long").alias("id"))
    model = fit(frame, vector, components, scale, shift)
    if model is None:
        return frame.sparkSession.createDataFrame([], f"id long, {SHAPE}").withColumnRenamed("id", name)
    off = identity_error(frame, model, vector, scale, shift)
    size, scaled, explained = len(model.least), model.scaled, model.eigenvalues / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = scaled.shape[1]
        for batch in batches:
            for place, x in _blocks(batch, size, scale, shift):
                centred, squares = deviations(x, model)
                rows = np.repeat(np.arange(len(x)), kept)
                columns = [
                    batch.column(0).take(pa.array(place)).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), model.rows, dtype=np.int64)),
                    pa.array(squares, pa.int64()).take(pa.array(rows)),
                    pa.array((centred @ scaled).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(rows), off)),
                ]
                names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.record_batch(columns, names=names)

    return narrow.mapInArrow(run, f"id long, {SHAPE}").withColumnRenamed("id", name)
