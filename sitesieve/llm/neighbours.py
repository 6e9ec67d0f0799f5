"""Nearest neighbours by inner product: a few stable projections in a kd-tree, verified until a chi-square test holds.

Vectors get one more component, so that all have the length of the longest; then the largest inner product is the least
Euclidean distance. Projections on ``AXES`` Gaussian directions are 2-stable: the squared projected distance of two vectors,
over their squared distance, is chi-square with ``AXES`` degrees of freedom.

* The projected points are cut by a kd-tree into cells. Its top is fitted on at most ``SAMPLE`` vectors and parts the table
  into cells that each are one task's work; every vector is indexed. Below it, each cell has a kd-tree of leaves of its own.
* A query visits its home cell first. There leaves are taken in order of projected distance and their vectors verified by
  exact inner products, until the test holds: the next leaf is so far that a vector as near as the k-th found so far would be
  that far in projection with a probability below ``MISS``.
* The k-th distance so found decides which other cells the query must visit: all that the same test does not exclude. Every
  cell ends by the same test.

Queries travel to cells, and cells never meet one another. A cell with more vectors than ``CELL``, as where many vectors are
equal, is dealt over several tasks by a hash of the id. A query's answers are merged by a window of k rows per visited cell.

Nulls: vectors that are null, empty, zero or hold null or non-finite components, vectors of another length than most (of
equally common lengths the longest counts), and rows without an id take no part. Of rows with the same id each is a candidate, but none for a query of that
id. Ties in score go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import stored
from .keys import share_of

AXES = 16
NEAREST = 20
SAMPLE = 20_000
#: Vectors of one task, and of one leaf.
CELL = 10_000
LEAF = 256
#: Probability that a true neighbour lies beyond the radius at which a search ends.
MISS = 0.02
#: Queries that a task answers together.
BLOCK = 512
SEED = 11


def chi_square_quantile(share: float, degrees: int) -> float:
    """The value below which a chi-square number lies with probability ``share``: bisection of the incomplete gamma series."""

    def below(x: float) -> float:
        half, x = degrees / 2, x / 2
        term = total = 1 / half
        k = half
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(-x + half * math.log(x) - math.lgamma(half)) if x > 0 else 0.0

    low, high = 0.0, 10.0 * degrees + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < share else (low, mid)
    return high


def directions(size: int, axes: int = AXES, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, axes))


def kd_split(points: np.ndarray, leaf: int) -> tuple[np.ndarray, list[tuple[int, float]]]:
    """Leaf number of each point and, in heap order, the axis and value of every cut. All leaves are at one depth; each cut is
    at the median of the axis of the largest spread.
    """
    depth = max(0, math.ceil(math.log2(max(1, len(points)) / leaf)))
    node = np.zeros(len(points), dtype=np.int64)
    cuts: list[tuple[int, float]] = []
    for level in range(depth):
        order = np.argsort(node, kind="stable")
        bounds = np.searchsorted(node[order], np.arange(2**level + 1))
        right = np.zeros(len(points), dtype=np.int64)
        for k in range(2**level):
            rows = order[bounds[k] : bounds[k + 1]]
            if not len(rows):
                cuts.append((0, 0.0))
                continue
            own = points[rows]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            value = float(np.median(own[:, axis]))
            cuts.append((axis, value))
            right[rows] = own[:, axis] > value
        node = node * 2 + right
    return node, cuts


def kd_leaf(points: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    """Leaf of each point under given cuts."""
    node = np.zeros(len(points), dtype=np.int64)
    axes, values = np.array([c[0] for c in cuts], dtype=np.int64), np.array([c[1] for c in cuts])
    first, size = 0, 1
    while first < len(cuts):
        at = first + node
        node = node * 2 + (points[np.arange(len(points)), axes[at]] > values[at])
        first, size = first + size, size * 2
    return node


def box_distances(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each query to each box, one axis at a time."""
    out = np.zeros((len(queries), len(low)))
    for axis in range(queries.shape[1]):
        q = queries[:, axis, None]
        gap = np.maximum(np.maximum(low[:, axis] - q, q - high[:, axis]), 0)
        out += gap * gap
    return out


def inner_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products added up component by component, so that equal vectors have equal ones wherever they stand."""
    out = np.zeros(len(vectors))
    for j, x in enumerate(query.tolist()):
        out += vectors[:, j] * x
    return out


class Cell:
    """The vectors of one cell in leaves of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray):
        leaf, _ = kd_split(projected, LEAF)
        order = np.argsort(leaf, kind="stable")
        self.ids, self.vectors, projected = ids[order], vectors[order], projected[order]
        self.starts = np.flatnonzero(np.append(True, np.diff(leaf[order]) > 0))
        self.ends = np.append(self.starts[1:], len(order))
        self.low = np.minimum.reduceat(projected, self.starts)
        self.high = np.maximum.reduceat(projected, self.starts)

    def search(
        self, own: np.ndarray, queries: np.ndarray, projected: np.ndarray, known: np.ndarray, longest: float, k: int, reach: float
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per query the up to k best (ids, scores), by verified inner products. ``known``: a k-th score found elsewhere.

        ``reach``: projected over true squared distance beyond which a neighbour is missed with too small a probability.
        """
        far = box_distances(projected, self.low, self.high)
        nearest = np.argsort(far, axis=1, kind="stable")
        for i in range(len(queries)):
            ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
            kth = known[i]
            # Distance in the lengthened space: twice the squared bound less twice the inner product.
            square = longest * longest + float(queries[i] @ queries[i])
            # More than any two ways to add up an inner product differ.
            slack = 4 * queries.shape[1] * np.finfo(float).eps * longest * math.sqrt(float(queries[i] @ queries[i]))
            at = 0
            while at < len(nearest[i]):
                bound = reach * max(0.0, square - 2 * kth) if kth > -np.inf else np.inf
                # Leaves are taken a few at a time; the test is made before each step.
                step = nearest[i][at : at + 4]
                step = step[far[i][step] <= bound]
                if not len(step):
                    break
                at += 4
                rows = np.concatenate([np.arange(self.starts[x], self.ends[x]) for x in step])
                rows = rows[self.ids[rows] != own[i]]
                # A matrix product rounds by a row's place in its block. It only tells which rows can be among the k.
                rough = self.vectors[rows] @ queries[i]
                least = scores[-1] if len(ids) == k else -np.inf
                if len(rows) > k:
                    least = max(least, np.partition(rough, -k)[-k] - slack)
                rows = rows[rough >= least - slack]
                ids = np.concatenate([ids, self.ids[rows]])
                scores = np.concatenate([scores, inner_products(self.vectors[rows], queries[i])])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    kth = max(kth, scores[-1])
            yield i, ids, scores


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def clean(embeddings: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL")
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter((F.size("v") > 0) & usable & F.exists("v", lambda x: x != 0))


def _projected(across: np.ndarray, longest: float, cuts: list[tuple[int, float]], cells: int, divided: dict[int, int]):
    """Adds projections (of the lengthened vector), cell and part to candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column(0).to_numpy(), _matrix(batch.column(1))
            more = np.sqrt(np.maximum(0.0, longest * longest - np.einsum("ij,ij->i", v, v)))
            p = np.hstack([v, more[:, None]]) @ across
            cell = kd_leaf(p, cuts)
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(list(p), pa.list_(pa.float64())),
                    pa.array(cell),
                    pa.array((ids * 0x9E3779B1 & 0x7FFFFFFF) % np.array([divided.get(int(c), 1) for c in cell])),
                ],
                names=["vec_id", "v", "p", "cell", "part"],
            )

    return run


_POINT = "vec_id long, v array<double>, p array<double>, cell long, part long"


def _answers(k: int, longest: float, reach: float):
    """Answers of one cell's part to the queries that visit it. Candidates come before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, cell = None, [], None
        for batch in batches:
            keys = np.stack([batch.column("cell").to_numpy(), batch.column("part").to_numpy()], axis=1)
            query = batch.column("is_query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1) | (query[1:] != query[:-1])))
            for a, b in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
                rows, now = batch.slice(a, b - a), tuple(keys[a])
                if now != key:
                    key, held, cell = now, [], None
                if not query[a]:
                    held.append(rows)
                    continue
                if cell is None:
                    if not held:
                        continue
                    parts = [pa.chunked_array([r.column(n) for r in held]).combine_chunks() for n in ("vec_id", "v", "p")]
                    cell = Cell(parts[0].to_numpy(), _matrix(parts[1]), _matrix(parts[2]))
                    held = []
                for x in range(0, rows.num_rows, BLOCK):
                    block = rows.slice(x, BLOCK)
                    own, known = block.column("vec_id").to_numpy(), block.column("known").to_numpy()
                    out = cell.search(own, _matrix(block.column("v")), _matrix(block.column("p")), known, longest, k, reach)
                    found = [(np.full(len(ids), own[i]), ids, scores) for i, ids, scores in out]
                    columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
                    yield pa.record_batch(columns, names=["query_id", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _visit(points: DataFrame, queries: DataFrame, k: int, longest: float, reach: float) -> DataFrame:
    """``points`` and ``queries`` met per cell and part."""
    names = ["cell", "part", "is_query", "vec_id", "v", "p", "known"]
    candidates = points.withColumn("is_query", F.lit(False)).withColumn("known", F.lit(float("-inf"))).select(names)
    both = candidates.union(queries.withColumn("is_query", F.lit(True)).select(names))
    met = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "is_query")
    return met.mapInArrow(_answers(k, longest, reach), "query_id long, vec_id long, score double")


def nearest(
    embeddings: DataFrame,
    queries: DataFrame,
    k: int = NEAREST,
    axes: int = AXES,
    miss: float = MISS,
    sample: int = SAMPLE,
    cell_size: int = CELL,
    seed: int = SEED,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k best candidates of each query. ``queries`` is a part of the rows of
    ``embeddings``.
    """
    shape = "query_id long, rank int, vec_id long, score double"
    spark = embeddings.sparkSession
    rows = stored(clean(embeddings), "vectors")
    lengths = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    if common is None:
        return spark.createDataFrame([], shape)
    size = common["size"]
    rows = rows.filter(F.size("v") == size)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    number, longest = rows.agg(F.count("*"), F.sqrt(F.max(square))).first()
    across = directions(size + 1, axes, seed)
    reach = chi_square_quantile(1 - miss, axes)
    # The top of the tree, from a bounded sample by a hash of the ids.
    cells = 2 ** max(0, math.ceil(math.log2(number / cell_size)))
    mark = F.xxhash64("vec_id")
    some = rows.filter(share_of(mark, sample, number)).orderBy(mark, "vec_id").limit(sample)
    drawn = some.select("vec_id", "v") if cells > 1 else None
    cuts: list[tuple[int, float]] = []
    if drawn is not None:
        p = drawn.mapInArrow(_projected(across, longest, [], 1, {}), _POINT).select("p").toPandas()["p"]
        _, cuts = kd_split(np.stack(p.to_numpy()), max(1, len(p) // cells))
    cells = len(cuts) + 1
    sizes = rows.mapInArrow(_projected(across, longest, cuts, cells, {}), _POINT)
    corner = [f(F.col("p")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(axes)]
    # One row per cell, and the number of cells follows from CELL.
    known = sizes.groupBy("cell").agg(F.count("*").alias("n"), *corner).collect()
    divided = {r["cell"]: math.ceil(r["n"] / cell_size) for r in known}
    low = np.array([[r[f"low{i}"] for i in range(axes)] for r in known])
    high = np.array([[r[f"high{i}"] for i in range(axes)] for r in known])
    numbers = np.array([r["cell"] for r in known])
    points = stored(rows.mapInArrow(_projected(across, longest, cuts, cells, divided), _POINT), "points")
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id")).filter("vec_id IS NOT NULL").distinct()
    asked = points.join(asked, "vec_id", "left_semi")
    unlengthened = _query_points(across, longest, cuts, divided)
    asked = stored(asked.select("vec_id", "v").mapInArrow(unlengthened, _POINT), "queries")
    spread = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    home = asked.select("vec_id", "v", "p", "cell", F.col("part").alias("parts")).select("vec_id", "v", "p", "cell", spread)
    home = home.withColumn("known", F.lit(float("-inf")))
    found = _best(_visit(points, home, k, longest, reach), k)
    if len(known) > 1:
        found = stored(found, "home")
        kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("known"))
        other = asked.join(kth, asked["vec_id"] == kth["query_id"], "left")
        other = other.select("vec_id", "v", "p", "cell", F.coalesce("known", F.lit(float("-inf"))).alias("known"))
        routed = other.mapInArrow(
            _routed(numbers, low, high, divided, longest, reach),
            "vec_id long, v array<double>, p array<double>, cell long, part long, known double",
        )
        found = _best(found.drop("rank").union(_visit(points, routed, k, longest, reach)), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _query_points(across: np.ndarray, longest: float, cuts: list[tuple[int, float]], divided: dict[int, int]):
    """A query's projection has no added component. ``part`` is the number of parts of its home cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = _matrix(batch.column(1)) @ across[:-1]
            cell = kd_leaf(p, cuts)
            parts = pa.array([divided.get(int(c), 1) for c in cell], pa.int64())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(list(p), pa.list_(pa.float64())), pa.array(cell), parts],
                names=["vec_id", "v", "p", "cell", "part"],
            )

    return run


def _routed(numbers: np.ndarray, low: np.ndarray, high: np.ndarray, divided: dict[int, int], longest: float, reach: float):
    """Each query once for every part of every cell, but its home, that the test does not exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "v", "p", "cell", "part", "known"]
        for batch in batches:
            if not batch.num_rows:
                continue
            v, p, home = _matrix(batch.column(1)), _matrix(batch.column(2)), batch.column(3).to_numpy()
            known = batch.column(4).to_numpy()
            bound = reach * np.maximum(0.0, longest * longest + np.einsum("ij,ij->i", v, v) - 2 * known)
            near = box_distances(p, low, high) <= bound[:, None]
            near &= numbers[None, :] != home[:, None]
            q, c = np.nonzero(near)
            parts = np.array([divided.get(int(numbers[x]), 1) for x in c], dtype=np.int64)
            q, c = np.repeat(q, parts), np.repeat(c, parts)
            part = np.concatenate([np.arange(n) for n in parts]) if len(parts) else np.zeros(0, dtype=np.int64)
            rows = batch.take(pa.array(q))
            columns = [*rows.columns[:3], pa.array(numbers[c]), pa.array(part), rows.column(4)]
            yield pa.record_batch(columns, names=names)

    return run
