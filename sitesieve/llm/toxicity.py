"""Toxic passages as maximum-scoring segments of token log-odds.

1. Tokens. From labelled documents, each word's log-odds of standing in a toxic rather than a clean document, under a
   Dirichlet prior of ``PRIOR`` pseudo-occurrences that are spread over the classes by their size. A word counts once per
   document. Words whose log-odds stand out from their standard error keep them; every word then pays ``DRIFT``. By
   how many errors they must stand out is chosen among ``STANDS_OUT``, as the number under which the curve below fits the
   documents that gave no counts best.
2. Segments. One linear scan of a document's tokens (Ruzzo and Tompa) finds all disjoint maximal segments of the summed scores.
3. Calibration. Among clean text, the best segment of n tokens follows an extreme-value law with parameters lambda and K
   (Karlin and Altschul). A segment is a significant passage if fewer than ``EXPECTED`` of its score would occur by chance
   in a document of that length. The surprise of a document's passages is mapped to a probability by a logistic curve, fitted
   on labelled documents that gave no counts.

Labels are learned only from rows whose crc32 of ``doc_id`` as text has a remainder by 4 other than 2. The curve is fitted on
those of remainder 3 under the log-odds of the others; then those of remainder 3 join the log-odds. The model is fitted on all
of these rows; only a caller who names a ``sample`` gets one of about as many, drawn by a hash of their ``doc_id`` and, where an id
has several texts, of the text too. Every word that stands out is a token, unless a caller bounds their number. Only the text
enters a score. What reaches the driver is the tokens and, for each step of the curve's fit, a row of sums per task.

Nulls: a null text scores like an empty one, which has no passage and the probability of such documents; a null ``doc_id`` is
scored, never learned from, and not held out. Labels that are null or neither 0 nor 1 are left out; of several labels of a
document the largest holds. Without labels of both kinds every document scores 0. Repeated rows are scored one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from .keys import share_of

PRIOR = 5.0
#: Standard errors by which a token's log-odds must differ from zero: those to choose from, and the one without a choice.
STANDS_OUT = (4.5, 4.0, 3.5, 3.0, 2.5, 2.0)
USUAL = 3.0
#: What every word costs, so that chance alone does not add up to a segment.
DRIFT = 1.0
EXPECTED = 0.05
THRESHOLD = 0.3
#: Different words that a task counts before it hands the counts on.
HELD = 500_000
LETTERS = re.compile(r"[^\W\d_]+")
SHAPE = "struct<score:double,passages:array<struct<start:int,end:int,surprise:double>>>"


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0  # lambda
    scale: float = 1.0  # K
    slope: float = 0.0
    level: float = -math.inf


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4


def words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, last, score). Only positive scores can begin or end one, so the scan steps from
    one to the next with running sums.
    """
    sums = np.cumsum(scores)
    found: list[list[float]] = []  # first, last, sum before, sum with
    for at in np.flatnonzero(scores > 0).tolist():
        before, with_ = float(sums[at] - scores[at]), float(sums[at])
        new = [at, at, before, with_]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= new[2]:
                # This candidate can't lie inside a larger segment with the new one; earlier ones may.
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], at, found[j][2], with_]
            del found[j:]
            j -= 1
    return [(int(a), int(b), y - x) for a, b, x, y in found]


def word_scores(names: list[str], model: Model) -> np.ndarray:
    get = model.odds.get
    return np.array([get(w, 0.0) for w in names]) - DRIFT


def significant(names: list[str], model: Model) -> list[tuple[int, int, float]]:
    """The significant segments of a text's words as (first, last, surprise)."""
    if not names or not model.odds:
        return []
    chance = math.log(model.scale * len(names))
    kept = [(a, b, model.decay * s - chance) for a, b, s in segments(word_scores(names, model))]
    return [x for x in kept if x[2] > -math.log(EXPECTED)]


def passages(text: str | None, model: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """Total surprise of a text and its significant passages as (first character, end, surprise)."""
    names = words(text)
    kept = significant(names, model)
    if not kept:
        return 0.0, []
    low = (text or "").lower()
    spans = [m.span() for m in LETTERS.finditer(low)]
    return sum(x[2] for x in kept), [(spans[a][0], spans[b][1], s) for a, b, s in kept]


def probability(surprise: float, model: Model) -> float:
    if model.level == -math.inf:
        return 0.0
    return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, model.level + model.slope * math.log1p(surprise)))))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each word, by label and part; a word may come in several rows."""
    counts: dict[tuple[bool, int], Counter] = {(late, label): Counter() for late in (False, True) for label in (0, 1)}
    for batch in batches:
        for text, label, late in zip(*batch.columns, strict=True):
            counts[late.as_py(), label.as_py()].update(set(words(text.as_py())))
            if sum(map(len, counts.values())) > HELD:
                yield from _handed_on(counts)
    yield from _handed_on(counts)


def _handed_on(counts: dict[tuple[bool, int], Counter]) -> Iterator[pa.RecordBatch]:
    """The counts as rows, after which they begin anew."""
    for (late, label), found in counts.items():
        names = pa.array(list(found), pa.string())
        number = len(found)
        # Types are given, since a task may have no document of a class and an empty list has no type of its own.
        columns = [
            names,
            pa.array(list(found.values()), pa.int64()),
            pa.array([label] * number, pa.int64()),
            pa.array([late] * number, pa.bool_()),
        ]
        found.clear()
        yield pa.record_batch(columns, names=["word", "n", "label", "late"])


def _odds(counts: DataFrame, n0: int, n1: int, errors: float, tokens: int | None) -> DataFrame:
    """``word``, ``y0`` (clean documents with it), ``odds``, ``z`` of the words that stand out by ``errors``, first ``tokens``."""
    sums = counts.groupBy("word").agg(
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("y0"),
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("y1"),
    )
    a0, a1 = PRIOR * n0 / (n0 + n1), PRIOR * n1 / (n0 + n1)
    odds = F.log((F.col("y1") + a1) / (F.lit(n1 + 2 * a1) - F.col("y1") - a1)) - F.log(
        (F.col("y0") + a0) / (F.lit(n0 + 2 * a0) - F.col("y0") - a0)
    )
    error = F.sqrt(1 / (F.col("y1") + a1) + 1 / (F.col("y0") + a0))
    weighed = sums.select("word", (F.col("y0") + a0).alias("y0"), odds.alias("odds"), (odds / error).alias("z"))
    strong = weighed.filter(F.abs("z") >= errors)
    return strong if tokens is None else strong.orderBy(F.abs("z").desc(), "word").limit(tokens)


def _background(weights: np.ndarray, scores: np.ndarray) -> float:
    """The lambda for which the mean of exp(lambda * score) is 1."""
    share = weights / weights.sum()
    if not (scores > 0).any() or (share * scores).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    moment = lambda x: float((share * np.exp(np.minimum(x * scores, 700))).sum())
    while moment(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) < 1 else (low, mid)
    return high


def _logistic(points: DataFrame, number: int) -> list[tuple[float, float, float]]:
    """By model the level and slope of a logistic curve through the ``points``, and how badly it fits.

    ``points`` has ``n`` rows each at ``x``, the surprise under each model, with ``_label``. Newton steps pull the slope to zero
    weakly. The sums of a step are made where the points are, for all models at once.
    """
    labels = {r["_label"]: r["n"] for r in points.groupBy("_label").agg(F.sum("n").alias("n")).collect()}
    level = np.full(number, math.log((labels.get(1, 0) + 0.5) / (labels.get(0, 0) + 0.5)))
    slope, going = np.zeros(number), np.ones(number, dtype=bool)
    for _ in range(50):
        pull0, pull1, bend00, bend01, bend11, _ = _steps(points, level, slope)
        for i in np.flatnonzero(going):
            gradient = np.array([pull0[i], pull1[i] - 0.01 * slope[i]])
            curvature = np.array([[bend00[i] + 1e-6, bend01[i]], [bend01[i], bend11[i] + 0.01]])
            step = np.linalg.solve(curvature, gradient)
            level[i], slope[i] = level[i] + step[0], slope[i] + step[1]
            going[i] = abs(step).max() >= 1e-9
        if not going.any():
            break
    misfit = _steps(points, level, slope)[5]
    return [(float(a), float(b), float(c)) for a, b, c in zip(level, slope, misfit, strict=True)]


def _steps(points: DataFrame, level: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Sums over the points by model: the gradient (2), the curvature (3) and the misfit of the curves."""
    level, slope = level.copy(), slope.copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, len(level)))
        for batch in batches:
            if not len(batch):
                continue
            x = np.log1p(np.array(batch.column(0).to_pylist(), dtype=float))
            y, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(float)[:, None] for i in (1, 2))
            at = level + slope * x
            p = 1 / (1 + np.exp(-np.clip(at, -30, 30)))
            bend = n * p * (1 - p)
            misfit = n * np.logaddexp(0, np.where(y > 0, -1, 1) * at)
            sums += [c.sum(axis=0) for c in (n * (y - p), n * (y - p) * x, bend, bend * x, bend * x * x, misfit)]
        yield pa.record_batch([pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    found = points.select("x", "_label", "n").mapInArrow(run, "sums array<double>").collect()  # a row per task
    return np.sum([r["sums"] for r in found] or [[0.0] * 6 * len(level)], axis=0).reshape(6, len(level))


def fit(documents: DataFrame, labels: DataFrame, sample: int | None = None, tokens: int | None = None) -> Model:
    """The model from all labelled rows, or about ``sample`` of them if given, with at most ``tokens`` words if given."""
    rows = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_label"))
    rows = rows.filter(F.col("_label").isin(0, 1) & (remainder("_id") != 2))
    rows = rows.groupBy("_id").agg(F.max("_label").alias("_label"))
    if sample is not None:
        mark = F.xxhash64("_id")
        rows = rows.filter(share_of(mark, sample, rows.count())).orderBy(mark, "_id").limit(sample)
    # Of known size for the planner: the texts are moved only if the labels are too many to be sent to every executor.
    rows = stored(rows, "labels")
    texts = documents.select("text", F.col("doc_id").cast("long").alias("doc_id")).filter(remainder() != 2)
    learned = texts.join(rows, F.col("doc_id") == F.col("_id"))
    learned = learned.select(
        F.col("text").cast("string").alias("text"), F.col("_label").cast("long"), (remainder("_id") == 3).alias("_late"), "_id"
    )
    learned = stored(learned, "learned")
    totals = _sizes(learned)
    if sample is not None and sum(totals.values()) > sample:
        # An id may stand for many rows, so these are drawn again by their text.
        learned = learned.filter(share_of(F.xxhash64("_id", "text"), sample, sum(totals.values())))
        totals = _sizes(learned)
    n0, n1 = totals.get((False, 0), 0), totals.get((False, 1), 0)
    if not n0 or not n1:
        return Model()
    counts = stored(learned.select("text", "_label", "_late").mapInArrow(_counted, "word string, n long, label long, late boolean"), "words")
    strong = _odds(counts.filter("NOT late"), n0, n1, min(STANDS_OUT), tokens).collect()
    all_clean = counts.filter("NOT late AND label = 0").agg(F.sum("n")).first()[0]
    models = [_early([r for r in strong if abs(r["z"]) >= errors], all_clean) for errors in STANDS_OUT]
    late = learned.filter("_late").select("text", "_label")
    for model, scale in zip(models, _chance(late.filter("_label = 0").select("text"), models), strict=True):
        model.scale = scale
    surprise = F.arrow_udf(_surprise(models), "array<double>")
    # Equal points come as one with a count; most texts have no passage under any model.
    points = late.select(surprise("text").alias("x"), "_label").groupBy("x", "_label").agg(F.count("*").alias("n"))
    points = stored(points, "points")
    if points.select("_label").distinct().count() == 2:
        curves = _logistic(points, len(models))
        for model, (level, slope, _) in zip(models, curves, strict=True):
            model.level, model.slope = level, slope
        chosen = int(np.argmin([misfit for *_, misfit in curves]))
    else:
        chosen = STANDS_OUT.index(USUAL)
        models[chosen].level, models[chosen].slope = math.log((n1 + 0.5) / (n0 + 0.5)), 1.0
    model = models[chosen]
    both = _odds(counts, n0 + totals.get((True, 0), 0), n1 + totals.get((True, 1), 0), STANDS_OUT[chosen], tokens)
    model.odds = {r["word"]: r["odds"] for r in both.collect()}
    return model


def _sizes(learned: DataFrame) -> dict[tuple[bool, int], int]:
    """Rows by part and label."""
    found = learned.groupBy("_late", "_label").agg(F.count("*").alias("n")).collect()
    return {(r["_late"], r["_label"]): r["n"] for r in found}


def _early(strong: list, all_clean: int) -> Model:
    """A model without its curve, from rows of ``_odds``."""
    model = Model(odds={r["word"]: r["odds"] for r in strong})
    # Scores and weights of the background: clean words, those without log-odds at the drift.
    weights = np.array([r["y0"] for r in strong] + [max(1.0, all_clean - sum(r["y0"] for r in strong))])
    model.decay = _background(weights, np.array([r["odds"] for r in strong] + [0.0]) - DRIFT)
    return model


def _chance(clean: DataFrame, models: list[Model]) -> list[float]:
    """K by model from the segments that occur in clean documents: expected number per token = K * exp(-lambda * score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, found = 0, [0] * len(models)
        for batch in batches:
            for text in batch.column(0):
                names = words(text.as_py())
                number += len(names)
                for i, model in enumerate(models):
                    found[i] += len(segments(word_scores(names, model))) if names else 0
        yield pa.record_batch([pa.array([x], pa.int64()) for x in (number, *found)], names=names_of)

    names_of = ["n", *(f"found{i}" for i in range(len(models)))]
    sums = clean.mapInArrow(run, ", ".join(f"{x} long" for x in names_of)).agg(*(F.sum(x).alias(x) for x in names_of)).first()
    if not sums["n"]:
        return [1.0] * len(models)
    scales = []
    for i, model in enumerate(models):
        least = min((s - DRIFT for s in model.odds.values() if s > DRIFT), default=0.0)
        scales.append(max(1, sums[f"found{i}"]) / sums["n"] * math.exp(min(50.0, model.decay * least)))
    return scales


def _surprise(models: list[Model]):
    def run(texts: pa.Array) -> pa.Array:
        each = (words(t.as_py()) for t in texts)
        return pa.array([[sum(x[2] for x in significant(names, m)) + 0.0 for m in models] for names in each], pa.list_(pa.float64()))

    return run


def judge(model: Model, text: str = "text") -> Column:
    """A struct of the probability that a text is toxic, and its significant passages."""

    def run(texts: pa.Array) -> pa.Array:
        scores, starts, ends, surprises, offsets = [], [], [], [], [0]
        for t in texts:
            total, found = passages(t.as_py(), model)
            scores.append(probability(total, model))
            for a, b, s in found:
                starts.append(a)
                ends.append(b)
                surprises.append(s)
            offsets.append(len(starts))
        each = pa.StructArray.from_arrays(
            [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(surprises, pa.float64())],
            names=["start", "end", "surprise"],
        )
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), lists], names=["score", "passages"])

    return F.arrow_udf(run, SHAPE)(F.col(text).cast("string"))


def scored(documents: DataFrame, labels: DataFrame, sample: int | None = None) -> DataFrame:
    """``documents`` with a struct ``toxicity``, which replaces a column of that name: ``score`` and ``passages``."""
    return documents.withColumn("toxicity", judge(fit(documents, labels, sample)))
