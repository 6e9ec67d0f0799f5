"""Spelling variants of words, found by pivotal grams.

1. Words are maximal runs of Latin letters of a document, A-Z in lower case; a run that the hash of its document and itself picks
   loses a letter. Tasks count their own words first, so a frequent word is a few rows of the shuffle.
2. Grams. A word's grams are its bigrams with their places. They are ordered by the number of words that have them, rare ones
   first. One edit touches grams of at most ``GRAM`` neighbouring places, so a prefix of ``GRAM`` + 1 rarest grams always keeps one;
   grams as rare as the last of these belong to the prefix too.
3. Pivots. Of the prefix two grams that share no letter are chosen, by dynamic programming over their places, with the smallest
   sum of words that have them. One edit leaves one of the two as it is. So of two near words, the pivots of the one whose
   prefix ends earlier in the order meet the prefix of the other.
4. Index. Pivots meet prefix grams of the same gram under position limits: the same place for words of equal length, the same or
   the next where the other is longer by one letter, the same or the one before where it is shorter. The three numbers
   are one key of an ordinary join. Parities of the letters, of which one edit changes at most two, drop most pairs, and
   the edit distance verifies the rest.
5. Forms. A word's form is its most frequent near word, if that is at least ``MORE`` times as frequent. Forms are followed to the last
   by doubling: their frequencies double at each step, so a chain is short.

Bound: the order of the grams, at most the square of the number of letters (8,100), is sent to the tasks.

Nulls: a null text has no words; a null id hashes like an empty one. Repeated rows count each. An empty table gives no rows. Runs may
have any length. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST = 5
OCCURRENCES = 3
MORE = 2
GRAM = 2
EDITS = 1
#: One of so many runs of a document loses a letter.
SPOILT = 97
#: Words that a task counts before it hands them on.
HELD = 200_000
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def runs(doc_id: int | None, text: str, find) -> Counter:
    """Words of a document that are long enough, with the letters lost."""
    found: Counter = Counter()
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    lowered: Counter = Counter()
    for run, n in Counter(find(text)).items():
        lowered[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    for run, n in lowered.items():
        mark = zlib.crc32(run.encode(), seed)
        if mark % SPOILT == 0:
            at = mark % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < SHORTEST:
                continue
        found[run] += n
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Shorter runs than these can't be words.
    find = re.compile(f"[{LETTERS}]{{{SHORTEST},}}").findall
    held: Counter = Counter()

    def flushed() -> pa.RecordBatch:
        columns = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
        held.clear()
        return pa.record_batch(columns, names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(*batch.columns, strict=True):
            for word, n in runs(doc_id.as_py(), text.as_py() or "", find).items():
                held[word] += n
            if len(held) >= HELD:
                yield flushed()
    yield flushed()


def vocabulary(documents: DataFrame, occurrences: int = OCCURRENCES) -> DataFrame:
    """``word`` and ``n`` of every word with enough occurrences."""
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = narrow.mapInArrow(_counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def grams(word: str) -> list[str]:
    return [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]


def prefix(word: str, order: dict[str, int]) -> list[tuple[int, int]]:
    """Rarest grams as (number in the order, place), sorted; with those as rare as the last."""
    every = sorted((order[g], i) for i, g in enumerate(grams(word)))
    last = every[min(GRAM * EDITS, len(every) - 1)][0]
    return [g for g in every if g[0] <= last]


def pivots(chosen_from: list[tuple[int, int]], weight: list[int], number: int = EDITS + 1) -> list[tuple[int, int]]:
    """``number`` grams that share no letter, of the smallest total weight; empty if there are not so many.

    By dynamic programming over places: the best choice of k among the first grams either leaves the last of them out or adds it to
    the best choice of k - 1 among those that end before it.
    """
    by_place = sorted(chosen_from, key=lambda g: g[1])
    nothing: tuple[int, tuple] = (0, ())
    best: list[list[tuple[int, tuple] | None]] = [[nothing, *[None] * number]]
    free = 0  # grams that end before the one at hand
    for j, gram in enumerate(by_place):
        while by_place[free][1] + GRAM <= gram[1]:
            free += 1
        row = list(best[j])
        for k in range(1, number + 1):
            before = best[free][k - 1]
            if before is not None:
                with_it = (before[0] + weight[gram[0]], (*before[1], gram))
                row[k] = with_it if row[k] is None else min(row[k], with_it)
        best.append(row)
    return list(best[-1][number][1]) if best[-1][number] else []


SHAPE = "word string, n long, size int, last int, parity long, gram int, place int, pivot boolean"


def _indexed(order: dict[str, int], weight: list[int]):
    """A row per gram of a word's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = prefix(word, order)
                # Grams beyond the first few only stand in for each other; the pivots come from the first few.
                picked = set(pivots(found[: GRAM * EDITS + 1], weight))
                parity = 0
                for letter in word:
                    parity ^= 1 << ord(letter) % 63
                for gram, place in found:
                    rows.append((word, n, len(word), found[-1][0], parity, gram, place, (gram, place) in picked))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.record_batch(arrays, names=["word", "n", "size", "last", "parity", "gram", "place", "pivot"])

    return run


def _limits() -> Column:
    """Lengths and places at which the other word may hold a pivot's gram."""
    at = lambda longer, later: F.struct((F.col("size") + longer).alias("size"), (F.col("place") + later).alias("place"))
    return F.array(at(0, 0), at(1, 0), at(1, 1), at(-1, 0), at(-1, -1))


def near(words: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of words with their ``n_a``, ``n_b`` that differ by one letter, each pair once in some order.

    ``words`` are different ones of at least four letters, written already.
    """
    places = F.sequence(F.lit(1), F.length("word") - (GRAM - 1))
    every = words.select(F.explode(F.array_distinct(F.transform(places, lambda i: F.substr("word", i, F.lit(GRAM))))).alias("gram"))
    held = every.groupBy("gram").agg(F.count("*").alias("n")).orderBy("n", "gram").collect()  # one row per gram
    order, weight = {r["gram"]: k for k, r in enumerate(held)}, [r["n"] for r in held]
    index = stored(words.select("word", "n").mapInArrow(_indexed(order, weight), SHAPE), "grams")
    asked = index.filter("pivot").select(
        F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("last").alias("last_a"), F.col("parity").alias("parity_a"),
        "gram", F.inline(_limits()),
    )
    other = index.select(
        F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("last").alias("last_b"), F.col("parity").alias("parity_b"),
        "gram", "size", "place",
    )
    met = asked.join(other, ["gram", "size", "place"]).filter(
        (F.col("last_a") <= F.col("last_b"))
        & (F.bit_count(F.col("parity_a").bitwiseXOR(F.col("parity_b"))) <= 2)
        & (F.levenshtein("a", "b", 1) == 1)
    )
    # A pair may be met by two pivots, and from both sides where the prefixes end alike.
    low = F.col("a") < F.col("b")
    pair = met.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.when(low, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(low, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"),
    )
    return pair.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of every row of ``word``, ``form``: the form's form, and so on."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = now.join(ahead, F.col("root") == F.col("_word"), "left")
        moved = moved.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved"))
        moved = stored(moved, "roots")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def variants(documents: DataFrame, occurrences: int = OCCURRENCES, more: int = MORE) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word."""
    words = stored(vocabulary(documents, occurrences), "vocabulary")
    pairs = stored(near(words), "near")
    both = pairs.select("a", "b", "n_a", "n_b").union(pairs.select("b", "a", "n_b", "n_a"))
    best = both.groupBy(F.col("a").alias("_a"), F.col("n_a").alias("_n")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best")
    )
    enough = -F.col("best.less") >= more * F.col("_n")
    best = best.select(
        "_a", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
    )
    best = stored(best, "forms")
    last = roots(best.filter("form IS NOT NULL").select(F.col("_a").alias("word"), "form"))
    last = last.select(F.col("word").alias("_w"), "root")
    found = words.join(best, F.col("word") == F.col("_a"), "left").join(last, F.col("word") == F.col("_w"), "left")
    return found.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
