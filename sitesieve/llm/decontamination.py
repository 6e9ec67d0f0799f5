"""Benchmark passages in documents: latent semantic retrieval, then longest common subsequences and an answer check.

1. Terms are the words of the benchmark. One pass over all documents writes each as the sequence of its terms, counts the
   blocks of ``HALF`` words that hold each term, and so weighs terms by the square of their inverse frequency over the whole
   corpus, which leaves frequent words little weight.
2. A passage is two neighbouring blocks, as the sum of its terms' weights. A randomised singular value decomposition of
   passages by terms gives ``RANK`` latent directions: a random projection of the passages is refined by ``ROUNDS`` power
   iterations, each one distributed sum over the passages of all documents. Beside them it is fitted on the benchmark's items,
   each ``ITEM_WEIGHT`` times for every ``TEXTS`` documents, so that their share doesn't fall with the size of the corpus.
3. A passage and an item are candidates if the cosine of their latent vectors, the passage's over its full length, is at least
   ``COSINE``. An item of more than ``PIECE`` words is searched in equal pieces of at most that many, any of which makes it a
   candidate. An item of fewer than ``SHORT`` words is too small a part of a passage for that: it is a candidate wherever the
   document holds enough of its words.
4. A candidate is a leak if the longest common subsequence of the item's words and the words around the passage holds
   ``SURE`` of the item; or ``LIKELY`` of it and ``ANSWER`` of the item's answer. The answer is what follows "answer:", or
   else the last sentence.

The benchmark is met in blocks of about ``ITEMS`` pieces, fewer than there are directions, so that what travels to the tasks is
bounded; a benchmark of any size is a number of such blocks. An item stays in one block: one of more pieces than that has as many
directions more. No documents are moved: every step is one pass over them. In a power iteration, a task sums products of two
terms' weights in a table, if there are no more than ``TERMS`` terms; else it sums rows of the basis, which is slower.

Nulls: a null or empty text, of a document or an item, has no words and matches nothing; items and documents without an id are
compared and reported with a null id. Repeated rows are counted, fitted on and reported once each. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from .keys import text_key

HALF = 24
RANK = 256
EXTRA = 16
ROUNDS = 2
ITEMS = 200
ITEM_WEIGHT = 100
#: Documents to which ``ITEM_WEIGHT`` refers.
TEXTS = 2_000
#: Terms whose products a task holds as one table, of 134 MB, and words of documents that it lays out at a time.
TERMS = 1 << 12
LAID = 20_000
#: Words of the longest piece of an item, and of the shortest item that is searched by its vector.
PIECE = 3 * HALF
SHORT = HALF // 2
#: Blocks of a document that are searched at a time.
CHUNK = 256
COSINE = 0.3
SURE = 0.8
LIKELY = 0.6
ANSWER = 0.75
SEED = 5
WORDS = re.compile(r"\w+")
#: Latin-1 with a space for what parts words.
LATIN = bytes(i if WORDS.fullmatch(chr(i)) else 32 for i in range(256))


@dataclass
class Item:
    item_id: int | None
    terms: np.ndarray
    answer: np.ndarray


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def answer_of(text: str | None) -> str:
    """What follows the last "answer:", or else the last sentence."""
    low = (text or "").strip()
    marked = re.split(r"(?i)\banswer\s*:", low)
    if len(marked) > 1 and words(marked[-1]):
        return marked[-1]
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", low) if words(s)]
    return sentences[-1] if sentences else ""


def latin(word: str) -> bool:
    return max(word) <= "\xff"


def pieces(terms: np.ndarray) -> list[np.ndarray]:
    """An item in equal parts of at most ``PIECE`` words."""
    return np.array_split(terms, -(-len(terms) // PIECE))


def common(item: np.ndarray, other: np.ndarray) -> int:
    """Length of the longest common subsequence, with the item's places as the bits of a number."""
    places: dict[int, int] = {}
    for i, term in enumerate(item.tolist()):
        places[term] = places.get(term, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for term in other.tolist():
        match = places.get(term)
        if match:
            hit = row & match
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def _terms(vocabulary: dict[str, int]):
    """Documents as term numbers, -1 for words that are no term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = {w.encode("latin-1"): i for w, i in vocabulary.items() if latin(w)}
        numbers = lambda found, get: np.fromiter(map(get, found, repeat(-1)), np.int32, len(found))

        def terms_of(text: str) -> np.ndarray:
            # The same words as those of ``words``; bytes are parted several times as fast.
            try:
                return numbers(text.lower().encode("latin-1").translate(LATIN).split(), coded.get)
            except UnicodeEncodeError:
                return numbers(words(text), vocabulary.get)

        for batch in batches:
            each = [terms_of(t.as_py() or "") for t in batch.column(3)]
            offsets = np.cumsum([0, *(len(x) for x in each)])
            flat = np.concatenate(each) if each else np.zeros(0, dtype=np.int32)
            terms = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
            yield pa.record_batch([*batch.columns[:3], terms], names=["doc_id", "k1", "k2", "terms"])

    return run


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    column = batch.column(batch.schema.get_field_index("terms"))
    flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _laid_out(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """About ``LAID`` words of whole texts at a time: the terms, the block of each, and how many blocks each text has."""
    sequences = [x for x in _sequences(batch) if len(x)]
    ends = np.cumsum([len(x) for x in sequences])
    for same in np.split(np.arange(len(sequences)), np.flatnonzero(np.diff(ends // LAID)) + 1):
        if len(same):
            part = [sequences[i] for i in same]
            sizes = np.array([len(x) for x in part])
            number = -(-sizes // HALF)
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield np.concatenate(part), np.repeat(np.cumsum(number) - number, sizes) + place // HALF, number


def _frequencies(size: int):
    """Blocks that hold each term, one row per task and term; under -1 the number of blocks, under -2 of texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, blocks, texts = np.zeros(size, dtype=np.int64), 0, 0
        for batch in batches:
            for terms, block, number in _laid_out(batch):
                blocks, texts = blocks + int(number.sum()), texts + len(number)
                known = terms >= 0
                pairs = np.unique(block[known] * size + terms[known])
                found += np.bincount(pairs % size, minlength=size)
        some = np.flatnonzero(found)
        columns = [pa.array(np.append(some, [-1, -2])), pa.array(np.append(found[some], [blocks, texts]))]
        yield pa.record_batch(columns, names=["term", "n"])

    return run


def _passages(rows: np.ndarray) -> np.ndarray:
    """Sums of neighbouring blocks; a single block is a passage."""
    return rows if len(rows) == 1 else rows[:-1] + rows[1:]


def _product(terms: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a text with passages a, of length 1 each: the terms it has, and their rows of the sum of a (a . basis).

    Only terms that occur are touched, as the passages are sparse.
    """
    place = np.flatnonzero(terms >= 0)
    known, block = terms[place], place // HALF
    number = -(-len(terms) // HALF)
    weight = weights[known]
    # Words stand in order of their block, so sums by block are sums of stretches.
    own_blocks, starts = np.unique(block, return_index=True)
    inside, squares = np.zeros((number, basis.shape[1])), np.zeros((number, 1))
    inside[own_blocks] = np.add.reduceat(weight[:, None] * basis[known], starts, axis=0)
    squares[own_blocks, 0] = np.add.reduceat(weight * weight, starts)
    share = _passages(inside) / np.maximum(_passages(squares), 1e-12)
    # A block is part of the passage that begins with it and of the one before.
    each = np.zeros_like(inside)
    each[: len(share)] += share
    if number > 1:
        each[1:] += share
    order = np.argsort(known, kind="stable")
    own, starts = np.unique(known[order], return_index=True)
    return own, np.add.reduceat((weight[:, None] * each[block])[order], starts, axis=0)


def _add_products(table: np.ndarray, terms: np.ndarray, block: np.ndarray, number: np.ndarray, weights: np.ndarray) -> None:
    """Add to ``table`` half of the sum of a a' over the passages a of some texts; the other half is its mirror image.

    Two words meet in a passage if they stand in one block or in neighbouring ones of a text. Words of one block share the
    passages on both sides of it, words of two blocks the one passage that these make.
    """
    place = np.flatnonzero(terms >= 0)
    known, block = terms[place].astype(np.int64), block[place]
    weight, total = weights[known], int(number.sum())
    squares = np.bincount(block, weight * weight, minlength=total)
    last = np.cumsum(number) - 1
    single = last[number == 1]
    across = 1 / np.maximum(squares + np.append(squares[1:], 0), 1e-12)
    across[last] = 0
    within = across + np.append(0, across[:-1])
    within[single] = 1 / np.maximum(squares[single], 1e-12)
    flat, size = table.reshape(-1), len(weights)
    inside, beside = weight * within[block], weight * across[block]
    np.add.at(flat, known * (size + 1), weight * inside / 2)
    # Each word meets the later ones of its block, then those of the next block, if that is one of its text.
    begins, own = np.searchsorted(block, np.arange(total + 2)), np.arange(len(known))
    here = begins[block + 1] - own - 1
    each = here + np.where(across[block] > 0, begins[block + 2] - begins[block + 1], 0)
    one = np.repeat(own, each)
    step = np.arange(len(one)) - np.repeat(np.cumsum(each) - each, each)
    value = np.where(step < here[one], inside[one], beside[one])
    other = one + step + 1
    np.add.at(flat, known[one] * size + known[other], value * weight[other])


def _power(weights: np.ndarray, basis: np.ndarray, most: int = TERMS):
    """Sum over passages a of a (a . basis), row by row of the result; up to ``most`` terms by a table of their products."""

    def by_table(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        size = len(weights)
        table, own = np.zeros((size, size)), np.empty(size)
        # Weights that were sent have a type object of their own, for which ``np.add.at`` is many times slower.
        own[:] = weights
        for batch in batches:
            for terms, block, number in _laid_out(batch):
                _add_products(table, terms, block, number, own)
        rows = range(0, size, 256)
        return np.concatenate([(table[a : a + 256] + table[:, a : a + 256].T) @ basis for a in rows])

    def by_rows(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(basis.shape)
        for batch in batches:
            for terms in _sequences(batch):
                if (terms >= 0).any():
                    own, rows = _product(terms, weights, basis)
                    total[own] += rows
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (by_table if len(weights) <= most else by_rows)(batches)
        columns = [pa.array(np.arange(len(weights))), pa.array(list(total), pa.list_(pa.float64()))]
        yield pa.record_batch(columns, names=["term", "row"])

    return run


def latent(texts: DataFrame, items: list[Item], weights: np.ndarray, rank: int = RANK, weight: float = ITEM_WEIGHT) -> np.ndarray:
    """Terms by latent directions: right singular vectors of the passages of ``texts`` and of the items, ``weight`` times each."""
    size = len(weights)
    width = min(size, rank + EXTRA)
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, width)))[0]
    for _ in range(ROUNDS):
        summed = texts.mapInArrow(_power(weights, basis), "term long, row array<double>")
        slots = [F.sum(F.col("row")[i]).alias(f"c{i}") for i in range(width)]
        table = summed.groupBy("term").agg(*slots).toPandas().sort_values("term")  # terms by width, both bounded
        product = table.drop(columns="term").to_numpy() if len(table) else np.zeros((size, width))
        for piece in (p for item in items for p in pieces(item.terms)):
            own, counts = np.unique(piece, return_counts=True)
            row = _unit(counts * weights[own])
            product[own] += weight * row[:, None] * (row @ basis[own])
        basis, scale, _ = np.linalg.svd(product, full_matrices=False)
    return np.ascontiguousarray(basis[:, : min(rank, int((scale > 1e-9).sum()) or 1)], dtype=np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def _met(item: np.ndarray, held: np.ndarray) -> float:
    """Share of an item's words that are met by words of a text, each by another one; ``held`` are the text's by term."""
    own, counts = np.unique(item, return_counts=True)
    return float(np.minimum(held[own], counts).sum()) / len(item)


def _searched(items: list[Item], weights: np.ndarray, directions: np.ndarray, cosine: float):
    """Leaks of each document: item, common words, the item's words, cosine, whether the answer is there."""
    weighed = directions * weights[:, None]
    parts = [(i, p) for i, x in enumerate(items) for p in pieces(x.terms)]
    item_of = np.array([i for i, _ in parts])
    first = np.flatnonzero(np.diff(item_of, prepend=-1))
    targets = _unit(np.stack([weighed[p].sum(axis=0) for _, p in parts]))
    # Sums are linear, so a term's part in the inner product with every item is one row of a table; beside it the square of
    # the term's weight. A last row of zeros stands for words that are no term.
    table = np.hstack([weighed @ targets.T, (weights * weights)[:, None]])
    table = np.vstack([table, np.zeros((1, table.shape[1]))]).astype(np.float32)
    ones = np.ones((1, HALF), dtype=np.float32)
    shares = np.zeros((len(items), len(weights) + 1), dtype=bool)
    for i, x in enumerate(items):
        shares[i, x.terms] = True

    short = [i for i, x in enumerate(items) if len(x.terms) < SHORT]

    def candidates(terms: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], float]]:
        """By item the stretches of words around the passages that are near it, and the largest cosine."""
        found: dict[int, list[int]] = {}
        most = np.full(len(items), -1.0)
        for at in range(0, len(terms), CHUNK * HALF):
            part = terms[at : at + (CHUNK + 1) * HALF]
            if at and len(part) <= HALF:
                break
            part = np.append(part, np.full(-len(part) % HALF, -1, dtype=part.dtype))
            passages = _passages((ones @ table[part].reshape(-1, HALF, table.shape[1]))[:, 0])
            near = passages[:, :-1] / np.sqrt(np.maximum(passages[:, -1:], 1e-9))
            np.maximum(most, np.maximum.reduceat(near.max(axis=0), first), out=most)
            for p, k in zip(*np.nonzero(near >= cosine), strict=True):
                found.setdefault(int(item_of[k]), []).append(int(p) + at // HALF)
        around: dict[int, list[tuple[int, int]]] = {}
        for i, passages in found.items():
            size = len(items[i].terms)
            stretches = around.setdefault(i, [])
            for p in passages:
                low, high = max(0, p * HALF - size), min(len(terms), (p + 2) * HALF + size)
                if stretches and low <= stretches[-1][1]:
                    low, high = stretches[-1][0], max(high, stretches.pop()[1])
                stretches.append((low, high))
        if short:
            held = np.bincount(terms[terms >= 0], minlength=len(weights))
            around |= {i: [(0, len(terms))] for i in short if _met(items[i].terms, held) >= LIKELY}
        return {i: (stretches, float(most[i])) for i, stretches in around.items()}

    def verified(terms: np.ndarray, i: int, stretches: list[tuple[int, int]]) -> tuple[int, bool] | None:
        """Of the windows that are leaks, the most common words, and whether the answer is there."""
        best = None
        item = items[i]
        size = len(item.terms)
        # Windows of twice the item's words, half of it apart; only those with enough of its words are compared.
        step, width = max(1, size // 2), 2 * size
        for low, high in stretches:
            enough = np.cumsum(np.concatenate([[0], shares[i][terms[low:high]]]))
            starts = np.arange(low, max(low + 1, high - size), step)
            ends = np.minimum(high, starts + width)
            for at in np.flatnonzero((enough[ends - low] - enough[starts - low]) / size >= LIKELY):
                window = terms[starts[at] : ends[at]]
                window = window[shares[i][window]]
                # No common subsequence is longer than the words that both have, repeats included.
                if _met(item.terms, np.bincount(window, minlength=len(weights))) < LIKELY:
                    continue
                shared = common(item.terms, window)
                if shared / size < LIKELY:
                    continue
                answered = len(item.answer) > 0 and common(item.answer, window) >= ANSWER * len(item.answer)
                if (shared / size >= SURE or answered) and (best is None or (shared, answered) > best):
                    best = (shared, answered)
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            names = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for name, terms in zip(names, _sequences(batch), strict=True):
                if not (terms >= 0).any():
                    continue
                for i, (stretches, near) in candidates(terms).items():
                    best = verified(terms, i, stretches)
                    if best is None:
                        continue
                    out.append((*name, items[i].item_id, best[0], len(items[i].terms), near, best[1]))
            kinds = (*[pa.int64()] * 6, pa.float64(), pa.bool_())
            columns = list(zip(*out, strict=True)) or [()] * 8
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.record_batch(arrays, names=[*KEY, *NAMES[1:]])

    return run


NAMES = ["doc_id", "item_id", "common_words", "item_words", "cosine", "answered"]
KEY = ["doc_id", "k1", "k2"]
SHAPE = "doc_id long, k1 long, k2 long, item_id long, common_words long, item_words long, cosine double, answered boolean"


def _block(documents: DataFrame, rows: list, cosine: float) -> DataFrame:
    """Leaks of one block of items."""
    counts = Counter(w for r in rows for w in words(r["text"]))
    vocabulary = {w: i for i, w in enumerate(sorted(counts))}
    numbers = lambda text: np.array([vocabulary[w] for w in words(text)], dtype=np.int64)
    items = [Item(r["item_id"], numbers(r["text"]), numbers(answer_of(r["text"]))) for r in rows]
    narrow = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), *text_key(), F.col("text").cast("string").alias("text")
    )
    texts = stored(narrow.mapInArrow(_terms(vocabulary), "doc_id long, k1 long, k2 long, terms array<int>"), "terms")
    found = texts.select("terms").mapInArrow(_frequencies(len(vocabulary)), "term long, n long")
    held = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row per term
    blocks, number = held.pop(-1, 0), held.pop(-2, 0)
    weights = np.array([np.log((1 + blocks) / (1 + held.get(t, 0))) ** 2 + 1e-3 for t in range(len(vocabulary))])
    # What a task sums has a row per term, however many texts; so there is one task per core.
    whole = texts.select("terms").coalesce(texts.sparkSession.sparkContext.defaultParallelism)
    rank = max(RANK, sum(len(pieces(x.terms)) for x in items) * RANK // ITEMS)
    directions = latent(whole, items, weights, rank, ITEM_WEIGHT * max(1, number / TEXTS))
    return texts.select(*KEY, "terms").mapInArrow(_searched(items, weights, directions, cosine), SHAPE)


def leaks(documents: DataFrame, benchmark: DataFrame, cosine: float = COSINE, block: int = ITEMS) -> DataFrame:
    """``doc_id``, ``item_id``, ``common_words``, ``item_words``, ``cosine``, ``answered`` of every leak."""
    return _named(documents, benchmark, cosine, block).select(*NAMES)


def without_leaks(documents: DataFrame, benchmark: DataFrame, cosine: float = COSINE, block: int = ITEMS) -> DataFrame:
    """The rows of ``documents`` whose text has no leak, whatever their ``doc_id``."""
    found = _named(documents, benchmark, cosine, block).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    leaking = stored(found, "leaking")  # few, and of known size for the planner
    k1, k2 = text_key()
    return documents.join(leaking, (k1 == leaking["_k1"]) & (k2 == leaking["_k2"]), "left_anti")


def _named(documents: DataFrame, benchmark: DataFrame, cosine: float, block: int) -> DataFrame:
    """Leaks with the name of the text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter(F.col("text").rlike(r"\w"))
    # Java and Python agree on the number of words nearly; it only sets the number of blocks.
    number = F.ceil(F.regexp_count("text", F.lit(r"(?U)\w+")) / PIECE)
    parts = -(-(items.agg(F.sum(number)).first()[0] or 0) // block)
    numbered = items.withColumn("_part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, parts))))
    found = documents.sparkSession.createDataFrame([], SHAPE)
    for part in range(parts):
        rows = numbered.filter(F.col("_part") == part).orderBy("item_id", "text").collect()  # about ``block`` pieces
        if rows:
            found = found.union(_block(documents, rows, cosine))
    return found
