"""Repeated byte passages, by difference-cover suffix arrays of the text that can repeat.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere else in the table, in the same document
or another; overlaps count, and all strings are judged on the input.

A suffix array of every byte of the corpus would move several times the corpus. The table is first reduced to the text whose
order can matter, without losing a repeat:

1. Stretches. A string of ``LENGTH`` bytes has an anchor, the leftmost of its ``GRAM``-byte pieces with the least hash, which equal strings
   share at the same place. Neighbouring strings of one anchor form a stretch, about ``LENGTH + LENGTH / 3`` bytes. A stretch
   travels as four numbers: text, first and last start, anchor and hash.
2. A stretch whose anchor occurs once cannot repeat. Where all stretches of an anchor are equal, they all repeat.
3. For the other anchors one copy of each distinct stretch is fetched, and stretches of one anchor go to one task. There a
   difference-cover suffix array is built: triples at the positions i mod 3 = 1, 2 are sorted and named, the names are sorted
   by recursion until they are distinct or stand for ``LENGTH`` bytes, the remaining suffixes are sorted by first byte and
   sampled rank and merged in. Neighbours in the array that share ``LENGTH`` bytes are repeats.

An anchor with more text than a task should hold is split by what its strings share: the starts of a stretch are halved, the
bytes common to all strings of a half are its new key, and so on until the halves are single strings, which are equal by
their key. So no group is too large for a task.

Nulls: a null text is empty; a null ``doc_id`` is carried along. Repeated rows repeat each other's text. Texts under ``LENGTH``
bytes are kept whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from .keys import text_key

LENGTH = 200
GRAM = 40
#: Bytes that are scanned at a time, and bytes of stretches that are sorted at a time.
PIECE = 1 << 21
SORTED = 1 << 20
#: Bytes of stretches under one key that one task sorts together.
CROWD = 1 << 20
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _BASE, dtype=np.uint64)
    up[0] = 1
    down = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def stretches(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """First start, last start, anchor place, anchor and hash of every stretch of one piece of at most ``PIECE`` bytes."""
    none = np.zeros(0, dtype=np.int64)
    if len(text) < length:
        return none, none, none, none, none
    size = 1 << max(16, (len(text) + 1).bit_length())
    up, down = _powers(size)
    letters = np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(letters * up[: len(text)])])
    grams = _mixed((sums[gram:] - sums[:-gram]) * down[: len(text) - gram + 1])
    # A gram's hash above its place: the least number of a window is that of its leftmost gram of the least hash.
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    window, step = length - gram + 1, 1
    while step * 2 <= window:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    number = len(text) - length + 1
    least = np.minimum(least[:number], least[window - step : window - step + number])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    first, last = new, np.append(new[1:], number) - 1
    at = anchor[new]
    spans = (last - first + length).astype(np.uint64)
    whole = (sums[last + length] - sums[first]) * down[first]
    offset = (at - first).astype(np.uint64)
    digest = _mixed(whole ^ _mixed(spans * np.uint64(1 << 20) + offset))
    return first, last, at, grams[at].view(np.int64), digest.view(np.int64)


def _pieces(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """A long text in pieces that overlap by ``length - 1`` bytes, so that each start is in one piece."""
    for at in range(0, max(1, len(text) - length + 1), PIECE):
        yield at, text[at : at + PIECE + length - 1]


def _scan(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[np.ndarray, ...]] = []
            k1, k2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i, text in enumerate(batch.column(0)):
                data = text.as_buffer()
                if data is None or data.size < length:
                    continue
                for at, piece in _pieces(data.to_pybytes(), length):
                    first, last, place, anchor, digest = stretches(piece, length, gram)
                    keys = (np.full(len(first), k1[i]), np.full(len(first), k2[i]))
                    rows.append((*keys, first + at, last + at, place + at, anchor, digest))
            if rows:
                columns = [pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)]
                yield pa.record_batch(columns, names=["k1", "k2", "first", "last", "place", "anchor", "digest"])

    return run


def suffix_order(text: np.ndarray, length: int, cover: int = 1) -> np.ndarray:
    """Suffix array by difference cover. ``text`` holds names from 0 that stand for ``cover`` bytes each; suffixes that share
    ``length`` bytes may stand in any order.
    """
    size = len(text)
    if size < 3:
        return np.array(sorted(range(size), key=lambda i: text[i:].tolist()), dtype=np.int64)
    if cover >= length:
        return np.argsort(text, kind="stable")
    names = np.concatenate([text.astype(np.int64) + 1, np.zeros(3, dtype=np.int64)])
    top = int(names.max()) + 1
    places = np.arange(size)
    # Where the first part would end in a whole triple, one past the end parts it from the second.
    sample = np.concatenate([np.arange(1, size + (size % 3 == 1), 3), places[2::3]])
    if top < 1 << 21:
        triples = (names[sample] * top + names[sample + 1]) * top + names[sample + 2]
    else:
        pairs = np.unique(names[sample] * top + names[sample + 1], return_inverse=True)[1]
        triples = pairs * top + names[sample + 2]
    named = _named(triples)
    if int(named.max()) + 1 == len(sample):
        order = np.empty(len(sample), dtype=np.int64)
        order[named] = np.arange(len(sample))
    else:
        order = suffix_order(named, length, cover * 3)
    # Ranks from 1 of sampled suffixes, 0 past the end.
    rank = np.zeros(size + 3, dtype=np.int64)
    sampled = sample[order]
    rank[sampled] = np.arange(1, len(sample) + 1)
    sampled = sampled[sampled < size]
    wide = len(sample) + 1
    rest = places[::3]
    rest_keys = names[rest] * wide + rank[rest + 1]
    by_key = np.argsort(rest_keys, kind="stable")
    rest, rest_keys = rest[by_key], rest_keys[by_key]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    below = np.searchsorted(names[ones] * wide + rank[ones + 1], rest_keys)
    # Against the others two names come first; the pairs are named anew so that a key fits 64 bits.
    pair = lambda at: names[at] * top + names[at + 1]
    known, fresh = np.unique(np.concatenate([pair(twos), pair(rest)]), return_inverse=True)
    two_keys = fresh[: len(twos)] * wide + rank[twos + 2]
    pair_keys = fresh[len(twos) :] * wide + rank[rest + 2]
    below = np.maximum.accumulate(below + np.searchsorted(two_keys, pair_keys))
    out = np.empty(size, dtype=np.int64)
    slots = below + np.arange(len(rest))
    taken = np.zeros(size, dtype=bool)
    taken[slots] = True
    out[slots] = rest
    out[~taken] = sampled
    return out


def _named(values: np.ndarray) -> np.ndarray:
    """Dense names from 0 in the order of the values."""
    if len(values) and 0 <= int(values.min()) and int(values.max()) < 1 << 25:
        present = np.zeros(int(values.max()) + 1, dtype=bool)
        present[values] = True
        return (np.cumsum(present) - 1)[values]
    return np.unique(values, return_inverse=True)[1]


def repeated(texts: list[bytes], low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Per text the starts from ``low`` to ``high`` whose string is also that of another such start, of any of the texts."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    begins = np.cumsum([0, *(len(t) for t in texts)])[:-1]
    asked = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(asked, begins + low, 1)
    np.add.at(asked, begins + high + 1, -1)
    asked = np.cumsum(asked)[:-1] > 0
    order = suffix_order(data, length)
    order = order[asked[order]]
    # Neighbours that share their first ``length`` bytes, eight at a time.
    eights = np.zeros(len(data) + 8, dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)]).astype(np.uint64)
    for i in range(8):
        eights[: len(data)] |= padded[i : i + len(data)] << np.uint64(8 * i)
    pairs = np.arange(len(order) - 1)
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        pairs = pairs[eights[order[pairs] + at] == eights[order[pairs + 1] + at]]
    found = np.zeros(len(data), dtype=bool)
    found[order[pairs]] = True
    found[order[pairs + 1]] = True
    return [np.flatnonzero(found[b : b + len(t)]) for b, t in zip(begins, texts, strict=True)]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    breaks = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.append(0, breaks + 1)], starts[np.append(breaks, len(starts) - 1)]


def _sorted_cells(length: int):
    """Runs of repeated starts of each stretch. Rows come ordered by key; keys are sorted together up to ``SORTED`` bytes."""
    names = ["anchor", "digest", "from", "to"]

    def solved(cell: list[tuple]) -> pa.RecordBatch:
        each = repeated([r[3] for r in cell], np.array([r[4] for r in cell]), np.array([r[5] for r in cell]), length)
        out: list[list] = [[], [], [], []]
        for row, starts in zip(cell, each, strict=True):
            if len(starts):
                for a, b in zip(*_runs(starts), strict=True):
                    for column, value in zip(out, (row[1], row[2], int(a), int(b)), strict=True):
                        column.append(value)
        return pa.record_batch([pa.array(c, pa.int64()) for c in out], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: list[tuple] = []
        held, key = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell and row[0] != key and held >= SORTED:
                    yield solved(cell)
                    cell, held = [], 0
                key = row[0]
                cell.append(row)
                held += len(row[3])
        if cell:
            yield solved(cell)

    return run


def _halved(length: int):
    """Each half of a stretch's starts under the bytes that all its strings share; single strings too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, anchor, digest, text, low, high, place, near, far in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                # Strings that start ``near`` to ``far`` bytes before the anchor; the halves of that range are the same for all.
                middle = (near + far) // 2
                for a, b in ((near, middle), (middle + 1, far)) if near < far else ((near, far),):
                    one, other = max(low, place - b), min(high, place - a)
                    if one > other:
                        continue
                    shared = _window(text, place - a, place - b + length)
                    name = hashlib.blake2b(shared + b"%d %d %d" % (anchor, a, b), digest_size=8).digest()
                    key = int.from_bytes(name, "little", signed=True)
                    out.append((key, anchor, digest, text, one, other, place, a, b))
            if out:
                columns = [pa.array(c) for c in zip(*out, strict=True)]
                yield pa.record_batch(columns, names=_CELL_NAMES)

    return run


def _window(text: bytes, start: int, end: int) -> bytes:
    return text[max(0, start) : max(0, end)]


_CELL_NAMES = ["key", "anchor", "digest", "text", "low", "high", "place", "near", "far"]
_CELL = "key long, anchor long, digest long, text binary, low long, high long, place long, near long, far long"


def _solved(cells: DataFrame, length: int, crowd: int) -> DataFrame:
    """``anchor``, ``digest``, ``from``, ``to``: runs of repeated starts, counted from the stretch's first byte."""
    found = None
    while True:
        sizes = cells.groupBy("key").agg(F.sum(F.octet_length("text")).alias("n"))
        crowded = stored(sizes.filter(F.col("n") > crowd).select("key"), "crowded")
        some = crowded.count()
        calm = cells.join(crowded, "key", "left_anti") if some else cells
        rows = calm.select("key", "anchor", "digest", "text", "low", "high").repartition("key")
        rows = rows.sortWithinPartitions("key", "digest")
        rows = rows.mapInArrow(_sorted_cells(length), "anchor long, digest long, from long, to long")
        found = rows if found is None else found.union(rows)
        if not some:
            return found
        full = cells.join(crowded, "key", "left_semi")
        # Under a key of single strings all are equal, and there are several.
        single = full.filter("near = far").select("anchor", "digest", F.col("low").alias("from"), F.col("high").alias("to"))
        found = found.union(single)
        cells = stored(full.filter("near < far").select(_CELL_NAMES).mapInArrow(_halved(length), _CELL), "cells")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [zlib.compress(t.as_py(), 1) for t in batch.column(0)]
        yield pa.record_batch([pa.array(packed, pa.binary()), *batch.columns[1:]], names=batch.schema.names)


def _cut(length: int):
    """The asked stretches of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for packed, asked in zip(batch.column(0), batch.column(1), strict=True):
                text = zlib.decompress(packed.as_py())
                for x in asked.as_py():
                    first, last, place = x["first"], x["last"], x["place"]
                    part = text[first : last + length]
                    out.append((x["anchor"], x["anchor"], x["digest"], part, 0, last - first, place - first, 0, length))
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=_CELL_NAMES)

    return run


def _stripped(length: int):
    """Bytes, removed bytes, removed spans and hash of the rest, and the rest itself where it is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for packed, spans in zip(batch.column(1), batch.column(2), strict=True):
                text = zlib.decompress(packed.as_py())
                runs: list[list[int]] = []
                for a, b in sorted((x["from"], x["to"] + length) for x in (spans.as_py() or ())):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                out.append((len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), [x for r in runs for x in r]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            yield pa.record_batch([batch.column(0), *arrays], names=names)

    return run


def repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``k1``, ``k2``, ``from``, ``to``: per text (named as by ``text_key``) the runs of starts whose string repeats."""
    texts = documents.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), *text_key())
    shape = "k1 long, k2 long, first long, last long, place long, anchor long, digest long"
    scanned = texts.mapInArrow(_scan(length, gram), shape)
    anchors = scanned.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("digest").alias("_least"), F.max("digest").alias("_most")
    )
    anchors = anchors.filter("n > 1").select("anchor", (F.col("_least") != F.col("_most")).alias("varied"))
    # Copies of a text have the same stretches; one of each, with their number, is enough from here on.
    several = scanned.join(anchors, "anchor").groupBy("k1", "k2", "first", "last", "place", "anchor", "digest", "varied")
    several = stored(several.agg(F.count("*").alias("copies")), "stretches")
    plain = several.filter("NOT varied").select("k1", "k2", F.col("first").alias("from"), F.col("last").alias("to"))
    varied = several.filter("varied")
    # One copy of each distinct stretch, and the text it is cut from.
    one = varied.groupBy("anchor", "digest").agg(
        F.min(F.struct("k1", "k2", "first", "last", "place")).alias("at"), F.sum("copies").alias("copies")
    )
    asked = one.select("at.k1", "at.k2", F.struct("at.first", "at.last", "at.place", "anchor", "digest").alias("x"))
    asked = asked.groupBy("k1", "k2").agg(F.collect_list("x").alias("asked"))  # bounded by the text's length
    packed = texts.filter(F.octet_length("text") >= length).select("text", "k1", "k2")
    packed = packed.mapInArrow(_packed, "text binary, k1 long, k2 long")
    cells = packed.join(asked, ["k1", "k2"]).select("text", "asked").mapInArrow(_cut(length), _CELL)
    # Copies of a text give the same stretches again.
    cells = stored(cells.dropDuplicates(["anchor", "digest"]), "cells")
    # A stretch that occurs several times repeats as a whole, whatever its order among the others.
    whole = one.filter("copies > 1").select(
        "anchor", "digest", F.lit(0).cast("long").alias("from"), (F.col("at.last") - F.col("at.first")).alias("to")
    )
    solved = stored(_solved(cells, length, crowd).union(whole).distinct(), "repeats")
    found = varied.join(solved, ["anchor", "digest"]).select(
        "k1", "k2", (F.col("first") + F.col("from")).alias("from"), (F.col("first") + F.col("to")).alias("to")
    )
    return plain.union(found)


def stripped(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Per document ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``spans``, the removed runs as byte
    offsets [from, to, from, to, ..].
    """
    runs = repeats(documents, length, gram, crowd)
    spans = runs.groupBy("k1", "k2").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    texts = documents.select(
        F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *text_key()
    )
    packed = texts.mapInArrow(_packed, "text binary, doc_id long, k1 long, k2 long")
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<bigint>"
    return packed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(_stripped(length), shape)
