"""Documents packed into windows of tokens, by non-negative least squares over combinations of lengths.

1. Tokens. A document's ids are those of a public tokenizer file, then ``end``. What fills whole windows is cut off in front as
   windows of its own; the rest, shorter than a window, is what has to be packed. Rests are numbered by length: within their
   task while they are made, and over all tasks by sums of the tasks' counts, so that no rows are sorted or moved for it.
2. Combinations. All pairs and triples of lengths that fill a window exactly.
3. Counts. How often each combination is repeated is a non-negative least-squares problem against the histogram of the rests'
   lengths. Combinations of one smallest member share nothing else, so with the others held they have a closed solution up
   to one number, which is found by bisection; the blocks are swept until a sweep changes little (block coordinate descent).
4. Rounding. Counts are rounded by their running sums, which keeps their total where most are fractions, and never beyond the
   rests that there are.
5. Residuals. What is left is packed greedily: the longest rest, then the longest that fits as often as it fits, and so on; a
   gap that none fits is filled with the head of the shortest rest that is longer, whose tail is packed later. The last
   window is split into powers of two, which need no padding. So nothing is padded at all.

Steps 2 to 5 work on the histogram, which has a number per length, however many documents there are. The plan says for each
length and range of numbers where its rests go; it has a few hundred thousand entries at most for a window of 2048, grows with the
square of the window, and is sent to the tasks.

Nulls: a null or empty text is a document of the one id ``end``; a null id is carried along. Repeated rows are packed each. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import stored

WINDOW = 2048
END = 1
#: Sweeps over all blocks, at most, and the gain of a sweep below which it is the last.
SWEEPS = 25
GAIN = 0.03
#: Words whose ids a worker remembers from lately, and as many from before.
WORDS = 300_000
#: Letters of Latin-1 beyond ASCII. In texts of these and ASCII alone, composed forms are what they are, one letter has one
#: lower-case letter, and patterns with \p{L} and \p{N} can be written as character classes.
LATIN = "À-ÖØ-öø-ÿ"


@cache
def tokenizer(path: str) -> Callable[[str], bytes]:
    """From a text to its ids as little-endian unsigned 32-bit numbers.

    A tokenizer that lower-cases and parts words by a pattern, as ``word_bpe_49k.json``, encodes words apart from each other, so
    each word is encoded once and remembered, also for a worker's later tasks. Words that this isn't certain for, and whole texts
    under any other kind of tokenizer, are left to the library.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    packed = lambda ids: array("I", ids).tobytes()
    encode = lambda text: packed(whole.encode(text, add_special_tokens=False).ids)
    with open(path, encoding="utf-8") as file:
        pattern, added = _word_pattern(json.load(file))
    if pattern is None:
        return encode

    known = re.compile(f"[\\x00-\\x7f{LATIN}]*").fullmatch
    plain = re.compile("[!-~]+").fullmatch
    parts, chunks = re.compile(pattern, re.A).findall, re.compile(r"[^ \n\t\r]+").findall
    model, bytewise = whole.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    letters = f"A-Za-z{LATIN}"
    # Under this pattern a sign after a letter or a digit begins a word, whatever stands before.
    apart = re.fullmatch(r"('[a-z]+\|)*" + re.escape(rf"[{letters}]+|[0-9]|[^\s{letters}0-9]+"), pattern) is not None
    signs = frozenset(re.sub(rf"[\s{letters}0-9]", "", "".join(map(chr, range(128))), flags=re.A).encode() if apart else b"")

    class Words(dict):
        """Ids of what stands between white space: lower-case Latin-1 as bytes, or text that is left to the library."""

        before: dict[str | bytes, bytes] = {}

        def __missing__(self, chunk: str | bytes) -> bytes:
            if isinstance(chunk, bytes) and chunk[-1] in signs and len(chunk) > 1 and chunk[-2] not in signs:
                return self[chunk[:-1]] + self[chunk[-1:]]
            ids = self.before.get(chunk)
            if ids is None:
                ids = self.made(chunk)
            if len(self) >= WORDS:
                self.before = dict(self)
                self.clear()
            self[chunk] = ids
            return ids

        def made(self, chunk: str | bytes) -> bytes:
            if isinstance(chunk, str):
                return encode(chunk)
            found = parts(chunk.decode("latin-1"))
            if len(found) != 1:
                return b"".join([self[w.encode("latin-1")] for w in found])
            written = found[0] if plain(found[0]) else bytewise.pre_tokenize_str(found[0])[0][0]
            return packed([t.id for t in model.tokenize(written)])

    get = Words().__getitem__

    def run(text: str) -> bytes:
        if any(a in text for a in added):
            return encode(text)
        # No word reaches over white space, so a piece between white space is encoded like a text of its own. Bytes are parted
        # at the white space of ASCII alone, as words are.
        if known(text):
            return b"".join(map(get, text.lower().encode("latin-1").split()))
        found: list[str | bytes] = []
        for chunk in chunks(text):
            if known(chunk):
                found += chunk.lower().encode("latin-1").split()
            else:
                found.append(chunk)
        return b"".join(map(get, found))

    return run


def _word_pattern(file: dict) -> tuple[str | None, list[str]]:
    """The pattern of words with character classes for its Unicode classes, if the tokenizer is of the kind; added tokens."""
    steps = [n.get("type") for n in (file.get("normalizer") or {}).get("normalizers", [])]
    before = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    kinds = [p.get("type") for p in before]
    if steps != ["NFC", "Replace", "Lowercase"] or kinds != ["Split", "ByteLevel"] or file.get("post_processor"):
        return None, []
    split = before[0]
    pattern = split["pattern"].get("Regex")
    if pattern is None or not split["invert"] or split["behavior"] != "Removed" or before[1]["add_prefix_space"]:
        return None, []
    if r"\s" not in pattern or re.search(r"\\[^psdw]|\\p\{(?![LN]\})|\\[dw]", pattern):
        return None, []
    written = pattern.replace(r"\p{L}", f"A-Za-z{LATIN}").replace(r"\p{N}", "0-9")
    return written, [a["content"] for a in file.get("added_tokens", [])]


@dataclass
class Plan:
    """Where rests go. A rest is known by its place: the number of shorter rests plus its number among its length."""

    #: Before the rests of a length, those of shorter ones.
    base: np.ndarray
    #: First place of each range, and where its entries begin; an entry is a piece of every rest in the range.
    places: np.ndarray
    begins: np.ndarray
    #: Per entry: piece's start and length in the rest, place of item 0, items per sequence, sequence and offset of item 0.
    entries: np.ndarray
    sequences: int


def combinations(window: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """By smallest member c (0: none) the pairs a <= b of the others, c + a + b = window."""
    found = []
    for c in range(window // 3 + 1):
        a = np.arange(max(c, 1), (window - c) // 2 + 1)
        if len(a):
            found.append((c, a, window - c - a))
    return found


def repeats(histogram: np.ndarray, window: int, sweeps: int = SWEEPS) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Combinations as ``combinations`` gives them with the counts, as fractions, that come nearest to the histogram."""
    left = histogram.astype(float)
    blocks = []
    for c, a, b in combinations(window):
        same, on_a, on_b = a == b, (a != c) | (c == 0), (b != c) | (c == 0)
        own = (1 + (a == c) + ((a == c) & (b == c))) * 1.0 if c else np.zeros(len(a))
        # A length that a combination holds twice weighs twice; the smallest member is shared and handled apart.
        twice = np.where(same, 2.0, 1.0)
        size = np.where(same, 4.0, on_a + on_b * 1.0) * (on_a | on_b)
        blocks.append((c, a, b, same, on_a, on_b, own, twice, size, np.zeros(len(a))))
    last = float(left @ left)
    for _ in range(sweeps):
        for c, a, b, same, on_a, on_b, own, twice, size, x in blocks:
            if not (x.any() or (left[a] > 0).any()):
                continue
            pull = on_a * (left[a] + twice * x) + (on_b & ~same) * (left[b] + x)
            pull = np.where(same & on_a, 2 * (left[a] + 2 * x), pull)
            free = size > 0
            if c:
                level = left[c] + float(own @ x)
                x_new = _shared(level, pull, own, size, free)
            else:
                x_new = np.maximum(0, pull / size)
            change = x - x_new
            np.add.at(left, a[on_a], (twice * change)[on_a])
            np.add.at(left, b[on_b & ~same], change[on_b & ~same])
            if c:
                left[c] += float(own @ change)
            x[:] = x_new
        now = float(left @ left)
        if last - now <= GAIN * last:
            break
        last = now
    return [(c, a, b, x) for c, a, b, *_, x in blocks]


def _shared(level: float, pull: np.ndarray, own: np.ndarray, size: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Counts of a block: x = max(0, (pull + own * rest) / size) where ``rest`` is what they leave of the shared length."""
    pull, weight, size = pull[free], own[free], size[free]
    counts = lambda rest: np.maximum(0, (pull + weight * rest) / size)
    low, high = -1.0 - abs(level) - float(np.abs(pull).max(initial=0)), level
    for _ in range(40):
        middle = (low + high) / 2
        if middle + float(weight @ counts(middle)) < level:
            low = middle
        else:
            high = middle
    x = np.zeros(len(free))
    x[free] = counts(low)
    if not free.all():
        # The window is three times the shared length: a combination of nothing else.
        x[~free] = max(0.0, level - float(weight @ x[free])) / own[~free]
    return x


class _Pool:
    """Rests and their tails by length, as ranges of places."""

    def __init__(self, base: np.ndarray, counts: np.ndarray):
        self.counts = counts.astype(np.int64).copy()
        #: place of the first, number, start within the rest
        self.ranges = [[(int(base[n]), int(k), 0)] if k else [] for n, k in enumerate(counts)]
        self.found: list[tuple[int, ...]] = []

    def take(self, length: int, number: int) -> list[tuple[int, int, int]]:
        self.counts[length] -= number
        taken, ranges = [], self.ranges[length]
        while number:
            place, count, start = ranges.pop()
            if count > number:
                ranges.append((place + number, count - number, start))
                count = number
            taken.append((place, count, start))
            number -= count
        return taken

    def give(self, length: int, place: int, count: int, start: int) -> None:
        self.counts[length] += count
        self.ranges[length].append((place, count, start))

    def put(self, taken: list[tuple[int, int, int]], length: int, each: int, sequence: int, offset: int) -> None:
        """Pieces of ``length`` into sequences from ``sequence`` on, ``each`` of them side by side from ``offset``."""
        item = 0
        for place, count, start in taken:
            self.found.append((place, count, start, length, place - item, each, sequence, offset))
            item += count


def planned(histogram: np.ndarray, window: int) -> Plan:
    """Where the rests go, from the number of rests of each length from 0 (none) to ``window`` - 1."""
    counts = histogram.astype(np.int64).copy()
    counts[0] = 0
    base = np.concatenate([[0], np.cumsum(counts)])
    pool, sequences = _Pool(base, counts), 0
    if counts.any():
        sequences = _combined(pool, repeats(counts, window))
        sequences = _greedy(pool, window, sequences)
    found = np.array(pool.found, dtype=np.int64).reshape(-1, 8)
    bounds = np.unique(np.concatenate([found[:, 0], found[:, 0] + found[:, 1]]))
    first = np.searchsorted(bounds, found[:, 0])
    reach = np.searchsorted(bounds, found[:, 0] + found[:, 1]) - first
    entry = np.repeat(np.arange(len(found)), reach)
    spot = np.arange(len(entry)) - np.repeat(np.cumsum(reach) - reach, reach) + first[entry]
    order = np.lexsort((found[entry, 2], spot))
    begins = np.searchsorted(spot[order], np.arange(len(bounds)))
    return Plan(base, bounds, begins, found[entry[order], 2:], sequences)


def _combined(pool: _Pool, blocks: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> int:
    """Repeat combinations as often as their counts say, rounded, and as the rests last; the number of sequences."""
    made, total = 0, 0.0
    for c, a, b, x in blocks:
        ends = np.floor(total + np.cumsum(x) + 0.5).astype(np.int64)
        wanted = np.diff(ends, prepend=int(np.floor(total + 0.5)))
        total += float(x.sum())
        for k in np.flatnonzero(wanted).tolist():
            uses: dict[int, int] = {}
            for length in (c, int(a[k]), int(b[k])):
                if length:
                    uses[length] = uses.get(length, 0) + 1
            number = min(int(wanted[k]), *(int(pool.counts[n]) // m for n, m in uses.items()))
            if number:
                offset = 0
                for length, each in uses.items():
                    pool.put(pool.take(length, number * each), length, each, made, offset)
                    offset += length * each
                made += number
    return made


def _greedy(pool: _Pool, window: int, made: int) -> int:
    """Pack what is left; the number of sequences with those ``made`` before."""
    while pool.counts.any():
        left = pool.counts.copy()
        uses: list[tuple[int, int]] = []
        gap = window
        while gap:
            fitting = np.flatnonzero(left[: gap + 1])
            if not len(fitting):
                break
            length = int(fitting[-1])
            each = min(gap // length, int(left[length]))
            uses.append((length, each))
            left[length] -= each
            gap -= each * length
        longer = np.flatnonzero(left)
        if gap and not len(longer):
            return _split(pool, uses, made)
        need = dict(uses)
        cut = int(longer[0]) if gap else 0
        if gap:
            need[cut] = need.get(cut, 0) + 1
        number = min(int(pool.counts[n]) // m for n, m in need.items())
        offset = 0
        for length, each in uses:
            pool.put(pool.take(length, number * each), length, each, made, offset)
            offset += length * each
        if gap:
            taken = pool.take(cut, number)
            pool.put(taken, gap, 1, made, offset)
            for place, count, start in taken:
                pool.give(cut - gap, place, count, start + gap)
        made += number
    return made


def _split(pool: _Pool, uses: list[tuple[int, int]], made: int) -> int:
    """The last rests, fewer tokens than a window, into sequences of different powers of two."""
    total = sum(length * each for length, each in uses)
    sizes = [1 << bit for bit in reversed(range(total.bit_length())) if total >> bit & 1]
    offset = 0
    for length, each in uses:
        for place, count, start in pool.take(length, each):
            for one in range(place, place + count):
                at = 0
                while at < length:
                    part = min(length - at, sizes[0] - offset)
                    pool.put([(one, 1, start + at)], part, 1, made, offset)
                    at, offset = at + part, offset + part
                    if offset == sizes[0]:
                        del sizes[0]
                        made, offset = made + 1, 0
    return made


TOKENS = "doc_id long, ids binary, tokens long, windows long, rest long, part long, place long, earlier long"


def _tokenised(path: str, window: int, end: int):
    """Ids, how many, whole windows and rest; the task, the number of the rest in it among its length, whole windows before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, last = tokenizer(path), array("I", [end]).tobytes()
        part, seen, earlier = TaskContext.get().partitionId(), [0] * window, 0
        names = ["doc_id", "ids", "tokens", "windows", "rest", "part", "place", "earlier"]
        for batch in batches:
            ids, columns = [], [[] for _ in range(6)]
            for text in batch.column(1):
                ids.append((ids_of(text.as_py() or "")) + last)
                tokens = len(ids[-1]) // 4
                windows, rest = divmod(tokens, window)
                for column, value in zip(columns, (tokens, windows, rest, part, seen[rest], earlier), strict=True):
                    column.append(value)
                seen[rest] += 1
                earlier += windows
            numbers = [pa.array(c, pa.int64()) for c in columns]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary()), *numbers], names=names)

    return run


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _cut(plan: Plan, window: int):
    """The pieces of each document: its whole windows, then those of its rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            number = lambda name: batch.column(names.index(name)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            tokens, windows, rest, place, earlier = map(number, ("tokens", "windows", "rest", "place", "earlier"))
            # Whole windows, numbered after the sequences of the plan.
            row_w = np.repeat(np.arange(len(tokens)), windows)
            nth = np.arange(len(row_w)) - np.repeat(np.cumsum(windows) - windows, windows)
            start_w, sequence_w = nth * window, plan.sequences + earlier[row_w] + nth
            # Rests: the range that holds the place, and all of its entries.
            some = np.flatnonzero(rest)
            spot = plan.base[rest[some]] + place[some]
            at = np.searchsorted(plan.places, spot, side="right") - 1
            ends = np.append(plan.begins, len(plan.entries))
            each = ends[at + 1] - plan.begins[at]
            row_r, spot = np.repeat(some, each), np.repeat(spot, each)
            nth = np.arange(len(row_r)) - np.repeat(np.cumsum(each) - each, each)
            entry = plan.entries[np.repeat(plan.begins[at], each) + nth]
            start, length, zero, side, sequence, offset = entry.T
            item = spot - zero
            rows = np.concatenate([row_w, row_r])
            starts = np.concatenate([start_w, windows[row_r] * window + start])
            lengths = np.concatenate([np.full(len(row_w), window), length])
            sequences = np.concatenate([sequence_w, sequence + item // side])
            offsets = np.concatenate([np.zeros(len(row_w), dtype=np.int64), offset + item % side * length])
            held = batch.column(names.index("ids"))
            order = np.lexsort((starts, rows))
            texts, before, whole = [], -1, b""
            for r, s, n in zip(rows[order].tolist(), starts[order].tolist(), lengths[order].tolist(), strict=True):
                if r != before:
                    before, whole = r, held[r].as_py()
                texts.append(whole[4 * s : 4 * (s + n)])
            docs = batch.column(names.index("doc_id")).take(pa.array(rows[order]))
            numbers = [pa.array(c[order], pa.int64()) for c in (tokens[rows], sequences, offsets)]
            columns = [docs, *(pa.array(c[order], pa.int64()) for c in (starts, lengths)), pa.array(texts, pa.binary()), *numbers]
            yield pa.record_batch(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def packed(documents: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """A row per piece: ``doc_id``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``,
    ``offset``. Pieces of a sequence lie side by side from offset 0; a sequence holds ``window`` ids or a smaller power of two.
    """
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(narrow.mapInArrow(_tokenised(path, window, end), TOKENS), "tokens")
    counts = rows.groupBy("part", "rest").agg(F.count("*").alias("rests"), F.sum("windows").alias("windows"))
    # A row per task and length: sums over the tasks before give each its first numbers.
    counts = stored(counts, "lengths")
    histogram = np.zeros(window, dtype=np.int64)
    for r in counts.groupBy("rest").agg(F.sum("rests").alias("n")).collect():  # a row per length
        histogram[r["rest"]] = r["n"]
    plan = planned(histogram, window)
    before = W.partitionBy("rest").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("part", "rest", F.coalesce(F.sum("rests").over(before), F.lit(0)).alias("_first"))
    tasks = counts.groupBy("part").agg(F.sum("windows").alias("windows"))
    # A row per task, one narrow sort.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    tasks = tasks.select("part", F.coalesce(F.sum("windows").over(before), F.lit(0)).alias("_earlier"))
    offsets = first.join(tasks, "part")
    placed = rows.join(offsets, ["part", "rest"]).select(
        "doc_id", "ids", "tokens", "windows", "rest",
        (F.col("place") + F.col("_first")).alias("place"), (F.col("earlier") + F.col("_earlier")).alias("earlier"),
    )
    return placed.mapInArrow(_cut(plan, window), PIECES)
