"""SimHash near-duplicates through multi-index hashing.

A document's fingerprint has a bit set if the bit is set in over half of the hashes of its word shingles. Fingerprints link at
``bits`` or fewer differing bits; documents of one component are one class.

Equal fingerprints are one node, however many documents have them. A fingerprint is cut into ``bits // 2 + 1`` segments, so
two linked fingerprints differ in at most one bit of some segment. Each is filed under its segments' values and under all
values with one set bit turned off: if segments differ in one bit, one of the two has it set. Fingerprints filed under the
same value are candidates, and complete distances decide.

A value's candidates are compared in one task. Where they are more than ``CROWD``, they also agree in one of ``bits + 1``
parts of the other bits, so they are filed again under those parts, until no value is crowded. Within a value only a spanning
forest of its links is kept, which has the same components as all links.

Nulls: a null text has no words and the fingerprint zero, like an empty one, and links like any other; a null ``doc_id`` never
names a class unless it is all its class has. Repeated rows are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from .components import components
from .keys import boxed, text_key

SHINGLE = 3
BITS = 3
SEED = 42
#: Candidates of one value that one task compares.
CROWD = 1 << 13
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16
#: Values with so few candidates are compared all at once, the others one by one.
FEW = 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only ASCII spaces part words
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    one = xxhash.xxh64_intdigest
    width = min(shingle, len(words))
    hashes = np.array([one(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :])], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``k1``, ``k2`` (the text's name) and ``fp``, the fingerprint as a signed number, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], dtype=np.uint64)
            columns = [batch.column(0), *batch.columns[2:], pa.array(found.view(np.int64))]
            yield pa.record_batch(columns, names=["doc_id", "k1", "k2", "fp"])

    narrow = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *text_key()
    )
    return narrow.mapInArrow(run, "doc_id long, k1 long, k2 long, fp long")


def _filed(nodes: DataFrame, bits: int) -> DataFrame:
    """``key``, ``fp`` and ``fixed``, the bits that all fingerprints under the key have looked at."""
    number = bits // 2 + 1
    cuts = [64 * i // number for i in range(number + 1)]
    filed = None
    for k in range(number):
        low, width = cuts[k], cuts[k + 1] - cuts[k]
        mask = ((1 << width) - 1) << low
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        part = nodes.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(width - 1))).alias("i"))
        flip = F.when(F.col("i") < 0, F.lit(0).cast("long")).otherwise(
            F.expr(f"shiftleft(1L, greatest(i, 0) + {low})")
        )
        part = part.withColumn("flip", flip).filter("i < 0 OR (fp & flip) != 0")
        value = F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(F.lit(mask).cast("long"))
        part = part.select(F.xxhash64(F.lit(k), value).alias("key"), "fp", F.lit(mask).cast("long").alias("fixed"))
        filed = part if filed is None else filed.union(part)
    return filed


def _refile(bits: int):
    """Files crowded fingerprints again, under each of ``bits + 1`` parts of the bits not looked at yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            key, fp, fixed = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
            for seen in np.unique(fixed):
                rows = fixed == seen
                free = [i for i in range(64) if not int(seen) >> i & 1]
                for part in np.array_split(free, bits + 1):
                    mask = np.uint64(sum(1 << int(i) for i in part))
                    new = (key[rows] ^ (mask * mix)) * mix + ((fp[rows] & mask) ^ (mask >> np.uint64(7))) * np.uint64(
                        0xBF58476D1CE4E5B9
                    )
                    new = (new ^ (new >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                    columns = (new, fp[rows], np.full(len(new), seen | mask, dtype=np.uint64))
                    yield pa.record_batch([pa.array(c.view(np.int64)) for c in columns], names=["key", "fp", "fixed"])

    return run


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def _forest(fps: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of the links among ``fps``."""
    left, right = [], []
    rest = np.unique(fps)
    queue: list[np.uint64] = []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        node = queue.pop()
        near = _near(rest, node, bits)
        if near.any():
            found = rest[near]
            left.append(np.full(len(found), node, dtype=np.uint64))
            right.append(found)
            queue.extend(found)
            rest = rest[~near]
    return left, right


def _linked(bits: int):
    """Edges among the fingerprints under each key. Rows come ordered by key."""

    def edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=int)
        sizes = np.diff(np.append(starts, len(key)))
        size = np.repeat(sizes, sizes)
        left, right = [], []
        few = np.flatnonzero((size > 1) & (size <= FEW))
        for lag in range(1, FEW):
            at = few[few + lag < len(key)]
            at = at[key[at] == key[at + lag]]
            if not len(at):
                break
            at = at[(fp[at] != fp[at + lag]) & _near(fp[at], fp[at + lag], bits)]
            left.append(fp[at])
            right.append(fp[at + lag])
        for k in np.flatnonzero(sizes > FEW):
            more = _forest(fp[starts[k] : starts[k] + sizes[k]], bits)
            left += more[0]
            right += more[1]
        none = [np.zeros(0, dtype=np.uint64)]
        columns = [np.concatenate(left or none), np.concatenate(right or none)]
        return pa.record_batch([pa.array(c.view(np.int64)) for c in columns], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy().view(np.uint64)])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            if not len(key):
                continue
            # The last key may go on in the next batch.
            other = np.flatnonzero(key != key[-1])
            whole = int(other[-1]) + 1 if len(other) else 0
            if whole:
                yield edges(key[:whole], fp[:whole])
                key, fp = key[whole:], fp[whole:]
        if len(key):
            yield edges(key, fp)

    return run


def links(nodes: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """Edges ``a``, ``b`` whose components are those of all pairs of ``nodes.fp`` within ``bits`` bits."""
    filed = stored(_filed(nodes, bits), "filed")
    found = None
    while True:
        counts = filed.groupBy("key").agg(F.count("*").alias("n"))
        crowded = stored(counts.filter(F.col("n") > crowd).select("key"), "crowded")
        some = crowded.count()
        calm = filed.join(crowded, "key", "left_anti") if some else filed
        edges = calm.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
        edges = edges.mapInArrow(_linked(bits), "a long, b long")
        found = edges if found is None else found.union(edges)
        if not some:
            return found
        again = filed.join(crowded, "key", "left_semi").select("key", "fp", "fixed")
        filed = stored(again.mapInArrow(_refile(bits), "key long, fp long, fixed long"), "filed")


def near_duplicates(
    documents: DataFrame, shingle: int = SHINGLE, bits: int = BITS, seed: int = SEED, crowd: int = CROWD
) -> DataFrame:
    """``doc_id``, ``k1``, ``k2``, ``fp``, ``root`` and ``component_id`` of every document: the smallest fingerprint and the
    smallest ``doc_id`` of its class.
    """
    prints = stored(fingerprints(documents, shingle, seed), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes.select("fp"), bits, crowd))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left")
    rooted = stored(rooted.select("fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "root", "component_id")
    return prints.join(classes, "fp").select("doc_id", "k1", "k2", "fp", "root", "component_id")


def one_of_each(documents: DataFrame, shingle: int = SHINGLE, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """``documents`` with one row of each class: that of the smallest ``doc_id`` (null last), then of the smallest text name."""
    found = near_duplicates(documents, shingle, bits, seed)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "k1", "k2")).alias("at")
    kept = found.groupBy("root").agg(first).select(F.col("at.doc_id").alias("_id"), "at.k1", "at.k2")
    k1, k2 = text_key()
    keyed = boxed(documents, k1.alias("_k1"), k2.alias("_k2"), F.col("doc_id").cast("long").alias("doc_id"))
    same = (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    # Repeated rows of one document and text.
    return keyed.join(kept, same, "left_semi").dropDuplicates(["_k1", "_k2", "doc_id"]).select("row.*")
