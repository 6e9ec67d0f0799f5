"""Differencing against its definition, and the properties of the shards."""

import random
import zlib
from collections import defaultdict

import pytest

from sitesieve.llm import sharding as sh


def plain_difference(sizes, shards):
    """Sums per shard after combining the two partial partitions of the largest spread, the slow way."""
    parts = [(i, [s] + [0] * (shards - 1)) for i, s in enumerate(sizes)]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (min(p[1]) - max(p[1]), p[0]))
        (_, a), (_, b) = parts[:2]
        both = sorted((x + y for x, y in zip(sorted(a, reverse=True), sorted(b))), reverse=True)
        parts = parts[2:] + [(made, [x - both[-1] for x in both])]
        made += 1
    return sorted(x - min(parts[0][1]) for x in parts[0][1])


@pytest.mark.parametrize("shards", [2, 3, 7])
def test_difference(shards):
    rng = random.Random(shards)
    for n in (0, 1, 2, 5, 30):
        sizes = sorted((rng.randint(1, 1000) for _ in range(n)), reverse=True)
        placed = sh.difference(sizes, shards)
        sums = [sum(s for s, p in zip(sizes, placed) if p == k) for k in range(shards)]
        assert len(placed) == n
        if n:
            assert sorted(x - min(sums) for x in sums) == plain_difference(sizes, shards)


def test_shards(documents, monkeypatch):
    monkeypatch.setattr(sh, "UNIT_ROWS", 10)
    rng = random.Random(1)
    rows = [(i, "t" * rng.randint(0, 400) + str(i % 150)) for i in range(300)]
    rows += [(1000 + i, "one hot text") for i in range(60)] + [(5000, None), (5001, ""), (None, "x"), (None, "x"), (3, "3é")]
    found = sh.shards_by_bytes(documents(rows, extra=True), shards=5, bundles=16).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == sorted(
        (str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots, sums, of_text = defaultdict(list), defaultdict(int), defaultdict(set)
    texts = {i: t or "" for i, t in rows}
    for r in found:
        slots[r["shard"]].append(r["slot"])
        sums[r["shard"]] += r["size"]
        if r["doc_id"] not in (None, 3):
            of_text[texts[r["doc_id"]]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    assert set(sums) == set(range(5)) and max(sums.values()) - min(sums.values()) <= 0.02 * max(sums.values())


def test_rows_without_id_are_numbered_in_many_units(documents, monkeypatch):
    """Nine in ten rows have no id and one text; their slots have no gap, and reruns give the same rows."""
    monkeypatch.setattr(sh, "UNIT_ROWS", 20)
    monkeypatch.setattr(sh, "COPIES", 50)
    frame = documents([(None, "one hot text")] * 900 + [(i, f"text {i}") for i in range(100)])
    runs = [sorted(map(str, sh.shards_by_bytes(frame, shards=3, bundles=8).collect())) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 1000
    slots = defaultdict(list)
    for r in sh.shards_by_bytes(frame, shards=3, bundles=8).collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_table(documents):
    assert sh.shards_by_bytes(documents([])).count() == 0
