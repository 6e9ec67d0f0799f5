"""The mix against plain Python: targets by repeated sharing, seats one by one, blocks of a listed stream."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from sitesieve.llm import mixing as mx

BLOCK = 4


def plain(rows, block=BLOCK, seed=mx.SEED, shards=mx.SHARDS):
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(w for w, r in zip(words, rows) if r[2] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    left, target, open_ = Fraction(3 * sum(size.values()), 2), {}, set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * size[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: Fraction(2 * size[s]) for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    seats = int(float(sum(target.values())) / block + 0.5)
    quota = Counter()
    for _ in range(seats):
        best = max((s for s in sources if target[s]), key=lambda s: (target[s] / (2 * quota[s] + 1), -sources.index(s)))
        quota[best] += 1
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    taken = defaultdict(int)
    for s in sources:
        place, equal = {}, Counter()
        for i, r in enumerate(rows):
            if r[2] == s:
                place[i] = md5(f"{seed}:{'null' if r[0] is None else r[0]}:{md5(r[1] or '')}:{equal[r]}")
                equal[r] += 1
        mine = sorted(place, key=place.get)
        stream = [i for i in mine for _ in range(words[i])]
        blocks = [stream[k : k + block] for k in range(0, len(stream), block)]
        if not blocks:
            continue
        passes, rest = divmod(min(quota[s], 2 * len(blocks)), len(blocks))
        start = int(md5(f"{seed}/{s or ''}")[:8], 16) % len(blocks)
        for k in range(shards):
            edge, end = k * len(blocks) // shards, (k + 1) * len(blocks) // shards
            extra, length = end * rest // len(blocks) - edge * rest // len(blocks), end - edge
            for b in range(length):
                turn = start % length
                more = (b + 1 + turn) * extra // length - (b + turn) * extra // length
                for i in blocks[edge + b]:
                    taken[i] += passes + more
    return sorted(
        (str(r[0]), words[i], size[r[2]], round(float(target[r[2]]), 6), taken[i]) for i, r in enumerate(rows)
    )


ROWS = [
    *((i, " ".join(["wörd"] * (i * 7 % 23)), "abcde"[i % 5]) for i in range(60)),
    *((100 + i, "x\x0by z\u00a0w", "hot") for i in range(90)),
    (200, None, "a"), (201, "", None), (202, "some words here", None), (203, " ", "only spaces"),
    (204, "twice twice", "b"), (204, "twice twice", "b"), (204, "other", "b"), (None, "no id at all", "c"),
    *[(None, "again and again", "d")] * 8,
]


@pytest.mark.parametrize("shards", [1, 5, mx.SHARDS])
def test_equals_plain(documents, monkeypatch, shards):
    monkeypatch.setattr(mx, "BUCKET_ROWS", 20)
    monkeypatch.setattr(mx, "COPIES", 3)
    found = mx.mixed(documents([(i, t, s) for i, t, s in ROWS], extra=True), block=BLOCK, shards=shards).collect()
    got = [(str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in found]
    assert sorted(got) == plain(ROWS, shards=shards)
    assert all(r["taken"] <= 2 * r["size"] for r in found)


def test_documents_hold_the_words_taken(documents):
    frame = documents([(i, t, s) for i, t, s in ROWS], extra=True)
    out = mx.mixed_documents(frame, block=BLOCK)
    assert out.columns == frame.columns
    words = defaultdict(int)
    texts = {(r["doc_id"], r["text"]) for r in frame.collect()}
    whole = 0
    for r in out.collect():
        words[str(r["doc_id"])] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        assert r["n_chars"] == len(r["text"])
        whole += (r["doc_id"], r["text"]) in texts
    expected = defaultdict(int)
    for doc_id, *_, taken in plain(ROWS):
        expected[doc_id] += taken
    assert words == {k: v for k, v in expected.items() if v}
    assert whole


def test_quotas_per_shard(spark):
    rows = [("a", 10, 10), ("b", 5, 7), ("c", 9, 0), (None, 2, 3), ("d", 1000, 1999), ("e", 7, 14), ("none", 0, 0)]
    found = mx.quotas(spark.createDataFrame(rows, "source string, blocks long, quota long"), 4).collect()
    for source, blocks, quota in rows[:-1]:
        each = [r for r in found if r["source"] == source]
        assert sorted(r["shard"] for r in each) == [0, 1, 2, 3]
        assert sum(r["quota"] for r in each) == quota and sum(r["blocks"] for r in each) == blocks
        assert all(abs(r["quota"] - quota * r["blocks"] / blocks) < 1 and r["quota"] <= 2 * r["blocks"] for r in each)
    assert not [r for r in found if r["source"] == "none"]


def test_the_selection_fills_the_quotas(spark, documents):
    """One word a document and a block a word: what is taken of a shard's stretch is the shard's quota."""
    frame = documents([(i, "w", "ab"[i % 3 == 0]) for i in range(200)])
    rows = mx.mixed(frame, block=1, shards=7).collect()
    for source in "ab":
        mine = sorted((r["offset"], r["taken"]) for r in rows if r["source"] == source)
        quota, n = sum(t for _, t in mine), len(mine)
        parts = mx.quotas(spark.createDataFrame([(source, n, quota)], "source string, blocks long, quota long"), 7).collect()
        for r in parts:
            first, last = r["shard"] * n // 7, (r["shard"] + 1) * n // 7
            assert sum(t for _, t in mine[first:last]) == r["quota"]


def test_hot_rows_without_id_span_buckets(documents, monkeypatch):
    """Nine in ten rows have no id and one text: all buckets get rows, and the words taken are the quota's."""
    monkeypatch.setattr(mx, "COPIES", 50)
    rows = [(None, "one hot text", "s")] * 900 + [(i, f"text {i}", "s") for i in range(100)]
    counted = mx.sized(documents(rows))
    placed = mx.ordered(counted).collect()
    assert counted.count() == 101 and len(placed) == 1000 and len({r["_order"] for r in placed}) == 1000
    assert len({r["_order"][0] for r in placed if r["doc_id"] is None}) == 16
    got = mx.mixed(documents(rows), block=BLOCK).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in got) == [(i, t) for i, *_, t in plain(rows)]


def test_empty_table(documents):
    assert mx.mixed(documents([])).count() == 0
    assert mx.mixed_documents(documents([])).count() == 0


@pytest.mark.parametrize("text", [None, "", " "])
def test_no_words_at_all(documents, text):
    assert [r["taken"] for r in mx.mixed(documents([(1, text), (2, text)])).collect()] == [0, 0]
