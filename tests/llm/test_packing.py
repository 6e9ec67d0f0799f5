"""Pieces put together again, sequences without gaps or padding, and counts that come near the histogram."""

import random
from collections import Counter

import numpy as np
import pytest

from sitesieve.llm import packing as pk

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def check(rows, texts, window, end=1):
    """``texts``: (doc_id, text) with different ids."""
    whole = tokenizers.Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {i for i, _ in texts}
    for i, text in texts:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, end]
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert {r["doc_tokens"] for r in pieces} == {len(ids)}
        assert [r["start"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1]]
        assert b"".join(bytes(r["ids"]) for r in pieces) == np.array(ids, dtype="<u4").tobytes()
        assert all(len(r["ids"]) == 4 * r["length"] > 0 for r in pieces)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == window or (at < window and at & (at - 1) == 0)
    sizes = Counter(sum(r["length"] for r in p) for p in by_sequence.values())
    assert all(n == 1 for s, n in sizes.items() if s != window)  # only the last window is split
    assert sorted(by_sequence) == list(range(len(by_sequence)))


@pytest.mark.parametrize("window", [2, 3, 7, 64, 2048])
def test_round_trip(spark, documents, window):
    rng = random.Random(window)
    words = ["the", "of", "Été", "naïve", "don't", "x9", "ß", "日本", "é", "H̱", "<|endoftext|>", "a\x0bb", "…,", "--"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(300)]
    texts += [(1000, None), (1001, ""), (1002, " \n "), (1003, "the " * 5000), (1004, "x" * 3000)]
    texts += [(2000 + i, "one text many times over") for i in range(200)]
    frame = documents(texts, extra=True).repartition(9)
    check(pk.packed(frame, PATH, window).collect(), texts, window)


def test_odd_tables(spark, documents):
    assert pk.packed(documents([]), PATH).collect() == []
    rows = pk.packed(documents([(None, "a"), (None, "a"), (3, None)]), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in rows if r["start"] == 0) == [(0, 2), (0, 2), (3, 1)]
    assert sum(r["length"] for r in rows) == 5


def test_whole_texts_under_other_tokenizers(spark, documents):
    path = public.path("byte_bpe_50k.json")
    text = "Some text,  with  spaces\nand lines"
    rows = pk.packed(documents([(1, text)]), path, window=1 << 10, end=0).collect()
    ids = tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    joined = b"".join(bytes(r["ids"]) for r in sorted(rows, key=lambda r: r["start"]))
    assert joined == np.array([*ids, 0], dtype="<u4").tobytes()


def pieces_of(plan, histogram, window):
    """Every rest's pieces under a plan, as (sequence, offset, length, length of the rest, start)."""
    ends = np.append(plan.begins, len(plan.entries))
    for rest, count in enumerate(histogram):
        for number in range(count if rest else 0):
            spot = plan.base[rest] + number
            at = int(np.searchsorted(plan.places, spot, side="right")) - 1
            for start, length, zero, side, sequence, offset in plan.entries[plan.begins[at] : ends[at + 1]].tolist():
                item = spot - zero
                yield sequence + item // side, offset + item % side * length, length, rest, start


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    window = int(rng.integers(2, 80))
    histogram = rng.integers(0, [2, 40][seed % 2], window)
    if seed % 3 == 0:
        histogram[int(rng.integers(0, window))] = 500  # a third of all rests of one length
    plan = pk.planned(histogram, window)
    sequences, rests = {}, Counter()
    for sequence, offset, length, rest, start in pieces_of(plan, histogram, window):
        sequences.setdefault(sequence, []).append((offset, length))
        rests[rest] += length
        assert 0 <= start < start + length <= rest
    assert all(rests[n] == n * c for n, c in enumerate(histogram) if n)
    assert sorted(sequences) == list(range(plan.sequences))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0


def test_counts_solve_the_least_squares():
    """Against projected gradient steps on the written-out matrix."""
    rng = np.random.default_rng(2)
    window = 18
    histogram = rng.integers(0, 30, window)
    histogram[0] = 0
    columns, blocks = [], pk.repeats(histogram, window, sweeps=4000)
    for c, a, b, _ in blocks:
        for i, j in zip(a, b, strict=True):
            column = np.zeros(window)
            for length in (c, i, j):
                if length:
                    column[length] += 1
            assert column @ np.arange(window) == window
            columns.append(column)
    matrix = np.array(columns).T
    assert len({tuple(c) for c in columns}) == len(columns)
    x = np.zeros(len(columns))
    step = 1 / np.linalg.norm(matrix, 2) ** 2
    for _ in range(200_000):
        x = np.maximum(0, x - step * (matrix.T @ (matrix @ x - histogram)))
    best = np.linalg.norm(matrix @ x - histogram)
    found = np.concatenate([x for *_, x in blocks])
    assert (found >= 0).all()
    # A sweep that gains little is the last, so the sum of squares is met within some per cent.
    assert np.linalg.norm(matrix @ found - histogram) <= 1.1 * best + 0.5


def test_most_rests_stay_whole():
    """With enough rests of every length, nearly all are packed by combinations, without a cut."""
    rng = np.random.default_rng(3)
    window = 64
    histogram = np.bincount(np.minimum(rng.geometric(1 / 16, 200_000), window - 1), minlength=window)
    plan = pk.planned(histogram, window)
    assert len(plan.entries) < 5000
    cut = sum(1 for *_, length, rest, _ in pieces_of(plan, histogram // 100, window) if length < rest)
    assert cut < 0.1 * (histogram // 100).sum()


def test_remembered_words(monkeypatch):
    """A worker's tasks share what was encoded; ids are the library's, also where few words are remembered."""
    whole, rng = tokenizers.Tokenizer.from_file(PATH), random.Random(5)
    assert pk.tokenizer(PATH) is pk.tokenizer(PATH)
    some = ["the", "Don't", "'S", "naïve", "É́", "x\x1cy", "日本", "<|endoftext|>", "9", "word.", "(a)", "it's,", "…", " ", "\n", "\x0b", "\xa0", "-", "'"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(30))) for _ in range(1500)]
    for words in (pk.WORDS, 20):
        monkeypatch.setattr(pk, "WORDS", words)
        pk.tokenizer.cache_clear()
        ids_of = pk.tokenizer(PATH)
        for text in texts:
            assert ids_of(text) == np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    pk.tokenizer.cache_clear()
