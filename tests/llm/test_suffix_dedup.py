"""Repeated passages against a brute-force search for repeated strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sitesieve.llm import suffix_dedup as sd


def brute(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int(((gone[1:] != gone[:-1]) & gone[1:]).sum() + bool(len(gone) and gone[0]))
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passage = lambda n: " ".join(word() for _ in range(n))
    shared = [passage(12), passage(30), passage(60)]
    texts = [None, "", "x", "a" * 500, "ab" * 300, "ab" * 301, passage(2000)]
    for _ in range(25):
        parts = [passage(rng.randint(0, 40))]
        for s in rng.sample(shared, rng.randint(0, 3)):
            words = s.split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = word()
            parts += [" ".join(words), passage(rng.randint(0, 20))]
        texts.append(" ".join(parts))
    texts += [texts[8]] * 3 + [shared[2] + " " + shared[2]]
    return texts


@pytest.mark.parametrize(("length", "crowd"), [(40, 1 << 21), (40, 400), (41, 120)])
def test_equals_brute_force(documents, length, crowd):
    texts = corpus(length + crowd)
    frame = documents([(i, t) for i, t in enumerate(texts)], extra=True)
    rows = sd.stripped(frame, length=length, gram=8, crowd=crowd).collect()
    expected = brute([(t or "").encode() for t in texts], length)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert got == dict(enumerate(expected))


def test_repeated_rows_and_null_ids(documents):
    text = "some words that are long enough to be a passage of their own"
    rows = sd.stripped(documents([(None, text), (None, text), (1, None), (1, None)]), length=30, gram=8).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in rows) == [(0, 0), (0, 0), (60, 60), (60, 60)]


def test_empty_table(documents):
    assert sd.stripped(documents([])).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_order(letters):
    rng = np.random.default_rng(letters)
    for size in [*range(20), 200, 500]:
        text = rng.integers(0, letters, size).astype(np.uint8)
        data = text.tobytes()
        assert sd.suffix_order(text, 10**9).tolist() == sorted(range(size), key=lambda i: data[i:])
        order = sd.suffix_order(text, 6)
        assert sorted(order.tolist()) == list(range(size))
        places = {}
        for k, i in enumerate(order):
            if i + 6 <= size:
                places.setdefault(data[i : i + 6], []).append(k)
        assert all(v[-1] - v[0] == len(v) - 1 for v in places.values())


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 1000)
    text = bytes(np.random.default_rng(3).integers(97, 100, 5000).astype(np.uint8))
    starts = [at + i for at, piece in sd._pieces(text, 200) for i in range(len(piece) - 199)]
    assert starts == list(range(5000 - 199))
