"""Spelling variants against all pairs of words, on made-up words and on the smallest table."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from sitesieve.llm import spelling as sp

TABLE = "/root/testdata/sf0.001/documents.parquet"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_definition(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    # Only words that agree but for one deletion on either side can be near.
    near, shapes = {w: set() for w in words}, {}
    for w in words:
        for s in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            shapes.setdefault(s, []).append(w)
    for group in shapes.values():
        for a, b in combinations(group, 2):
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def rows_of(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return [tuple(r) for r in frame.collect()]


def same(frame, rows):
    found = rows_of(frame)
    assert len(found) == len(set(found))
    assert set(found) == by_definition(rows)


@pytest.mark.parametrize("letters", ["ab", "abcdeé", "abcdefghijklmnop"])
def test_against_all_pairs(spark, documents, letters):
    rng = random.Random(letters)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) for _ in range(400)]
    for w in words[:150]:  # edited copies
        at = rng.randrange(len(w) + 1)
        words.append(rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + "z" + w[at + 1 :]]))
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=60))) for i in range(200)]
    same(sp.variants(documents(rows).repartition(30)), rows)


def test_smallest_table(spark):
    frame = spark.read.parquet(TABLE)
    rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    same(sp.variants(frame), rows)


def test_odd_rows(spark, documents):
    long = "q" * 3000 + "w"
    rows = [(None, "Wörter WÖRTER wörter"), (1, None), (2, ""), (3, "×÷×÷×÷ ×÷×÷×÷ ×÷×÷×÷ àààààà"), (4, f"{long} {long}x {long[1:]} " * 4)]
    rows += [(5, "same word again " * 900)] * 3 + [(6, "samé wore again again-again")] * 2
    same(sp.variants(documents(rows, extra=True).repartition(6)), rows)
    assert rows_of(sp.variants(documents([]))) == []
    assert rows_of(sp.variants(documents([(1, "a bb ccc"), (2, None)]))) == []


def test_chains(spark, documents):
    """Forms are followed to the last."""
    chain = ["aaaaaaaa"[:k] + "bbbbbbbb"[k:] for k in range(9)]
    rows = [(7, " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k)))]
    found = {r[0]: r[2] for r in rows_of(sp.variants(documents(rows)))}
    same(sp.variants(documents(rows)), rows)
    assert sum(root == chain[-1] for root in found.values()) >= 7


def test_pivots_by_all_choices():
    rng = random.Random(1)
    for _ in range(300):
        places = rng.sample(range(12), rng.randint(1, 7))
        grams = [(rng.randrange(9), p) for p in places]
        weight = [rng.randrange(1, 20) for _ in range(9)]
        choices = [c for c in combinations(sorted(grams, key=lambda g: g[1]), 2) if c[1][1] - c[0][1] >= sp.GRAM]
        found = sp.pivots(grams, weight)
        assert bool(found) == bool(choices)
        if choices:
            assert sum(weight[g] for g, _ in found) == min(sum(weight[g] for g, _ in c) for c in choices)
            assert found[1][1] - found[0][1] >= sp.GRAM
