"""Planted copies and paraphrases of items, and plain longest common subsequences."""

import random

import numpy as np
import pyarrow as pa

from sitesieve.llm import decontamination as dc


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_common():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = rng.integers(0, 6, rng.integers(1, 40)), rng.integers(0, 6, rng.integers(0, 60))
        assert dc.common(a, b) == plain_common(a.tolist(), b.tolist())


def test_answer_of():
    assert dc.answer_of("What? Answer: forty two") == " forty two"
    assert dc.answer_of("One. Two three.") == "Two three."
    assert dc.answer_of(None) == "" == dc.answer_of("?!")


def test_leaks(spark, documents):
    rng = random.Random(6)
    words = ["".join(rng.choice(["an", "er", "the", "ou", "st", "re", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(12 + 3 * i) + ". " + prose(8) + ".") for i in range(12)] + [(90, None), (91, ""), (92, "?!")]
    rows = [(i, prose(rng.randint(5, 300))) for i in range(120)]
    expected = set()
    for i, (item, text) in enumerate(items[:12]):
        rows.append((1000 + i, prose(100) + "\n" + text.upper() + "\n" + prose(77)))
        changed = [w if k % 8 else rng.choice(words) for k, w in enumerate(text.split())]
        rows.append((2000 + i, prose(rng.randint(0, 90)) + " " + " ".join(changed) + " " + prose(30)))
        rows.append((3000 + i, prose(20) + " ".join(text.split()[: len(text.split()) // 3]) + prose(20)))
        expected |= {(1000 + i, item), (2000 + i, item)}
    rows += [(4000, None), (4001, ""), (4002, items[3][1]), (4002, items[3][1]), (None, items[4][1])]
    rows += [(4003, prose(9000) + " " + items[5][1] + " " + prose(9000))]
    expected |= {(4002, 3), (None, 4), (4003, 5)}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (200, 5):
        found = dc.leaks(documents(rows, extra=True), benchmark, block=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == expected
        assert len(found) == len(expected) + 1


def test_empty_tables(spark, documents):
    benchmark = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    assert dc.leaks(documents([]), benchmark).count() == 0
    assert dc.leaks(documents([(1, "a b c")]), benchmark.limit(0)).count() == 0


def test_short_and_long_items(spark, documents):
    """Exact copies of items of 3, 1,000 and 4,000 words in prose that has no other words than the benchmark."""
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)})
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, " ".join(words[:3])), (2, " ".join(rng.sample(words, 1000))), (3, " ".join(rng.sample(words, len(words))))]
    items += [(4, prose(40)), (5, f"{words[8]} {words[8]} {words[9]}"), (6, prose(700))]
    rows = [(i, prose(rng.randint(5, 300))) for i in range(100)]
    rows += [(1000 + i, prose(150) + " " + text + " " + prose(130)) for i, text in items]
    rows += [(2001, f"{prose(60)} {words[2]} {words[1]} {words[0]} {prose(60)}"), (2002, prose(2000))]
    rows += [(2003, f"{words[8]} {prose(50)} {words[8]} {words[9]}")]
    # Seven words in every eight of the long one.
    changed = [w if k % 8 else rng.choice(words) for k, w in enumerate(items[1][1].split())]
    rows += [(3000, prose(77) + " " + " ".join(changed) + " " + prose(300))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = dc.leaks(documents(rows), benchmark).collect()
    expected = {(1000 + i, i) for i, _ in items} | {(3000, 2)}
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected
    assert {r["item_words"] for r in found if r["item_id"] == 3} == {len(words)}


def test_any_window_counts(spark, documents):
    """A partial copy with more common words hides no paraphrase with the answer; repeated words count as often as they stand."""
    rng = random.Random(12)
    words = ["".join(rng.choice(["an", "er", "the", "ou", "st", "re", "ing"]) for _ in range(rng.randint(2, 4))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    body, answer = [f"q{k}" for k in range(30)], [f"a{k}" for k in range(10)]
    others = [f"b{k}" for k in range(20)]
    repeated = [w for x in others for w in ("the", x)]
    items = [(1, " ".join(body) + " answer: " + " ".join(answer)), (2, " ".join(repeated) + " answer: c0 c1 c2 c3")]
    items += [(10 + i, prose(30)) for i in range(20)]
    partial, answered = " ".join(body[:29]), " ".join([*body[:17], *answer])
    tied = " ".join(body[:27])
    rows = [(i, prose(rng.randint(5, 300))) for i in range(100)]
    rows += [(1000, f"{prose(60)} {partial} {prose(400)} {answered} {prose(60)}"), (1001, f"{partial} {prose(300)}")]
    rows += [(1002, f"{tied} {prose(400)} {answered}")]
    rows += [(2000, prose(30) + " " + " ".join(w for w in repeated if w == "the" or w in others[14:]) + " c0 c1 c2 c3 " + prose(30))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in dc.leaks(documents(rows), benchmark).collect()}
    assert set(found) == {(1000, 1), (1002, 1), (2000, 2)}
    assert found[1000, 1]["answered"] and found[1000, 1]["common_words"] == 27
    assert found[2000, 2]["common_words"] == 30


def test_table_of_products():
    """Sums over passages by the table of products equal those by rows and those over written-out passages."""
    rng = np.random.default_rng(7)
    size = 40
    texts = [rng.integers(-1, size, n).astype(np.int32) for n in (0, 1, 24, 25, 47, 48, 49, 300, 5000, 24, 3)]
    texts.append(np.full(100, -1, dtype=np.int32))
    weights, basis = rng.random(size) + 0.1, rng.standard_normal((size, 6))
    batches = [pa.record_batch([pa.array(part, pa.list_(pa.int32()))], names=["terms"]) for part in (texts[:7], texts[7:])]
    expected = np.zeros(basis.shape)
    for terms in texts:
        blocks = [terms[i : i + dc.HALF] for i in range(0, len(terms), dc.HALF)]
        for passage in [np.concatenate(b) for b in zip(blocks, blocks[1:])] or blocks:
            known = passage[passage >= 0]
            row = np.bincount(known, weights[known], minlength=size)
            expected += np.outer(row, row @ basis) / max((weights[known] ** 2).sum(), 1e-12)
    for most in (size, 0):
        (found,) = dc._power(weights, basis, most)(iter(batches))
        assert np.allclose(np.array(found.column(1).to_pylist()), expected)


def test_terms_of_all_letters():
    """Words that Latin-1 has and words that it has not, parted as by the pattern."""
    texts = ["Ünïcode, naïve\x85x\x1cy_z 4²", "日本 und Straße", "\u212aelvin İx", None, "a-b\xa0c\tµ ª"]
    vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in dc.words(t)}))}
    ids = pa.array(range(len(texts)))
    (found,) = dc._terms(vocabulary)(iter([pa.record_batch([ids, ids, ids, pa.array(texts)], names=["doc_id", "k1", "k2", "text"])]))
    assert found.column(3).to_pylist() == [[vocabulary[w] for w in dc.words(t)] for t in texts]


def test_fitted_on_every_document(spark, documents, monkeypatch):
    """More documents than any sample had, copies among them: all are fitted on, and the items keep their share."""
    seen = []

    def latent(texts, items, weights, rank, weight):
        seen.append((texts.count(), weight))
        return fitted(texts, items, weights, rank, weight)

    fitted = dc.latent
    monkeypatch.setattr(dc, "latent", latent)
    text = "the quick zebu jumps over nine lazy okapis while seven tapirs watch from the old wooden bridge"
    rows = [(i, f"the old bridge number {i % 3000}") for i in range(4000)] + [(9000, "well " + text)]
    benchmark = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in dc.leaks(documents(rows), benchmark).collect()] == [(9000, 1)]
    assert seen == [(4001, dc.ITEM_WEIGHT * 4001 / dc.TEXTS)]
