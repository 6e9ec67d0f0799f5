"""Fingerprints and classes against plain Python."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from sitesieve.llm import simhash as sh
from sitesieve.llm.components import components


def plain(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, bits):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprint():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "two Words", "ÄB É x y z", "a\x1cb c d e", "w " * 70_000]
    texts += [" ".join(rng.choice(["A", "b", "cé", "d\n", "ß"]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    for text in texts:
        assert sh.fingerprint(text) == plain(text)


@pytest.mark.parametrize(("bits", "crowd"), [(3, 1 << 13), (3, 20), (1, 1 << 13), (5, 30)])
def test_classes(spark, bits, crowd):
    rng = random.Random(bits)
    prints = [0, (1 << 64) - 1]
    # Chains, crowds around a centre, and crowds that share one half.
    for _ in range(4):
        at = rng.getrandbits(64)
        for _ in range(12):
            prints.append(at)
            at ^= sum(1 << b for b in rng.sample(range(64), bits))
        centre = rng.getrandbits(64)
        prints += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits))) for _ in range(30)]
        prints += [(centre >> 32 << 32) | rng.getrandbits(32) for _ in range(30)]
    prints = sorted(set(prints), key=lambda p: p - (1 << 64) if p >> 63 else p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r["node"]: r["root"] for r in components(sh.links(nodes, bits, crowd)).collect()}
    assert [found.get(p, p) for p in signed] == [signed[r] for r in classes(prints, bits)]


def test_documents(documents):
    words = [f"w{i}" for i in range(300)]
    near = list(words)
    near[150] = "other"
    rows = [(7, " ".join(words)), (3, " ".join(near)), (9, " ".join(words).upper()), (5, None), (4, ""), (None, " ")]
    rows += [(11, "quite another text"), (11, "quite another text"), (None, "without any id")]
    frame = documents(rows, extra=True)
    found = sh.near_duplicates(frame).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], set()).add(r["component_id"])
    prints = [plain(t) for _, t in rows]
    expected = {}
    for i, c in enumerate(classes(prints, 3)):
        ids = [rows[j][0] for j, d in enumerate(classes(prints, 3)) if d == c and rows[j][0] is not None]
        expected.setdefault(rows[i][0], set()).add(min(ids, default=None))
    assert by_id == expected
    kept = sh.one_of_each(frame)
    assert kept.columns == frame.columns
    assert kept.count() == len(set(classes(prints, 3)))
    assert {r["doc_id"] for r in kept.collect()} == {min(v, default=None) if None not in v else None for v in expected.values()}


def test_empty_table(documents):
    assert sh.near_duplicates(documents([])).count() == 0
    assert sh.one_of_each(documents([])).count() == 0


def test_components_of_a_path(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).filter("a % 20 != 19")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {i: i // 20 * 20 for i in range(60) if i % 20}
