import random
import re

import numpy as np
import pytest

from terrainframe.llm import buckets as bk
from terrainframe.llm import shingle_join as sj
from terrainframe.llm.components import Forest


def grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(docs):
    sets = [grams(t) for _, t in docs]
    forest = Forest(len(docs))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                forest.join(i, j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[forest.root(i)] = min(d, least.get(forest.root(i), d))
    return sorted(((d, len(sets[i]), least.get(forest.root(i))) for i, (d, _) in enumerate(docs)), key=repr)


def changed(rng, words, k):
    words = list(words)
    for _ in range(k):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[], [f"n{rng.randrange(10**6)}"], [words[at], "again"]])
    return " ".join(words)


@pytest.fixture(scope="module")
def docs():
    """Families with changes on both sides of the threshold, common passages, copies, and odd rows."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    out = []
    for f in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 12, 90, 200]))]
        out += [changed(rng, base, rng.randrange(6)) for _ in range(25)]
    out += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 90))) + " " + passage for _ in range(40)]
    out += [None, "", " \t\n", "One", "one", "one two", "ONE\ttwo", "one two three", "a a a a a", "a a a", "é É", "🙂 x y z"] * 2
    big = [f"b{i}" for i in range(30_000)]
    out += [" ".join(big), changed(rng, big, 40), changed(rng, big, 3000)]
    rng.shuffle(out)
    return [(i * 3 if i % 11 else None, t) for i, t in enumerate(out)]


def test_components_against_all_pairs(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6).selectExpr("*", "1 AS id", "2 AS h", "3 AS line", "4 AS n", "5 AS set_hash", "6 AS key")
    want = brute(docs)
    got = sorted((tuple(r) for r in sj.classes(df).collect()), key=repr)
    assert got == want
    assert len({c for _, _, c in want}) < len(want) - 60


def test_large_groups_through_pivots(spark, docs, monkeypatch):
    monkeypatch.setattr(bk, "BUCKET", 8)
    monkeypatch.setattr(bk, "PIVOTS", 3)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert sorted((tuple(r) for r in sj.classes(df).collect()), key=repr) == brute(docs)


def test_heavy_buckets_are_cut_by_weight(spark, docs, monkeypatch):
    """Few documents of many shingles make a bucket large, too."""
    monkeypatch.setattr(bk, "WEIGHT", 400)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert sorted((tuple(r) for r in sj.classes(df).collect()), key=repr) == brute(docs)


def test_exact_at_the_threshold():
    a = np.arange(1, 96, dtype=np.uint64)
    for more, less in ((5, 5), (6, 5), (5, 4), (10, 0), (11, 0)):
        b = np.concatenate((a[: len(a) - less], np.arange(1000, 1000 + more, dtype=np.uint64)))
        both, union = len(a) - less, len(a) + more
        assert sj.in_all_orders(a, b, 0.9) == (100 * both >= 90 * union)
    for n in range(1, 3000):
        assert sj.least_overlap(n, 0.9) == -(-9 * n // 10) and sj.more_tokens(n, 0.9) == n // 10


def test_every_order_admits_alike_sets():
    rng = random.Random(9)
    for _ in range(3000):
        n = rng.randrange(1, 120)
        a = {rng.randrange(1 << 64) for _ in range(n)}
        b = set(rng.sample(sorted(a), max(1, n - rng.randrange(0, 1 + n // 9)))) | {rng.randrange(1 << 64) for _ in range(rng.randrange(0, 1 + n // 12))}
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        assert sj.in_all_orders(x, y, 0.9) == (10 * len(a & b) >= 9 * len(a | b))
        if 10 * len(a & b) >= 9 * len(a | b):
            p, q = (s[: len(s) - sj.least_overlap(len(s), 0.9) + 1 + sj.more_tokens(len(s), 0.9)] for s in (x, y))
            assert len(np.intersect1d(p, q)) >= max(1, sj.more_tokens(sj.least_overlap(len(a), 0.9), 0.9))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sj.classes(df).count() == 0
