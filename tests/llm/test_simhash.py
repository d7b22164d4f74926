import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from terrainframe.llm import components as cc
from terrainframe.llm import simhash as sh


def brute_mark(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(ids, edges):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = [None, "", " \t", "One", "one two", "A b C", *("".join(rng.choice(["Ab", "é", "x", "\xa0"]) + rng.choice([" ", "\n", "\x0b"]) for _ in range(rng.randrange(60))) for _ in range(100))]
    assert all(sh.fingerprint(t.encode() if t else None) == brute_mark(t) for t in texts)
    native = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert native % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", seed=42)


def clustered(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
    for i in range(n // 3, n):
        x = points[rng.integers(0, i)]
        for k in rng.choice(64, rng.integers(0, 6), replace=False):
            x ^= np.uint64(1) << np.uint64(k)
        points[i] = x
    return np.unique(points)


def test_links_connect_what_brute_force_connects(spark):
    points = clustered()
    near = np.argwhere(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3, 1))
    want = brute_components([int(x) for x in points.view(np.int64)], [(int(points.view(np.int64)[a]), int(points.view(np.int64)[b])) for a, b in near])
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fingerprint long")
    for leaf in (sh.LEAF, 100):
        sh.LEAF, before = leaf, sh.LEAF
        try:
            found = sh.near_links(df.repartition(3)).collect()
        finally:
            sh.LEAF = before
        assert all(bin((r.a ^ r.b) % (1 << 64)).count("1") <= 3 for r in found)
        assert len(found) < len(points) * 3
        assert brute_components(want, [(r.a, r.b) for r in found]) == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 5001 + i) for i in range(300)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == brute_components({x for e in real for x in e}, real)


def test_groups_and_edges(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(9, base, "x"), (4, base, "x"), (4, base, "x"), (7, base.replace("w399", "zz"), "x"), (1, None, "x"), (2, "", "x"), (3, "  ", "x"), (5, " ".join(f"v{i}" for i in range(300)), "x"), (None, base, "x"), (None, "alone in the world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = [(r.doc_id, r.component_id) for r in sh.groups(df).collect()]
    marks = {}
    for d, t, _ in rows:
        marks.setdefault(brute_mark(t), []).append(d)
    ks = list(marks)
    comp = brute_components(ks, [(a, b) for a in ks for b in ks if bin(a ^ b).count("1") <= 3])
    least = {}
    for k in ks:
        least.setdefault(comp[k], []).extend(d for d in marks[k] if d is not None)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(got, key=key) == sorted(((d, min(least[comp[brute_mark(t)]], default=None)) for d, t, _ in rows), key=key)
    kept = sh.representatives(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, {c for _, c in got}))
    assert sh.groups(df.limit(0)).count() == 0


def test_few_edges_take_no_rounds(spark, monkeypatch):
    """A long chain and a star are joined within tasks; what one task can't hold goes on in rounds, with the same components."""
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5), (None, 3), (2000, 1999)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    want = brute_components({x for e in edges if None not in e and e[0] != e[1] for x in e}, [e for e in edges if None not in e])
    names, real = [], cc.materialise
    monkeypatch.setattr(cc, "materialise", lambda df, name: names.append(name) or real(df, name))
    got = lambda: {r.node: r.component for r in cc.components(df).collect()}
    assert got() == want and names == ["edges", "task-stars"]
    for most in (40, 345):
        names.clear()
        monkeypatch.setattr(cc, "EDGES", most)
        assert got() == want and "task-stars" in names
    monkeypatch.setattr(cc, "EDGES", 40)
    names.clear()
    got()
    assert "stars" in names
