import random
import zlib
from collections import Counter, defaultdict

from terrainframe.llm import spelling as sp


def brute_words(docs, slip_every=97):
    import re

    out = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            if len(w) < 5:
                continue
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % slip_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    near = defaultdict(set)
    for a in words:
        for b in words:
            if one_apart(a, b):
                near[a].add(b)
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 2 * n:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def test_words_and_slips(spark):
    rng = random.Random(1)
    letters = "abcdeEÀÉéÿßñ×÷xyz"
    docs = [(i if i % 7 else None, " ".join("".join(rng.choice(letters) for _ in range(rng.choice([2, 5, 5, 5, 6]))) for _ in range(60)) + "\n12ab_Table,table's Tables") for i in range(200)]
    docs += [(1, None), (2, ""), (3, "table " * 4000), (3, "table " * 4000), (4, "x" * 200_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS word", "3 AS n", "4 AS h")
    for every in (97, 3):
        got = {r.word: r.n for r in sp.counted(df, slip_every=every).collect()}
        assert got == brute_words(docs, every)


def test_variants_against_all_pairs(spark):
    """Short alphabets give anagrams, repeated letters, edits at every place, chains of forms and ties."""
    rng = random.Random(2)
    words = {}
    while len(words) < 700:
        w = "".join(rng.choice("abcé") for _ in range(rng.choice([5, 6, 7])))
        words[w] = rng.choice([3, 4, 6, 8, 13, 30, 64, 500])
    for w in list(words)[:60]:
        long = w + "tionality" + w
        k = rng.randrange(len(long))
        for v, n in ((long, 900), (long[:k] + long[k + 1 :], 40), (long[:k] + "z" + long[k + 1 :], 3), (long[:k] + "q" + long[k:], 450)):
            words[v] = n
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted(tuple(r) for r in sp.variants(df).collect())
    want = brute_variants(words)
    assert got == want
    assert any(r[2] != r[1] and r[1] for r in want) and any(r[4] > 3 for r in want)


def test_long_chain_and_no_words(spark):
    chain = {"a" * (5 + k): 3 * 2 ** (40 - k) for k in range(40)}
    df = spark.createDataFrame(list(chain.items()), "word string, n long")
    rows = sp.variants(df).collect()
    assert {r.root for r in rows} == {"aaaaa"} and len(rows) == 40
    assert sp.variants(df.limit(0)).count() == 0
