import random
import re

from terrainframe.llm import decontamination as dc

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items, window=10):
    words = WORD.findall(text.lower().encode() if text.isascii() else text.encode().lower()) if text else []
    hit, ids = set(), set()
    for item, t in items:
        own = WORD.findall(t.encode().lower()) if t else []
        wins = {tuple(own[i : i + window]) for i in range(max(1, len(own) - window + 1))} if own else set()
        for w in wins:
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    ids.update([] if item is None else [item])
    return len(words), len(hit), sorted(ids)


def test_against_brute_force(spark):
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice(["a", "B", "cé", "1x"]) + rng.choice([" ", ", ", "\n", "_"]) for _ in range(n))
    items = [(i, some(rng.randrange(0, 8))) for i in range(12)] + [(12, None), (13, ""), (14, "B"), (15, "B"), (None, some(5))]
    docs = [(i, some(rng.randrange(0, 60))) for i in range(60)] + [(60, None), (61, ""), (62, "..."), (5, some(9))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 3, 1):
        got = sorted(((r.text or ""), r.scan.n_words, r.scan.n_hit, list(r.scan["items"])) for r in dc.scan_benchmark(d, b, window=4, max_windows=size).collect())
        want = []
        for _, t in docs:
            n, h, ids = brute(t, items, 4)
            want.append(((t or ""), n, h, sorted(map(str, ids))))
        assert got == sorted(want)


def test_spans_point_into_the_original(spark):
    text = "Été: vor DEM, ersten  Wort - danach."
    d, b = spark.createDataFrame([(1, text, "kept")], "doc_id long, text string, scan string"), spark.createDataFrame([("q", "dem ersten Wort")], "item_id string, text string")
    r = dc.scan_benchmark(d, b).first()
    assert [text[s.start : s.end] for s in r.scan.spans] == ["DEM, ersten  Wort"]
    assert dc.cut_spans(text, [(s.start, s.end) for s in r.scan.spans]) == "Été: vor  - danach."


def test_clean_and_empty(spark):
    d = spark.createDataFrame([(1, "one two three"), (2, None), (3, "four")], "doc_id long, text string")
    b = spark.createDataFrame([("q", "Two, THREE")], "item_id string, text string")
    assert sorted(r.doc_id for r in dc.clean(d, b).collect()) == [2, 3]
    assert dc.clean(d, b.limit(0)).count() == 3
    named = d.selectExpr("doc_id", "text", "'mine' AS scan", "1 AS row", "2 AS _scan_of_input")
    assert [tuple(r) for r in dc.clean(named, b).orderBy("doc_id").collect()] == [(2, None, "mine", 1, 2), (3, "four", "mine", 1, 2)]
    assert dc.clean(d.limit(0), b).count() == 0


def test_memory_of_the_automaton():
    """Under a hundred bytes a node: the bound on windows bounds a worker's memory."""
    rng = random.Random(6)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(20_000)).encode()
    found = dc.Benchmark([("q", text)], 10)
    stats = found.find.get_stats()
    assert stats["nodes_count"] <= 10 * 20_000 and stats["total_size"] < 100 * stats["nodes_count"]


def test_items_without_an_id_are_hit_but_not_listed(spark):
    d, b = spark.createDataFrame([(1, "one two three")], "doc_id long, text string"), spark.createDataFrame([(None, "two")], "item_id string, text string")
    r = dc.scan_benchmark(d, b).first().scan
    assert r.n_hit == 1 and not r["items"]
