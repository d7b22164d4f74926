import random
import re

from terrainframe.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_measures_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "b", "é", "🙂", "##", "<x>"]) + rng.choice([" ", "\n", "\t", "\x0b ", "\r\n", "\xa0", "\n\n"]) for _ in range(rng.randrange(70))) for _ in range(250)]
    texts += [None, "", " ", "a b c d e a b c d e", "a a a a a a", "x " * 20_000, "\na\na\n"]
    df = spark.createDataFrame([(i, t, f"h{i}", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int")
    for r in quality.judge(df).collect():
        want = brute(texts[r.doc_id])if len(texts[r.doc_id] or "") < 30_000 else (20_000, 20_000, 0, 0, 20_000)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed)


def test_line_frequency_by_host(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    rows = [(i, own(i) + "\nShare  this, NOW!\n" + own(1000 + i), "a") for i in range(30)]
    rows += [(100 + i, f"share this now\nnow w{i}", "a") for i in range(5)]
    rows += [(200 + i, "Share this now " + "\n" + " ".join(f"v{i}y{k}" for k in range(11)), None) for i in range(10)]
    rows += [(300 + i, "the same text of a page that many rows hold whole and well " * 1 + "ok", "a") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit in (quality.BROADCAST_LINES, -1):
        quality.BROADCAST_LINES, before = limit, quality.BROADCAST_LINES
        try:
            got = {r.doc_id: r for r in quality.judge(df, min_docs=20, share=0.1).collect()}
        finally:
            quality.BROADCAST_LINES = before
        assert all(got[i].n_removed_lines == 1 and got[i].kept and "hare" not in got[i].clean_text for i in range(30))
        assert all(got[100 + i].n_removed_lines == 1 and not got[100 + i].kept for i in range(5))
        assert all(got[200 + i].n_removed_lines == 0 and got[200 + i].kept for i in range(10))
        assert all(got[300 + i].kept and got[300 + i].n_removed_lines == 0 for i in range(60))


def test_depleted_documents_go(spark):
    rows = [(i, "one common line of twelve words that is all there is in it\n" + f"x{i}", "a") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert not any(r.kept for r in quality.judge(df).collect())
    assert quality.judge(df.limit(0)).count() == 0
