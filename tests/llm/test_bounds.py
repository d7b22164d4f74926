"""What workers and the driver hold stays bounded: memos by bytes, training draws by windows, groups by shingles."""

import random
import time

from pyspark.sql import functions as F

from terrainframe.llm import buckets, common, language, lines, near_documents, packing, secrets, token_counts


def test_memos_forget_long_words():
    rng = random.Random(1)
    cjk = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000)) for _ in range(20)]
    odd = ["x" * 5000 + str(i) for i in range(20)]
    model = token_counts.Unigram(token_counts.sentencepiece_vocabulary(token_counts.default_path()))
    first = [model.count(t + " a word") for t in cjk + odd]
    assert [model.count(t + " a word") for t in cjk + odd] == first
    assert max(map(len, model.memo)) <= common.LONG and model.memo
    chunks = packing.Chunks(packing.default_path())
    texts = [t + " plain words, here" for t in odd]
    assert chunks.ids(texts) == chunks.whole(texts) and chunks.ids(texts[:3]) == chunks.whole(texts[:3])
    for memo in (chunks.memo, chunks.old, chunks.lower):
        assert all(len(w) <= common.LONG for w in memo)


def test_taggers_forget_long_words(spark):
    docs = spark.createDataFrame([(i, f"some words in a row {i} password = hunter2hunter2{i} more words", "en") for i in range(60)], "doc_id long, text string, lang string")
    tagger = secrets.Tagger(secrets.fit(docs))
    long = ["z" * 4000 + str(i) + " password: Aa1" + "b2" * 8 for i in range(5)]
    assert secrets.spans(long, tagger) == secrets.spans(long, tagger)
    assert all(len(w) <= common.LONG for w in tagger.memo)
    labeller = language.Labeller(language.fit(docs), 8.0)
    assert labeller.predict(["q" * 4000 + " words"]) == labeller.predict(["q" * 4000 + " words"])
    assert all(len(w) <= common.LONG for w in labeller.memo)


def test_training_draw_without_ids(spark, monkeypatch):
    """All ids null, or all the same: as many windows as ever, and long tokens are cut."""
    monkeypatch.setattr(secrets, "TRAIN_WINDOWS", 50)
    got = []
    monkeypatch.setattr(secrets, "fit_weights", lambda given: got.append(given))
    text = F.concat(F.lit("words and "), F.repeat(F.lit("w"), 3000), F.lit(" api_key = abcdefgh1234"), F.col("id").cast("string"))
    for key in (F.lit(None).cast("long"), F.lit(7).cast("long")):
        secrets.fit(spark.range(4000).select(key.alias("doc_id"), text.alias("text")), train_docs=100)
        own = got.pop()
        assert len(own) <= 2 * 50 + 900 and max(len(t) for tokens, _, _ in own for t in tokens) <= secrets.TOKEN_MOST


class NoTagger:
    def __init__(self, spans):
        self.spans = spans

    def added(self, texts):
        return [self.spans]


def test_many_spans_merge_in_linear_time():
    digest = "0123456789abcdef" * 2
    text = " ".join([digest] * 60_000)
    rng = random.Random(2)
    more = [(a, a + rng.randrange(1, 60)) for a in sorted(rng.randrange(len(text)) for _ in range(60_000))]
    began = time.perf_counter()
    found = secrets.spans([text], NoTagger(more))[0]
    assert time.perf_counter() - began < 20
    some = " ".join([digest] * 30)
    few = [(a, a + rng.randrange(1, 60)) for a in sorted(rng.randrange(len(some)) for _ in range(200))]
    base = secrets.base_spans(some)
    assert secrets.spans([some], NoTagger(few))[0] == sorted(base + [(a, 3, b) for a, b in few if not any(s < b and e > a for s, _, e in base)])
    assert len(found) >= 60_000


def test_long_documents_make_groups_of_their_own(spark, monkeypatch):
    """With groups of some thousand shingles, documents of one long line are still told apart and joined as before."""
    rng = random.Random(8)
    bases = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(700)) for _ in range(4)]
    docs = []
    for k, base in enumerate(bases):
        for i in range(6):
            words = base.split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(700)] = f"n{rng.randrange(10**6)}"
            docs.append((10 * k + i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(buckets, "WEIGHT", 3000)
    assert sorted(r.doc_id for r in near_documents.representatives(df).collect()) == [0, 10, 20, 30]
    kept = lines.dedup_lines(df).where("n_removed = 0").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [0, 10, 20, 30]
