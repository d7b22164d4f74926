import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrainframe.llm import language, lockstep


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = rng.integers(1, 6, 5)
        k = int(rng.integers(2, 4))
        scores, change, start = rng.normal(size=(int(lengths.sum()), k)), rng.normal(size=(k, k)), rng.normal(size=k)
        got, at = lockstep.viterbi(scores, lengths, change, start), 0
        for n in lengths:
            value = lambda p: start[p[0]] + sum(scores[at + i, x] for i, x in enumerate(p)) + sum(change[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
            assert tuple(got[at : at + n]) == max(itertools.product(range(k), repeat=int(n)), key=value)
            at += int(n)


def test_trigrams_by_word():
    words = ["a", "bc", "défg"]
    together, starts = language.trigrams(words)
    assert [list(together[a : a + len(w)]) for a, w in zip(starts, words, strict=True)] == [list(language.trigrams([w])[0]) for w in words]


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return language.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), trained=~language.held_out("doc_id"))


def test_held_out_accuracy(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(language.held_out("doc_id"))
    right = language.identify(docs, model).select(F.avg((F.col("language.lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert right >= 0.97


def test_mixed_text_has_spans(spark, sf_dir, model):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()
    first = {r.lang: r.text[:300] for r in rows if r.text and len(r.text) > 300}
    mixed = first["en"] + " " + first["de"]
    spans = language.Labeller(model, language.SWITCH).spans(mixed)
    assert spans[0][2] == "en" and spans[-1][2] == "de" and len(spans) <= 4


def test_edges(spark, model):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 ²! 🙂", "x"), (4, "日本 the", "x"), (4, "日本 the", "x"), (None, "the " * 50_000, "x")], "doc_id long, text string, language string")
    rows = language.identify(df, model, with_spans=True).collect()
    assert [(r.language.lang_pred, r.language.score) for r in rows[:3]] == [("und", 0.0)] * 3
    assert rows[3].language == rows[4].language and rows[5].language.lang_pred == "en"
    assert language.identify(df.limit(0), model).count() == 0
    none = language.fit(df.withColumn("lang", F.lit(None).cast("string")))
    assert language.identify(df, none).first().language.lang_pred == "und"
    rng = random.Random(1)
    few = language.fit(spark.createDataFrame([(i, rng.choice(["алло да", "hello yes"])) for i in range(40)], "doc_id long, text string").withColumn("lang", F.when(F.col("text").startswith("h"), "en").otherwise("ru")))
    got = language.identify(spark.createDataFrame([(1, "да нет"), (2, "no yes")], "doc_id long, text string"), few).collect()
    assert [r.language.lang_pred for r in got] == ["ru", "en"]


def test_scripts_rule_out_languages_for_every_word(spark):
    """Latin words never go to a Cyrillic language, however flat its model; a word of two scripts goes by both."""
    rows = [(i, "hello yes the house") for i in range(400)] + [(i, "да") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.when(F.col("text").startswith("h"), "en").otherwise("ru"))
    model = language.fit(docs)
    texts = ["zzqqxx jjkkvv", "Éqzz", "дада", "qqдqq"]
    got = language.Labeller(model, language.SWITCH).predict(texts)
    assert [x[0] for x in got[:3]] == ["en", "en", "ru"] and language.scripts_of("qqдqq") == [language.LATIN, language.NAMES.index("Cyrillic")]


def test_many_labels_and_a_very_long_word(monkeypatch):
    """Steps are taken in parts, with the same labels."""
    import numpy as np

    from terrainframe.llm import lockstep

    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 40, 50)
    scores, change = rng.normal(size=(lengths.sum(), 60)).astype(np.float32), (-2 * (1 - np.eye(60))).astype(np.float32)
    whole = lockstep.viterbi(scores, lengths, change)
    monkeypatch.setattr(lockstep, "CELLS", 7200)
    assert (lockstep.viterbi(scores, lengths, change) == whole).all()
    letters = language.trigrams(["a" * 1_000_000])
    assert len(letters[0]) == 1_000_000
