import random
import time

import pytest

from terrainframe.llm import token_counts as tc


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = tc.sentencepiece_vocabulary(tc.default_path())
    model = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    model.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return model


def test_same_counts_as_the_library(library, spark, sf_dir):
    model = tc.Unigram(tc.sentencepiece_vocabulary(tc.default_path()))
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() if r.text]
    rng = random.Random(5)
    texts += ["".join(rng.choice("ab ,.<s>\n▁  é日ა́x0A") for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [" ", "  a", "a  b", "\n", "日本語 テスト", "🙂🙂", "a🙂b", "<unk><s>", "▁x"]
    for t in texts:
        assert model.count(t)[0] == len(library.encode(t, add_special_tokens=False).ids), t


def test_best_score_against_all_splits():
    model = tc.Unigram([("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -1.0), ("▁a", -3.0), ("aba", -3.5)])
    scores = {"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -4.0, "ba": -1.0, "▁a": -3.0, "aba": -3.5}

    def best(word):
        return max((scores[word[:i]] + best(word[i:]) for i in range(1, len(word) + 1) if word[:i] in scores), default=float("-inf")) if word else 0.0

    for w in ("▁ab", "▁abab", "▁abaab", "▁bbab", "▁aabba"):
        assert model.solve(w)[1] == best(w)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "the " * 50_000, "x")], "doc_id long, text string, tokens string")
    rows = [(r.doc_id, r.tokens.n_tokens) for r in tc.count_tokens(df).collect()]
    assert rows[:2] == [(1, None), (2, 0)] and rows[2] == rows[3] and rows[4][1] >= 50_000
    assert tc.count_tokens(df.limit(0)).count() == 0


def test_long_runs_without_spaces(library, spark):
    """Runs whose neighbouring pairs lie in no piece, far beyond Python's recursion limit."""
    chinese = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏"
    texts = [(chinese * 5_000)[:100_000], ("🙂🚀🎉" * 40_000)[:100_000], (chinese + "🙂the ") * 3_000]
    model = tc.Unigram(tc.sentencepiece_vocabulary(tc.default_path()))
    for t in texts:
        assert model.count(t)[0] == len(library.encode(t, add_special_tokens=False).ids)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r.tokens.n_tokens for r in tc.count_tokens(df).collect()] == [model.count(t)[0] for t in texts]


def test_a_million_characters_without_a_blank(library, spark):
    """Linear time and the library's counts; the library itself takes the same text in pieces that no entry crosses."""
    rng = random.Random(8)
    alphabet = {"emoji": "🙂🚀🌍🎉", "cjk": "日本語中文字漢", "control": "\x01\x02\x1f", "mixed": "aAqQzZ日🙂\x01é", "pairs": "zq"}
    texts = {k: "".join(rng.choices(v, k=1_000_000)) for k, v in alphabet.items()} | {"twice": "zq" * 500_000, "once": "aQ" * 1500}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(4)
    began = time.perf_counter()
    rows = {r.doc_id: r.tokens.n_tokens for r in tc.count_tokens(df).collect()}
    assert time.perf_counter() - began < 90
    model = tc.Unigram(tc.sentencepiece_vocabulary(tc.default_path()))
    for k, t in texts.items():
        head = t[:20_000]
        assert model.count(head)[0] == len(library.encode(head, add_special_tokens=False).ids), k
        assert rows[k] >= len(t) // 16 and rows[k] == model.count(t)[0]
    assert rows["once"] == len(library.encode(texts["once"], add_special_tokens=False).ids)
