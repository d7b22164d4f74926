import random
import re
import time

import pytest

from terrainframe.llm import secrets as sc


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return sc.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_base(text):
    out = []
    for kind, pattern, flags, least in ((0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 8), (1, "AKIA[A-Z0-9]+", 0, 16), (2, "[0-9a-f]+", 0, 32)):
        out += [(m.start(), kind, m.end()) for m in re.compile(pattern, flags).finditer(text) if len(m[2] if kind == 0 else m[0]) >= least]
    return sorted(out)


def test_base_spans_against_brute_force():
    rng = random.Random(1)
    parts = ["token", "Password", "API_KEY", ' = "', ":", "=", "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "abc", " ", "é", "ſecret", "x" * 9]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert sc.base_spans(t) == brute_base(t), t


def test_shapes_of_plain_words_depend_on_the_key_only():
    seen = {}
    for t in ("the", "and", "The", "Été", "été", "the.", "THE", "onenerth", "edonreab", "Onenerth.", "deadbeef"):
        k = sc.plain(t)
        assert k and seen.setdefault(k, sc.shape(t)) == sc.shape(t)
    assert all(max(sc.shape(t)) < sc.N_SHAPES for t in ("a" * 500, "=", "日", "token=", "AKIAABC", "x.y", "🙂"))


def test_finds_unseen_credentials_and_leaves_prose_alone(model, spark, sf_dir):
    tagger, rng = sc.Tagger(model), random.Random(23)
    secret = lambda: "".join(rng.choices("ABCDEFGHIJabcdefghij0123456789", k=36))
    prose = "Anat with by of nteres atre are. Thnt eringing onheed, "
    texts = [prose + f'auth: "{secret()}" ' + prose for _ in range(50)]
    hit = sum(any(k == 3 for _, k, _ in s) for s in sc.spans(texts, tagger))
    assert hit >= 40
    clean = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text and not sc.base_spans(r.text)]
    assert sum(any(k == 3 for _, k, _ in s) for s in sc.spans(clean, tagger)) <= 0.02 * len(clean)


def test_skipping_cold_texts_changes_nothing(model):
    a, b = sc.Tagger(model), sc.Tagger(model)
    b.margin = float("inf")
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "of.", "x9F3k" * rng.randrange(1, 8), "=", '"', "key:", "1234567890"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    assert sc.spans(texts, a) == sc.spans(texts, b)


def test_edges(spark, model):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "token=abcdefgh1", "x"), (3, "token=abcdefgh1", "x"), (None, "word " * 40_000, "x")], "doc_id long, text string, secrets string")
    rows = sc.scan(df, model).collect()
    assert [len(r.secrets) for r in rows[:4]] == [0, 0, 1, 1] and not rows[4].secrets
    assert sc.scan(df.limit(0), model).count() == 0
    assert sc.fit(df.limit(0))["w"].shape[1] == 3


def test_long_runs_take_linear_time(model):
    """Ten megabytes of blanks, of letters and of one base pattern's beginning: seconds, not hours."""
    tagger = sc.Tagger(model)
    for t in ("a" + " " * 10_000_000, " \n" * 2_000_000 + "token=abcdefgh1" + "\t" * 3_000_000, "a" * 3_000_000, "password " + " " * 3_000_000 + "x", "token" * 300_000):
        began = time.perf_counter()
        found = sc.spans([t], tagger)[0]
        assert time.perf_counter() - began < 20
        assert [s for s in found if s[1] != 3] == brute_base(t)


def test_windows_are_drawn_from_the_whole_text():
    text = "word " * 100_000 + "token=abcdefgh12345678"
    assert any(sc.BEGIN in found for _, found, _ in sc.windows(text))


def test_words_next_to_a_token_have_weights_of_their_own(model):
    assert model["words"].shape == (3, sc.WORD_BUCKETS + 1, 3) and not model["words"][:, -1].any() and abs(model["words"]).max() > 0.1
    assert sc.word_bucket("Token.") == sc.word_bucket("token") >= 0 > sc.word_bucket("x9") == sc.word_bucket("=")


@pytest.mark.parametrize("form", [lambda r: "glpat-" + "".join(r.choices("abcdefghijkmnpqrsXYZ0123456789", k=20)), lambda r: "-".join("".join(r.choices("0123456789ABCDEF", k=8)) for _ in range(4)), lambda r: "AIza" + "".join(r.choices("abcdefgh_-XYZ0123456789", k=35))])
def test_recall_on_forms_it_was_not_trained_on(model, form):
    tagger, rng = sc.Tagger(model), random.Random(29)
    prose = "Anat with by of nteres atre are. Thnt eringing onheed, "
    texts = [prose + f'credential = "{form(rng)}" ' + prose for _ in range(60)]
    assert sum(any(k == 3 for _, k, _ in s) for s in sc.spans(texts, tagger)) >= 42
