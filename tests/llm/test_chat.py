import random

from pyspark.sql import functions as F

from terrainframe.llm import chat


def make(spark):
    rng = random.Random(1)
    bits = ["\\", "<", "</turn>", "\\l", "<text>", "a", " ", "\n", "é🙂", "###", "\\\\", "word word "]
    some = lambda: None if rng.random() < 0.05 else "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
    rows = []
    for c in range(60):
        first = rng.choice(["system", "user"])
        for t in range(rng.randrange(1, 14)):
            rows.append((c if c else None, t, first if t == 0 else rng.choice(["user", "assistant", "system", None, "odd<role\\"]), some()))
    rows += [(99, 0, "system", "only")] + [(98, 0, "assistant", "same")] * 3 + [(97, t, "assistant" if t % 2 else "user", "long text " * 40) for t in range(60)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_reads_back_each_turn_and_target_once(spark):
    rows, df = make(spark)
    for budget, history in ((60, 10), (2048, 256), (1, 0)):
        back = {r.conv_id: r for r in chat.read_back(chat.windows(df, budget, history)).collect()}
        assert set(back) == {r[0] for r in rows}
        for c, r in back.items():
            own = sorted(((t, role or "", text or "") for k, t, role, text in rows if k == c))
            assert [(t.role, t.text) for t in r.turns] == [(a, b) for _, a, b in own]
            assert r.loss_text == "".join(b for _, a, b in own if a == "assistant")


def test_windows_keep_to_the_budget(spark):
    rows, df = make(spark)
    budget, history = 200, 90
    n = {(c, i): chat for c, i in ()}
    sizes = {r.text: r.n for r in df.select("text", (chat.tokens(F.coalesce("text", F.lit(""))) + chat.OVERHEAD).alias("n")).distinct().collect()}
    for w in chat.windows(df, budget, history).where("conv_id in (97, 5, 9)").collect():
        turns = w.formatted.split("</turn>")[:-1]
        texts = [t.split("<text>", 1)[1].replace("\\\\", "\0").replace("\\l", "<").replace("\0", "\\") for t in turns]
        total = sum(sizes.get(t, sizes.get(None)) for t in texts)
        assert total <= budget or len(turns) - w.n_repeated == 1
        assert sum(sizes.get(t, 3) for t in texts[: w.n_repeated] if "long" in t) <= history
        masked = w.formatted[sum(len(t) + 7 for t in turns[: w.n_repeated]) :]
        assert all(w.formatted[s.start : s.start + s.length] in masked for s in w.loss)
    assert not n


def test_empty(spark):
    _, df = make(spark)
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0


def test_many_short_turns_fill_the_history(spark):
    """History is bounded by its tokens alone: 256 tokens hold 85 empty turns."""
    df = spark.createDataFrame([(1, t, "user" if t % 2 else "assistant", "", 0) for t in range(2000)], "conv_id long, turn long, role string, text string, n long")
    found = chat.windows(df).orderBy("window").collect()
    assert [w.n_repeated for w in found][1:] == [256 // chat.OVERHEAD] * (len(found) - 1) and len(found) > 2
    assert chat.windows(df, tokens_col="n").count() == len(found)


def test_tokens_of_a_column(spark):
    df = spark.createDataFrame([(1, t, "user", "w", None if t == 3 else 97) for t in range(10)], "conv_id long, turn long, role string, text string, tokens long")
    found = chat.windows(df, budget=200, history=0, tokens_col="tokens").collect()
    assert len(found) == 5 and all(w.n_repeated == 0 for w in found)


def test_long_turns(spark):
    df = spark.createDataFrame([(1, 0, "system", "s " * 3000), (1, 1, "user", "<u> " * 50_000), (1, 2, "assistant", "\\a " * 50_000)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.windows(df)).first()
    assert [t.text for t in back.turns] == ["s " * 3000, "<u> " * 50_000, "\\a " * 50_000] and back.loss_text == "\\a " * 50_000
