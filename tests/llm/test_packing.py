import random
import zlib
from collections import defaultdict

import numpy as np

from terrainframe.llm import packing


def check(rows, texts, capacity=4096, path=None):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path or packing.default_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert sorted(by_seq) == list(range(len(by_seq)))
    return sum(r.length for r in rows) / (capacity * len(by_seq))


def test_documents_come_back_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    fill = check(packing.pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert fill > 0.95


def test_odd_texts(spark):
    rng = random.Random(2)
    texts = {i: "".join(rng.choice(["It's", "'s,", "ÉTÉ", "é", " ", "\n", " ", "\x1c", "İs", "日本", "<|endoftext|>", "ab,", "a.b", "''", "9,", "don't.", "ŉ", "Σ", "|", "x", "\u0085"]) for _ in range(rng.randrange(25))) for i in range(300)}
    texts |= {500: None, 501: "", 502: "word " * 30_000}
    df = spark.createDataFrame([(k, v, "kept") for k, v in texts.items()], "doc_id long, text string, class string")
    check(packing.pack(df).collect(), texts)


def test_cuts_fit_their_slots():
    for n in range(1, 9000, 7):
        parts = packing.cuts(n)
        assert sum(x for x, _ in parts) == n and all(x <= 4096 // k for x, k in parts)


def test_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, None)], "doc_id long, text string")
    rows = packing.pack(df, with_ids=True).collect()
    assert len(rows) == 3 and all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    assert packing.pack(df.limit(0)).count() == 0


def test_another_tokenizer_goes_whole(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(packing.pack(docs, tokenizer_path=path).collect(), {r.doc_id: r.text for r in docs.collect()}, path=path)


def test_tiny_documents_fill_sequences_too(spark):
    """Empty and one-word documents: classes go up to the capacity, so padding stays small."""
    texts = {i: ["", None, "the", "the cat"][i % 4] for i in range(30_000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert check(packing.pack(df).collect(), texts) > 0.8
