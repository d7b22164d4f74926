"""Each ``opN_`` query: columns in order, types, whole table, and digests against plain Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest
import xxhash

from terrainframe.llm import queries as q
from terrainframe.llm import secrets

HEADS = {
    "op1_resharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op5_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op6_chat_windows": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op8_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9_simhash": "doc_id fingerprint component_id",
    "op10_language": "doc_id held_out lang_pred score",
    "op11_spelling_variants": "word form root n n_near form_n",
    "op12_embedding_whitening": "vec_id component n deviation whitened explained identity_error",
    "op13_shingle_join": "doc_id n_shingles component_id",
}
LONGS = "size text_crc32 slot n_words word_chars n_symbols n_dup_lines n_repeat_words start length ids_crc32 doc_tokens sequence_id offset n_assign n_access n_hex n_turns loss_chars formatted_chars n_hit n_items n n_near form_n deviation n_shingles"


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """The small tables, with nulls, empty and odd texts, repeated rows and extra columns of inner names added."""
    out = tmp_path_factory.mktemp("odd")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = [(900_001, None, "en", "s", 0), (900_002, "", None, None, 0), (900_003, "\t \n", "en", "s", 3), (900_004, "one two", "en", "s", 7), (900_004, "one two", "en", "s", 7), (900_005, "🙂" * 500, "fr", "s", 500)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs = docs.selectExpr("*", *[f"{i} AS `{c}`" for i, c in enumerate("row h line key n bucket old size shard slot scan tokens secrets language fingerprint class part first hash doc host _key".split())])
    docs.write.parquet(str(out / "documents.parquet"))
    for t in ("benchmark", "conversations", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(str(out / f"{t}.parquet"))
    return str(out), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def rows(spark, tables):
    found = {}

    def get(name):
        if name not in found:
            df = q.queries()[name](spark, tables[0])
            found[name] = (df.columns, dict(df.dtypes), df.collect())
        return found[name]

    return get


@pytest.mark.parametrize("name", sorted(HEADS))
def test_columns_and_types(rows, name):
    columns, types, _ = rows(name)
    head = HEADS[name].split()
    assert columns[: len(head)] == head
    assert all(types[c] == "bigint" for c in head if c in LONGS.split())
    assert all(types[c] == "boolean" for c in head if c in "base_failed kept contaminated held_out".split())
    assert all(types[c] == "int" for c in head if c in "shard grown_shard".split())


@pytest.mark.parametrize("name", ["op1_resharding", "op2_quality_rules", "op3_line_dedup", "op5_secrets", "op7_token_counts", "op8_decontamination", "op9_simhash", "op10_language", "op13_shingle_join"])
def test_each_document_once(rows, tables, name):
    assert sorted(r.doc_id for r in rows(name)[2]) == sorted(d for d, _ in tables[1])


def test_op1_law(rows, tables):
    _, _, got = rows("op1_resharding")
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in tables[1])
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) <= set(range(16)) and all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    loads = [sum(x["size"] for x in by[j]) for j in range(16)]
    assert max(loads) - min(loads) <= max(r["size"] for r in got)


def test_op4_pieces(rows, tables):
    from tokenizers import Tokenizer

    from terrainframe.llm import packing

    tok = Tokenizer.from_file(packing.default_path())
    want = defaultdict(int)
    for d, t in tables[1]:
        want[d] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    got, filled = defaultdict(int), defaultdict(list)
    for r in rows("op4_packing")[2]:
        got[r.doc_id] += r.length
        filled[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_op5_base_spans(rows, tables):
    want = defaultdict(list)
    for d, t in tables[1]:
        base = secrets.base_spans(t or "")
        want[d].append((tuple(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()))
    for r in rows("op5_secrets")[2]:
        assert ((r.n_assign, r.n_access, r.n_hex), r.base_sha256) in want[r.doc_id]
        own = [x for x in r.spans.split(",") if x and not x.startswith("crf")]
        assert hashlib.sha256(",".join(own).encode()).hexdigest() == r.base_sha256


def test_op6_turns_and_targets(spark, rows, sf_dir):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        by[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    by[-7] = [(0, "user", q.ODD_TEXT), (1, "assistant", q.ODD_TEXT)]
    _, _, got = rows("op6_chat_windows")
    assert sorted(r.conv_id for r in got) == sorted(by)
    for r in got:
        turns = sorted(by[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss)) and r.formatted_chars > 0
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    words = [w for w in words.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_op9_components(rows, tables):
    ids = sorted(tables[1], key=lambda x: x[0])
    marks = [brute_fingerprint(t) for _, t in ids]
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    want = sorted((ids[i][0], f"{marks[i]:016x}", ids[root(i)][0]) for i in range(len(ids)))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows("op9_simhash")[2]) == want


def test_op10_folds_and_accuracy(spark, rows, tables):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{tables[0]}/documents.parquet").select("doc_id", "lang").collect()}
    right = []
    for r in rows("op10_language")[2]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.doc_id in (900_001, 900_002, 900_003):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.held_out and r.doc_id < 900_000:
            right.append(r.lang_pred == lang[r.doc_id])
    assert sum(right) >= 0.95 * len(right)


def test_op7_counts(rows, tables):
    from terrainframe.llm import token_counts as tc

    model = tc.Unigram(tc.sentencepiece_vocabulary(tc.default_path()))
    assert sorted((r.doc_id, -1 if r.n_tokens is None else r.n_tokens) for r in rows("op7_token_counts")[2]) == sorted((d, -1 if t is None else model.count(t)[0]) for d, t in tables[1])


@pytest.mark.parametrize("name", ["op2_quality_rules", "op8_decontamination", "op11_spelling_variants", "op13_shingle_join"])
def test_same_rows_as_sql(rows, tables, name):
    """The registered SQL over the same odd rows."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables[0]}/{t}.parquet/*.parquet')")
    columns, _, got = rows(name)
    want = con.sql(q.oracle_sql()[name])
    order = [want.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, (tuple(r[i] for i in order) for r in want.fetchall())))


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_empty_tables(spark, sf_dir, tmp_path, name):
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    left = q.queries()[name](spark, str(tmp_path)).collect()
    assert [r.conv_id for r in left] == [-7] if name == "op6_chat_windows" else not left
