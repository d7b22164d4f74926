"""The thin ``opN_<name>`` queries: each applies its operator with production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrainframe.llm import chat, decontamination, language, lines, packing, quality, resharding, secrets, shingle_join, simhash, spelling, token_counts, whitening
from terrainframe.llm.common import table


OLD_SHARDS, NEW_SHARDS = 24, 16


def op1_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 24 shards by a hash of the source, of which one is hot, to 16 of equal bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(OLD_SHARDS)).cast("int")
    given = table(spark, sf_dir, "documents")
    docs = given.select("doc_id", "text", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), old.alias("old_shard"))
    placed = resharding.rewritten(docs, "size", "old_shard", ["doc_id", "text_crc32"], NEW_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", *quality.MEASURES, "base_failed", "kept", "n_removed_lines")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("secrets", lambda s: s.kind != "crf")
    return found.select("doc_id", *map(count, secrets.KINDS[:3]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), count("crf"))


ODD_TEXT = "\\### Assistant: </turn> ok"


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT)], "conv_id long, turn long, role string, text string")
    read = chat.read_back(chat.windows(given.unionByName(odd)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "tokens.n_tokens", "tokens.best_score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scan = decontamination.scan_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return scan.select(
        "doc_id", "scan.n_words", "scan.n_hit",
        F.size("scan.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("scan.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("scan.n_hit") > 0).alias("contaminated"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out("doc_id")
    model = language.fit(docs, trained=~out)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "language.lang_pred", "language.score")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counted(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip("whitening.whitened", "whitening.explained")).alias("at", "of")
    told = found.select("vec_id", "whitening", each)
    return told.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "whitening.n", "whitening.deviation", "of.whitened", "of.explained", "whitening.identity_error")


def op13_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_resharding, op2_quality_rules, op3_line_dedup, op4_packing, op5_secrets, op6_chat_windows, op7_token_counts, op8_decontamination, op9_simhash, op10_language, op11_spelling_variants, op12_embedding_whitening, op13_shingle_join)}


_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, text AS raw FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 5)),
again AS (SELECT rid, g FROM win GROUP BY 1, 2 HAVING count(*) > 1),
hit AS (SELECT rid, count(DISTINCT i + k) AS n FROM win JOIN again USING (rid, g) CROSS JOIN (VALUES (0), (1), (2), (3), (4)) o(k) GROUP BY 1),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
nl AS (SELECT rid, trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM l),
held AS (SELECT host, t, count(DISTINCT raw) AS n FROM nl JOIN d USING (rid) WHERE raw IS NOT NULL AND t <> '' GROUP BY 1, 2),
hosts AS (SELECT host, count(DISTINCT raw) AS docs FROM d WHERE raw IS NOT NULL GROUP BY 1),
freq AS (SELECT host, t FROM held JOIN hosts USING (host) WHERE n > 20 AND n > docs * 0.02),
sums AS (SELECT rid, sum(length(nl.t)) AS all_, sum(CASE WHEN freq.t IS NULL THEN length(nl.t) ELSE 0 END) AS left_, count(freq.t) AS removed FROM nl JOIN d USING (rid) LEFT JOIN freq ON freq.host = d.host AND freq.t = nl.t GROUP BY 1),
m AS (SELECT d.doc_id, len(w.w) AS n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words, removed, left_ >= all_ * 0.3 AS enough
    FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN hit USING (rid) JOIN sums USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND enough AS kept, removed AS n_removed_lines FROM m
"""

_DECONTAMINATION = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n)),
found AS (SELECT rid, i, n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT rid, i, unnest(range(0, n)) AS k FROM found) GROUP BY 1),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""


#: The crc32 goes by half bytes through its table of sixteen entries (fixed values); words one edit apart share a word
#: with one letter less (of unlike lengths that is enough, else just one letter differs; by code points, as SQL's own distance counts bytes).
_SPELLING = r"""
WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT id, w, count(*) AS n, hex(encode(id || ':' || w)) AS x FROM r WHERE length(w) >= 5 GROUP BY 1, 2),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(x) + 1, 2), lambda i: [instr('0123456789ABCDEF', substr(x, i + 1, 1)) - 1, instr('0123456789ABCDEF', substr(x, i, 1)) - 1]))),
    lambda a, b: xor(a >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(a, b) & 15) + 1]))) AS h FROM c),
s AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cut AS (SELECT word, n, word AS k FROM v UNION SELECT word, n, substr(word, 1, i) || substr(word, i + 2) FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
p AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.k = b.k AND a.word <> b.word WHERE length(a.word) <> length(b.word) OR len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM p GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, coalesce(form, word) AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL),
root AS (SELECT chain.word, chain.at AS root FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN root USING (word)
"""

_SHINGLE_JOIN = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT a.rid AS a, b.rid AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
link AS (SELECT a, b FROM met JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * met.n >= 90 * (x.n + y.n - met.n)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS rid, a AS other FROM e UNION SELECT reach.rid, e.b FROM reach JOIN e ON e.a = reach.other),
least AS (SELECT reach.rid, min(d.doc_id) AS least FROM reach JOIN d ON d.rid = reach.other GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least, doc_id) AS component_id FROM d LEFT JOIN n USING (rid) LEFT JOIN least USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _QUALITY, "op8_decontamination": _DECONTAMINATION, "op11_spelling_variants": _SPELLING, "op13_shingle_join": _SHINGLE_JOIN}
