"""Spelling variants by PartEnum signatures: words one inserted, deleted or replaced letter apart.

A word is a binary vector with one place for the k-th occurrence of each letter, so its ones are its multiset of letters. One edit
changes at most two places: a replaced letter takes one out and puts one in, an inserted letter puts one in. Places are dealt to ``PARTS``
parts. Of words of equal length at most two parts differ, of words whose lengths differ by one just one part does, so leaving out every two parts (or every one)
makes signatures of which such a pair shares at least one. The word's halves are the level above: an edit leaves one of them as it was, so a
signature holds the length, one half and the parts that aren't left out. It is exact: no near pair lacks a common signature.

Plan: runs are counted with partial sums in each task, and only distinct words of enough length and occurrences go on. A word gives
28 signatures of eight bytes; one equality join by signature verifies the edit distance as it
meets pairs, so only near pairs leave it. Pairs that share several signatures become one by an aggregation. Roots are found by
pointer doubling over the words that have a form; forms at least double the count, so chains are short.

Edge cases: a null or empty text has no words; a null id counts as empty; repeated rows count each; ties of a form go to the word that is smallest in code
points; an empty table gives no rows. A very long text is split in one task, as any row is.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrainframe.llm.common import discard, let, materialise

PARTS, LEAST_LENGTH, LEAST_COUNT, RATIO, SLIP_EVERY = 4, 5, 3, 2, 97
#: Letters from the commonest on, so that parts get about as many letters each.
COMMON_FIRST = "etaoinshrdlucmfwypvbgkqjxz"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SAME, SHORTER, LONGER = 0, 1, 2


def low(run: Column) -> Column:
    """A to Z in lower case and nothing else; only runs with other letters need the map."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip_every: int | None = SLIP_EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all runs of letters. ``slip_every``: where it divides the crc32 of ``<id>:<run>``, the run loses the letter at that crc32 modulo its length."""
    text = F.col(f"`{text_col}`").cast("string")
    key = F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(":"))
    runs = docs.where(text.isNotNull()).select(key.alias("key"), F.explode(F.split(text, "[^A-Za-zÀ-ÿ]+")).alias("run"))
    runs = runs.where(F.length("run") >= least_length).select("key", low(F.col("run")).alias("word"))
    if slip_every:
        marked = runs.select("word", F.crc32(F.concat("key", "word").cast("binary")).alias("h"), F.length("word").alias("n"))
        at = (F.col("h") % F.col("n")).cast("int")
        slipped = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.col("n")))
        runs = marked.select(F.when(F.col("h") % slip_every == 0, slipped).otherwise(F.col("word")).alias("word"))
    words = runs.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return words.where(F.col("n") >= least_count)


def letter_parts(word: Column) -> Column:
    """The letters of each part, in order: the places of the k-th occurrences of letters are dealt to parts by the letter's rank and k."""
    letters = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1))))

    def of_part(every: Column, part: int) -> Column:
        def inside(c: Column, i: Column) -> Column:
            rank, nth = F.instr(F.lit(COMMON_FIRST), c), i - F.array_position(every, c)
            return F.pmod(F.when(rank > 0, rank).otherwise(F.ascii(c)) + 3 * nth, F.lit(PARTS)) == part

        return F.array_join(F.filter(every, inside), "")

    return let(letters, lambda every: F.array(*[of_part(every, p) for p in range(PARTS)]))


def signed(words: DataFrame) -> DataFrame:
    """``words`` once for each signature: role (of equal length; the shorter; the longer of a pair) and key."""
    told = words.withColumn("parts", letter_parts(F.col("word")))
    size, word = F.length("word"), F.col("word")

    def keys(role: int, left_out: int, length: Column, halves: tuple[Column, Column]) -> list[Column]:
        kept = [[p for p in range(PARTS) if p not in gone] for gone in combinations(range(PARTS), left_out)]
        kind = 0 if role == SAME else 1
        return [
            F.struct(F.lit(role).alias("role"), F.xxhash64(F.lit(kind), F.lit(side), F.lit(k), length, half, *[F.col("parts")[p] for p in some]).alias("key"))
            for side, half in enumerate(halves) for k, some in enumerate(kept)
        ]

    split = lambda at, skip: (F.substring(word, F.lit(1), at), F.substring(word, at + skip + 1, size))
    same = keys(SAME, 2, size, split(F.floor(size / 2).cast("int"), 0))
    shorter = keys(SHORTER, 1, size, split(F.floor(size / 2).cast("int"), 0))
    longer = keys(LONGER, 1, size - 1, split(F.floor((size - 1) / 2).cast("int"), 1))
    return told.select("word", "n", F.explode(F.array(*same, *shorter, *longer)).alias("s")).select("word", "n", "s.role", "s.key")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs one edit apart, each in both directions."""
    a, b = signed(words).alias("a"), signed(words).alias("b")
    roles = (F.col("a.role") == SAME) & (F.col("b.role") == SAME) & (F.col("a.word") < F.col("b.word")) | (F.col("a.role") == SHORTER) & (F.col("b.role") == LONGER)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & roles & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1))
    once = met.groupBy(F.col("a.word").alias("x"), F.col("b.word").alias("y")).agg(F.first("a.n").alias("xn"), F.first("b.n").alias("yn"))
    ends = F.array(*[F.struct(F.col(p).alias("word"), F.col(f"{p}n").alias("n"), F.col(q).alias("near"), F.col(f"{q}n").alias("near_n")) for p, q in ("xy", "yx")])
    return once.select(F.inline(ends))


def roots(forms: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(word, root) from (word, form): the last word of each chain, by pointer doubling."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(most_rounds):
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        new = materialise(now.join(ahead, now.root == ahead["at"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        ended = new.where("moved").isEmpty()
        discard(now)
        now = new.drop("moved")
        now._terrainframe_path = new._terrainframe_path
        if ended:
            return now
    raise RuntimeError("roots: a chain of forms has no end")


def variants(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of each row of ``words`` (word, n; words are distinct)."""
    words = materialise(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best = near_pairs(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    form_n = -F.col("best.less")
    enough = form_n >= F.col("n") * ratio
    told = materialise(best.select("word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, form_n).alias("form_n")), "nearest-words")
    ends = roots(told.where("form IS NOT NULL").select("word", "form"))
    out = words.join(told, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
