"""Quality rules: text measures, and cross-document line frequency within a host. DataFrame functions only.

Lines are normalised (lower case, runs of other than letters and digits become one blank, trimmed) and hashed. For each host the
documents that hold a line are counted, equal texts once (or each row, with ``count_copies``: then copies of one text make all its lines
frequent, and all the copies are rejected; README has figures). A line held by more than ``max(min_docs, share * documents of
the host)`` is removed from the host's documents; a document with less than ``min_left`` of its normalised characters left
is rejected. Base rules reject before that: under 10 words, or over a fifth of the words in repeated 5-word windows.

Plan: (host, line, text) is made distinct before lines are counted, so one common line or host is summed in each task
first. A host has at most (mean lines a document) / share frequent lines, so they travel as one array per host; the
arrays are broadcast when there are at most ``BROADCAST_LINES`` lines in all. Beyond that they are joined by host and one of ``SALTS``
numbers, drawn from the text's hash, so that a hot host's texts go to as many tasks. The rows are the same either way. Texts are never
shuffled on the broadcast path.

Edge cases: a null text has no words and fails the base rules; a null host is a host of its own; blank lines are neither
counted nor removed; repeated rows are judged one by one. Input columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrainframe.llm.common import let, materialise

BLANKS = " \t\n\x0b\f\r"
WORD_BREAK = r"[ \x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW, MIN_DOCS, SHARE, MIN_LEFT, BROADCAST_LINES, SALTS = 5, 20, 0.02, 0.3, 200_000, 64
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_BREAK, -1), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the same array, each once. Sorting finds equal windows."""

    def covered(starts: Column) -> Column:
        gap = lambda i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1) - F.get(starts, i), F.lit(window)))
        return F.aggregate(F.sequence(F.lit(0), F.size(starts) - 1), F.lit(0).cast("long"), lambda n, i: n + gap(i))

    def starts_of(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        kept = lambda s: F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.when(j > 0, same(s, j, j - 1)).otherwise(False) | same(s, j, j + 1)), lambda j: F.get(s, j)["i"])
        return F.sort_array(let(placed, kept))

    def over(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(starts_of(h), covered)))

    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(over(words))


def measures(text: Column) -> dict[str, Column]:
    """The base measures of a text, as columns."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    full = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return {
        "n_words": F.size(words_of(text)).cast("long"),
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(words_of(text), lambda w: repeated_words(w)),
    }


def lines_of(text: Column) -> Column:
    """(hash, characters) of each line's normal form, in order."""
    normal = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " "), "\n", -1)
    return F.transform(normal, lambda x: let(F.trim(x), lambda y: F.struct(F.xxhash64(y).alias("h"), F.length(y).alias("n"))))


def frequent_lines(docs: DataFrame, text_col: str, host_col: str, min_docs: int, share: float, count_copies: bool = False) -> DataFrame:
    """(host, line): lines above their host's limit."""
    text, host = F.col(text_col).cast("string"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")
    given = docs.where(text.isNotNull()).select(host, F.xxhash64(text).alias("doc"), F.array_distinct(F.transform(F.filter(lines_of(text), lambda x: x.n > 0), lambda x: x.h)).alias("lines"))
    held = given.select("host", "doc", F.explode("lines").alias("line"))
    hosts = docs.where(text.isNotNull()).select(host, F.xxhash64(text).alias("doc"))
    if not count_copies:
        held, hosts = held.distinct(), hosts.distinct()
    counts = held.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    return counts.join(hosts.groupBy("host").agg(F.count("*").alias("docs")), "host").where(F.col("n") > F.col("docs") * share).select("host", "line")


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, min_left: float = MIN_LEFT, count_copies: bool = False) -> DataFrame:
    """``docs`` with the measures, base_failed, n_removed_lines, clean_text (without removed lines) and kept."""
    added = [*MEASURES, "base_failed", "n_removed_lines", "clean_text", "kept"]
    keep = [c for c in docs.columns if c not in added or c in (text_col, host_col)]
    found = materialise(frequent_lines(docs, text_col, host_col, min_docs, share, count_copies), "frequent-lines")
    by_host = found.groupBy("host").agg(F.collect_list("line").alias("frequent"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    row = row.withColumn("host", F.coalesce(F.col(f"row.`{host_col}`").cast("string"), F.lit("")))
    if found.count() <= BROADCAST_LINES:
        joined = row.join(F.broadcast(by_host), "host", "left")
    else:
        salted = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = row.withColumn("salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    left = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + x.n)
    rare = lambda x: ~F.array_contains(F.col("frequent"), x.h)

    def outcome(lines: Column) -> Column:
        kept = F.filter(lines, rare)
        shown = F.transform(F.filter(F.arrays_zip(F.split(text, "\n", -1).alias("t"), lines.alias("l")), lambda z: (z.l.n == 0) | rare(z.l)), lambda z: z.t)
        return F.struct((F.size(lines) - F.size(F.filter(lines, lambda x: (x.n == 0) | rare(x)))).cast("long").alias("removed"), left(kept).alias("left"), left(lines).alias("all"), F.array_join(shown, "\n").alias("text"))

    none = F.struct(F.lit(0).cast("long").alias("removed"), F.lit(1).cast("long").alias("left"), F.lit(1).cast("long").alias("all"), text.alias("text"))
    measured = joined.select("row", *[c.alias(k) for k, c in measures(text).items()], F.when(F.col("frequent").isNull(), none).otherwise(let(lines_of(text), outcome)).alias("cut"))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return measured.select(
        *[F.col(f"row.`{c}`") for c in keep if c not in added or c in (text_col, host_col)], *MEASURES, failed.alias("base_failed"), F.col("cut.removed").alias("n_removed_lines"), F.col("cut.text").alias("clean_text"),
        (~failed & (F.col("cut.left") >= F.col("cut.all") * min_left)).alias("kept"),
    )
