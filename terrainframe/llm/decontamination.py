"""Benchmark decontamination: one Aho-Corasick automaton over normalised test texts, each document scanned once.

Normal form: A-Z become a-z, words are runs of letters, digits and non-ASCII characters. The automaton's symbols are words, by
their number in the benchmark's vocabulary (0 for all others). Every window of ``window`` consecutive item words (an item with fewer words
is one window) is a pattern. A hit's words map back to the original text through the places of the words.

Plan: no shuffle. The benchmark is read in blocks of at most ``max_windows`` windows, so at most ``window * max_windows`` automaton nodes (some
70 bytes each: 300 MB for the default). A benchmark of one block (about 400,000 words) is scanned within the pass over the
documents. Each further block scans the written result of the block before in a pass of its own, so a worker holds one automaton at a time
and the driver one block.

Edge cases: a null or wordless text has no words and no hits; a null or wordless item has no window; the words of an item without
an id are hit, but it has no name to be listed or counted under; equal items each count; equal documents give equal rows; an empty
benchmark hits nothing. An input column ``scan`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrainframe.llm.common import materialise

#: A word's bytes as they are or in lower case, all others a space.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SCAN = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, hits array<struct<first:long,last:long>>"
MAX_WINDOWS = 400_000


class Benchmark:
    """Vocabulary and automaton of one block of items, given as (id or none, text)."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.words: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in text.translate(TABLE).split()]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                own = owners.setdefault(tuple(ids[i : i + window]), set())
                if item is not None:
                    own.add(item)
        self.find = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, ids in owners.items():
            self.find.add_word(w, (len(w), tuple(ids)))
        if owners:
            self.find.make_automaton()
        self.shortest = min(map(len, owners), default=0)


_ONE: dict[str, Benchmark] = {}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Inclusive intervals, sorted and joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan_text(text: bytes, against: Benchmark, before: dict | None = None) -> dict:
    """Words and hit word intervals of one text; ``spans`` are the intervals' code points in the original, end exclusive."""
    plain = text.translate(TABLE)
    words = plain.split()
    hits: list[tuple[int, int]] = [(h["first"], h["last"]) for h in before["hits"]] if before else []
    items: set[str] = set(before["items"]) if before else set()
    if len(against.find) and len(words) >= against.shortest:
        known = against.words
        for last, (n, ids) in against.find.iter(tuple([known.get(w, 0) for w in words])):
            if not hits or hits[-1] != (last - n + 1, last):
                hits.append((last - n + 1, last))
            items.update(ids)
    hits = merged(hits)
    spans: list[dict] = []
    if hits:
        used = np.frombuffer(plain, np.uint8) != 32
        edge = np.flatnonzero(np.diff(np.concatenate(([0], used.view(np.int8), [0]))))
        chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
        spans = [{"start": int(chars[edge[2 * a]]), "end": int(chars[edge[2 * b + 1]])} for a, b in hits]
    return {"n_words": len(words), "n_hit": sum(b - a + 1 for a, b in hits), "items": sorted(items), "spans": spans, "hits": [{"first": a, "last": b} for a, b in hits]}


def _scanner(shared, key: str, window: int, again: bool):
    none = {"n_words": 0, "n_hit": 0, "items": [], "spans": [], "hits": []}
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("hits", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])

    def rows(texts: pa.Array, before: list | None) -> pa.Array:
        if key not in _ONE:
            _ONE.clear()
            _ONE[key] = Benchmark(shared.value, window)
        against, texts = _ONE[key], texts.cast(pa.binary())
        out = [none if not t.is_valid else scan_text(t.as_py(), against, before[i] if before else None) for i, t in enumerate(texts)]
        return pa.array(out, kind)

    if again:

        def scan_again(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for texts, before in batches:
                yield rows(texts, before.to_pylist())

        return F.arrow_udf(scan_again, SCAN)

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield rows(texts, None)

    return F.arrow_udf(scan, SCAN)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, max_windows: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items (id, text) in blocks of at most ``max_windows`` windows. An item of more is cut into runs of words that share ``window - 1`` words."""
    word, id_ = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", F.col(item_col).cast("string").alias("id")
    words = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(word), F.lit(0))
    parts = benchmark.select(id_, words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(max_windows))
    cut = parts.select("id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, max_windows + window - 1))).alias("w"))
    sized = cut.select("id", F.array_join("w", " ").cast("binary").alias("t"), F.greatest(F.size("w") - window + 1, F.lit(1)).cast("long").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    if total <= max_windows:
        yield [(r.id, bytes(r.t)) for r in sized.collect()]
        return
    own: list[tuple[str | None, bytes]] = []
    size = 0
    for r in sized.toLocalIterator():
        if own and size + r.n > max_windows:
            yield own
            own, size = [], 0
        own.append((r.id, bytes(r.t)))
        size += r.n
    yield own


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with a struct column ``scan``: n_words, n_hit, items (ids of items that occur), spans (in the original), hits (in words)."""
    sc = docs.sparkSession.sparkContext
    out = docs.drop("scan")
    for k, items in enumerate(blocks(benchmark, item_col, item_text_col, window, max_windows)):
        if k:
            out = materialise(out, "scanned-block")
        udf = _scanner(sc.broadcast(items), uuid4().hex, window, k > 0)
        out = out.withColumn("scan", udf(F.col(text_col).cast("string"), *["scan"] * (k > 0)))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no window of the benchmark, columns as they were whatever their names (the pipeline's decision)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return scan_benchmark(rows, benchmark, "text", **options).where(F.coalesce(F.col("scan.n_hit"), F.lit(0)) == 0).select("row.*")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its hit spans, for those who cut passages rather than drop documents."""
    ends = [0, *[x for s in spans for x in s], len(text)]
    return "".join(text[a:b] for i, (a, b) in enumerate(pairwise(ends)) if i % 2 == 0)
