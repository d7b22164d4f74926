"""Harmonic packing of token ids into sequences of a fixed capacity.

Class k holds pieces of at most ``capacity // k`` tokens, k of which fill a sequence. Each document is cut, without looking at
any other: whole capacities first; then a remainder that would leave more than ``waste`` of its slot empty gives up a
head of exactly the next class's slot, until the rest fits. So workers cut independently, and a class's sequences are
filled by count alone: the piece with running number i in class k goes to the class's sequence i div k. Classes go up to the capacity:
4,096 pieces of one token fill a sequence. The last, partly filled sequence of each class (fewer than k pieces, so about
``3 * capacity * log(capacity) / 2`` pieces in all at most, whatever the input) is refilled by best fit on the driver.

Plan: one pass tokenizes and writes pieces (numbered by partition and class); counts by (partition, class) are summed over
partitions by a window inside each class; offsets come from a window over one sequence's pieces. Only piece rows are
shuffled, never texts. The tokenizer file's path is a parameter, read on the executors.

A text is tokenized through a memo of its blank-separated chunks, which is exact where the tokenizer's pattern can't cross
blanks and its normaliser changes no character of the chunk but case; any text with a character outside plain Latin or
with a special token's mark goes through the tokenizer whole. Only a tokenizer file whose normaliser, pattern and kind of model are those of
``CHUNKED`` takes this way; the texts of any other go through its tokenizer whole.

Edge cases: a null text is empty and still gives its end token; equal rows are packed one by one; a null doc_id is kept.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrainframe.llm.common import LONG, forget_long, materialise

MEMO, SLICE = 500_000, 4_000_000
#: Characters for which chunk-wise tokenization is the same: no control or special white space, nothing the NFC form changes.
_ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-įĲ-ɏ]|<\\|")


#: Parts of a tokenizer file for which chunks are exact (fixed values).
CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: The same pattern for plain text in lower case.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def cuts(length: int, capacity: int = 4096, waste: float = 0.02) -> list[tuple[int, int]]:
    """(tokens, class) of a document's pieces, in order."""
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        slot = capacity // k
        if rest >= slot * (1 - waste):
            out.append((rest, k))
            break
        head = capacity // (k + 1)
        out.append((head, k + 1))
        rest -= head
    return out


def byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: printable Latin bytes stand for themselves, the others for 256 and up, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


class Chunks:
    """Token ids (little-endian unsigned 32 bits) of texts, through a memo of blank-separated chunks.

    The memo has two generations of at most ``MEMO`` chunks of ``LONG`` characters: what is used again moves to the young one, so frequent chunks stay.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.chunked = all(spec.get(k) == v for k, v in CHUNKED.items()) and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback")) and all("<|" in t["content"] for t in spec["added_tokens"])
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.lower: dict[str, bytes] = {}
        self.lower_new: list[str] = []
        self.ends = dict(zip(".,", self.whole([".", ","]), strict=True)) | {"": b""} if self.chunked else {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word(self, low: str) -> bytes:
        """A run of letters in lower case is one unit of the pattern, so the merges alone decide."""
        shown = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def learn(self, new: set[str]) -> None:
        """Letters with at most one point or comma after them go by their lower case form, other plain chunks by the pattern's parts."""
        memo, lower, others = self.memo, self.lower, []
        if len(lower) > MEMO:
            lower.clear()
        for w in new:
            end = w[-1] if w[-1] in ".," else ""
            core = w[:-1] if end else w
            if core.isalpha():
                low = core.lower()
                ids = lower.get(low)
                if ids is None:
                    lower[low] = ids = self.word(low)
                    self.lower_new.append(low)
                memo[w] = ids + self.ends[end]
            else:
                others.append(w)
        rest = []
        for w in others:
            if w.isascii():
                memo[w] = b"".join(map(self.part, PARTS.findall(w.lower())))
            else:
                rest.append(w)
        memo.update(zip(rest, self.whole(rest), strict=True))

    def part(self, part: str) -> bytes:
        ids = self.lower.get(part)
        if ids is None:
            self.lower[part] = ids = self.word(part) if part.isalpha() else self.whole([part])[0]
            self.lower_new.append(part)
        return ids

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.chunked:
            return self.whole(texts)
        odd = [i for i, t in enumerate(texts) if _ODD.search(t)]
        apart = set(odd)
        words = [[] if i in apart else t.split() for i, t in enumerate(texts)]
        distinct = set().union(*words)
        new = distinct.difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.old, self.memo, new = self.memo, {}, distinct
        again = new.intersection(self.old)
        self.memo.update({w: self.old[w] for w in again})
        self.learn(new - again)
        get = self.memo.__getitem__
        out = [b"".join(map(get, w)) for w in words]
        for i, x in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            out[i] = x
        forget_long(self.memo, distinct)
        forget_long(self.lower, [w for w in self.lower_new if len(w) > LONG])
        self.lower_new.clear()
        return out


_ONE: dict[str, Chunks] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(texts: list[str], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, tokenizer_path: str | None, with_ids: bool) -> DataFrame:
    """One row per piece, numbered by (partition, class)."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = given.schema["doc_id"].dataType
    fields = "start long, length long, ids_crc32 long, doc_tokens long, class int, part int, number long" + (", ids binary" if with_ids else "")
    schema = T.StructType([T.StructField("doc_id", id_type), *T._parse_datatype_string(fields).fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path or default_path()
        if path not in _ONE:
            _ONE[path] = Chunks(path)
        chunks, part, seen = _ONE[path], TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4").tobytes()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * with_ids]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                rows, at = [], []
                for j, ids in enumerate(chunks.ids(texts[a:b])):
                    ids += end
                    n, start = len(ids) // 4, 0
                    for length, k in cuts(n, capacity):
                        own = ids[4 * start : 4 * (start + length)]
                        seen[k] = number = seen.get(k, -1) + 1
                        rows.append((start, length, zlib.crc32(own), n, k, part, number, *[own] * with_ids))
                        at.append(a + j)
                        start += length
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], names=schema.names)

    return given.mapInArrow(cut, schema)


def best_fit(left: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """(class, number, length) of what is left over -> (class, number, bin); longest first, into the fullest bin with room."""
    room: list[tuple[int, int]] = []
    out, bins = [], 0
    for k, number, length in sorted(left, key=lambda x: (-x[2], x[0], x[1])):
        i = bisect_left(room, (length, -1))
        if i < len(room):
            free, b = room.pop(i)
        else:
            free, b, bins = capacity, bins, bins + 1
        insort(room, (free - length, b))
        out.append((k, number, b))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class (and ids, as bytes)."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, id_col, text_col, capacity, end_id, tokenizer_path, with_ids), "pieces")
    counts = cut.groupBy("class", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    whole = {r["class"]: r.n // r["class"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    first, total = {}, 0
    for k in sorted(whole):
        first[k], total = total, total + whole[k]
    classes = spark.createDataFrame([(k, first[k], whole[k]) for k in sorted(whole)], "class int, first long, full long")
    numbered = cut.join(bases, ["class", "part"]).join(F.broadcast(classes), "class").withColumn("number", F.col("base") + F.col("number"))
    in_full = F.col("number") < F.col("full") * F.col("class")
    left = [(r["class"], r.number, r.length) for r in numbered.where(~in_full).select("class", "number", "length").collect()]
    rest = spark.createDataFrame([(k, n, total + b) for k, n, b in best_fit(left, capacity)], "class int, number long, refilled long")
    placed = numbered.join(F.broadcast(rest), ["class", "number"], "left").withColumn("sequence_id", F.coalesce("refilled", F.col("first") + F.floor(F.col("number") / F.col("class"))))
    inside = Window.partitionBy("sequence_id").orderBy("class", "number").rowsBetween(Window.unboundedPreceding, -1)
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"), "class"]
    return placed.select(*out, *["ids"] * with_ids)
