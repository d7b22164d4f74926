"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans of mixed text.

Model: for each learned language, log probabilities of hashed letter trigrams (words in lower case between marks), learned
from at most ``PER_LANGUAGE`` labelled documents of each language, drawn by the hash of their id and text; a word's score for a
language is the sum over its trigrams. Scripts that hold under ``SCRIPT_SHARE`` of a language's letters rule it out for all words
with a letter of that script, unless no language is left. Labels of consecutive words are decoded by Viterbi with a fixed penalty for a
switch; spans are its runs, and the text's language is the one whose spans hold most letters, ``score`` their share.

Plan: a count of the labels, one pass that draws and counts trigrams (summed by language before the shuffle), one Arrow
UDF over the texts. Counts go to the driver as one row per language: ``BUCKETS`` numbers times the number of languages.

Edge cases: text that is null or without a letter is ``und`` with score 0; ties go to the first language by name; rows whose
label is null, and labels in no training document, are not learned; without any label every text is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrainframe.llm.common import forget_long
from terrainframe.llm.lockstep import viterbi
from terrainframe.llm.packing import slices

PER_LANGUAGE, BUCKETS, SWITCH, SCRIPT_SHARE, MEMO, SLICE = 3000, 1 << 16, 8.0, 0.01, 400_000, 1_500_000
#: First code points of script ranges (fixed values, Unicode blocks) and the script from there on.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0F00, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0x10000, "Other"), (0x20000, "Han"),
]
NAMES = sorted({s for _, s in SCRIPTS})
_STARTS = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([NAMES.index(s) for _, s in SCRIPTS])
WORD = re.compile(r"[^\W\d_]+")


LATIN = NAMES.index("Latin")


def scripts_of(word: str) -> list[int]:
    """The scripts of the word's letters, of which most are of the first."""
    if word.isascii():
        return [LATIN]
    found = _SCRIPT[np.searchsorted(_STARTS, np.fromiter(map(ord, word), np.int64, len(word)), side="right") - 1]
    counts = np.bincount(found, minlength=len(NAMES))
    return [int(k) for k in np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the words laid end to end, and where each word's begin (a word of n letters has n)."""
    text = "\x02" + "\x02\x02".join(words) + "\x02"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    hashed = (mixed >> np.uint32(16)) & np.uint32(BUCKETS - 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 2) - (lengths + 2)
    keep = np.ones(len(hashed), bool)
    inner = starts[1:]
    keep[inner - 2] = keep[inner - 1] = False
    return hashed[keep].astype(np.int64), np.cumsum(lengths) - lengths


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, trained: Column, per_language: int) -> DataFrame:
    """At most about ``per_language`` rows a language, by the hash of id and text; all rows of a language that has fewer."""
    known = docs.where(trained & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(per_language / n)) for k, n in counts.items()], F.lit(0.0)) if counts else F.lit(0.0)
    return known.where(F.pmod(F.xxhash64("i", "text"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", trained: Column | None = None, per_language: int = PER_LANGUAGE) -> dict:
    """Languages, their trigram log probabilities (buckets, languages) and which scripts they use."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        letters: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w for w in WORD.findall(text.lower()) if any(map(str.isalpha, w))]
                if words:
                    found = np.bincount(trigrams(words)[0], minlength=BUCKETS)
                    grams[lang] = grams.get(lang, 0) + found
                    own = letters.setdefault(lang, np.zeros(len(NAMES), np.int64))
                    for w in words:
                        own[scripts_of(w)[0]] += len(w)
        for lang, own in grams.items():
            full = np.concatenate((letters[lang], own))
            used = np.flatnonzero(full)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used), pa.array(full[used])], names=["lang", "cell", "n"])

    rows = training_rows(docs, id_col, text_col, lang_col, F.lit(True) if trained is None else trained, per_language)
    summed = rows.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("counts")).collect()
    langs = sorted(r.lang for r in summed)
    full = np.zeros((len(NAMES) + BUCKETS, len(langs)))
    for r in summed:
        full[np.array(r.cells), langs.index(r.lang)] = r.counts
    letters, grams = full[: len(NAMES)], full[len(NAMES) :] + 0.1
    uses = letters >= SCRIPT_SHARE * np.maximum(letters.sum(0), 1)
    uses[~uses.any(1)] = True
    return {"key": uuid4().hex, "langs": langs, "grams": np.log(grams / grams.sum(0)).astype(np.float32), "uses": uses}


class Labeller:
    """Word scores are kept in a memo; the decoder runs over many texts at once."""

    def __init__(self, model: dict, switch: float):
        self.model, self.memo = model, {}
        self.bars: dict[tuple[int, ...], np.ndarray] = {}
        n = len(model["langs"])
        self.change = (np.float32(-switch) * (1 - np.eye(n))).astype(np.float32)
        self.rows, self.size = np.zeros((0, n), np.float32), np.zeros(0, np.int32)

    def barred(self, word: str) -> np.ndarray:
        """What a language loses that hardly uses one of the word's scripts (of its first, if that would leave none)."""
        scripts = tuple(scripts_of(word))
        if scripts not in self.bars:
            uses = self.model["uses"][list(scripts)].all(0)
            self.bars[scripts] = np.float32(1e4) * ~(uses if uses.any() else self.model["uses"][scripts[0]])
        return self.bars[scripts]

    def learn(self, words: set[str]) -> None:
        if len(self.rows) + len(words) > MEMO:
            self.memo, self.rows, self.size = {}, self.rows[:0], self.size[:0]
        new = list(words.difference(self.memo))
        if not new:
            return
        low = [x if len(x := w.lower()) == len(w) else w for w in new]
        hashed, starts = trigrams(low)
        scores = np.add.reduceat(self.model["grams"][hashed], starts, axis=0)
        scores -= np.array([self.barred(w) for w in new])
        self.memo.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.concatenate((self.rows, scores))
        self.size = np.concatenate((self.size, np.array([sum(map(str.isalpha, w)) for w in new], np.int32)))

    def label(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, numbers of words, labels and letters of all words laid end to end."""
        words = [WORD.findall(t) for t in texts]
        known = set().union(*words)
        self.learn(known)
        get = self.memo.__getitem__
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        rows = np.fromiter((x for w in words for x in map(get, w)), np.int64, int(lengths.sum()))
        forget_long(self.memo, known)
        busy = lengths > 0
        labels = viterbi(self.rows[rows], lengths[busy], self.change)
        return words, lengths, labels, self.size[rows]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        langs = self.model["langs"]
        if not langs:
            return [("und", 0.0)] * len(texts)
        _, lengths, labels, letters = self.label(texts)
        owner = np.repeat(np.arange(len(texts)), lengths)
        held = np.bincount(owner * len(langs) + labels, weights=letters, minlength=len(texts) * len(langs)).reshape(len(texts), len(langs))
        total, top = held.sum(1), held.argmax(1)
        return [(langs[k], float(held[i, k] / n)) if n else ("und", 0.0) for i, (k, n) in enumerate(zip(top, total, strict=True))]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) in code points: runs of words with one label."""
        found = list(WORD.finditer(text))
        if not found or not self.model["langs"]:
            return []
        _, _, labels, _ = self.label([text])
        edges = [0, *(np.flatnonzero(np.diff(labels)) + 1), len(found)]
        return [(found[a].start(), found[b - 1].end(), self.model["langs"][labels[a]]) for a, b in zip(edges, edges[1:], strict=False)]


_ONE: dict[str, Labeller] = {}


def identify(docs: DataFrame, model: dict, text_col: str = "text", switch: float = SWITCH, with_spans: bool = False) -> DataFrame:
    """``docs`` with a struct column ``language``: lang_pred, score and, where asked for, spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = f"{model['key']}-{switch}"
    schema = "lang_pred string, score double" + ", spans array<struct<start:long,end:long,lang:string>>" * with_spans

    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _ONE:
            _ONE.clear()
            _ONE[key] = Labeller(shared.value, switch)
        own = _ONE[key]
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            found = [x for a, b in slices(texts, SLICE) for x in own.predict(texts[a:b])]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            if with_spans:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
                columns.append(pa.array([[{"start": a, "end": b, "lang": k} for a, b, k in own.spans(t)] for t in texts], kind))
            yield pa.StructArray.from_arrays(columns, names=["lang_pred", "score", "spans"][: len(columns)])

    return docs.drop("language").withColumn("language", F.arrow_udf(label, schema)(F.col(text_col).cast("string")))


def held_out(id_col: str) -> Column:
    """crc32 of the id's text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))

