"""Count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates every vocabulary piece that ends at a place; the dynamic program keeps, for each end, only the
best score and its number of pieces. Ties follow the public ``tokenizers`` Unigram model: for one end, candidates come by
increasing start and only a strictly better score replaces, so the longest last piece wins; a character without a piece of
its own costs the lowest score less ten and counts its UTF-8 bytes (byte fallback). Scores are doubles. As in that model, all
entries of the vocabulary match literal text, control and byte pieces (``<s>``, ``<0x41>``) included, at the score the file gives them.

Spaces become U+2581, and a text that does not begin with one gets one; every such mark begins a word, and pieces never cross a word or a line break
(checked against the vocabulary), so a text's count is the sum over its words and each distinct word is solved once a worker. A word
is cut first at each pair of characters that lies in no piece, in one loop; time grows with the length of a word, whatever it holds.

Plan: one Arrow UDF over the text column, no shuffle. The word memo holds ``MEMO`` words of at most ``LONG`` characters and is emptied when full.

Edge cases: a null text has null count and score; an empty text has 0 pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrainframe.llm.common import forget_long

MARK, UNKNOWN_PENALTY, MEMO = "▁", 10.0, 600_000
LOWEST = float("-inf")


class Unigram:
    """Vocabulary, its automaton and the memo of solved words."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.find = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.alone = {p for p, _ in pieces if len(p) == 1}
        self.inside = {p[i : i + 2] for p, _ in pieces for i in range(len(p) - 1)}
        crossing = any(MARK in p.lstrip(MARK) for p, _ in pieces)
        lines = any("\n" in p for p, _ in pieces)
        if crossing:
            raise ValueError("a piece crosses a word mark; texts can't be counted by words")
        self.words = re.compile(rf"{MARK}[^{MARK}]*" if lines else rf"{MARK}[^{MARK}\n]*|[^{MARK}\n]+|\n")
        self.memo: dict[str, tuple[int, float]] = {}

    def solve(self, word: str) -> tuple[int, float]:
        """A character pair inside no piece is a sure cut: its sides are solved apart, each different part once."""
        inside, cuts = self.inside, [0]
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in inside:
                cuts.append(i)
        if len(cuts) == 1:
            return self.solve_part(word)
        parts, n, score = {}, 0, 0.0
        for part in map(word.__getitem__, map(slice, cuts, [*cuts[1:], len(word)])):
            if part not in parts:
                parts[part] = self.memo.get(part) or self.solve_part(part)
            n, score = n + parts[part][0], score + parts[part][1]
        return n, score

    def solve_part(self, word: str) -> tuple[int, float]:
        """Matches come by end, then by start."""
        best, count = [0.0] + [LOWEST] * len(word), [0] * (len(word) + 1)
        done = 0 if not self.alone.issuperset(word) else len(word)
        for last, (length, score) in self.find.iter(word):
            end = last + 1
            while done < last:
                done = self.fall_back(word, done, best, count)
            score += best[end - length]
            if score > best[end]:
                best[end], count[end] = score, count[end - length] + 1
        while done < len(word):
            done = self.fall_back(word, done, best, count)
        return count[-1], best[-1]

    def fall_back(self, word: str, at: int, best: list[float], count: list[int]) -> int:
        """A character without a piece of its own is tried after all pieces that end with it."""
        if word[at] not in self.alone and best[at] + self.unknown > best[at + 1]:
            best[at + 1], count[at + 1] = best[at] + self.unknown, count[at] + len(word[at].encode())
        return at + 1

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(" ", MARK)
        words = self.words.findall(text if text[0] == MARK else MARK + text)
        memo = self.memo
        new = set(words).difference(memo)
        if new:
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = set(words)
            for w in new:
                memo[w] = self.solve(w)
        found = list(map(memo.__getitem__, words))
        forget_long(memo, new)
        return sum(n for n, _ in found), sum(s for _, s in found)


_ONE: dict[str, Unigram] = {}


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a public vocabulary file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """``docs`` with a struct column ``tokens``: n_tokens long, best_score double. ``model_path`` must be readable on the executors."""

    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        path = model_path or default_path()
        if path not in _ONE:
            _ONE[path] = Unigram(sentencepiece_vocabulary(path))
        model = _ONE[path]
        for texts in batches:
            out = [(None, None) if t is None else model.count(t) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.float64())], names=["n_tokens", "best_score"])

    return docs.drop("tokens").withColumn("tokens", F.arrow_udf(counts, "n_tokens long, best_score double")(F.col(text_col).cast("string")))
