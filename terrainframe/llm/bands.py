"""Signatures of texts: hashed shingles, MinHash bands, parity sketches and exact Jaccard similarity, over arrays of many texts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrainframe.llm.packing import slices

SHINGLE, BANDS, ROWS = 5, 8, 4
#: Most words of a sketch, as a power of two.
MOST_WORDS = 10
#: Characters at a time for signatures: arrays that stay in a core's cache.
SLICE = 200_000
_RNG = np.random.default_rng(97)
_PERMS = _RNG.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def mixed(codes: np.ndarray, factor: int) -> np.ndarray:
    """Hashes of all runs of ``SHINGLE`` code points."""
    n = len(codes) - SHINGLE + 1
    out = codes[:n].copy()
    for k in range(1, SHINGLE):
        out = (out ^ (out >> np.uint32(15))) * np.uint32(factor) + codes[k : n + k]
    out = (out ^ (out >> np.uint32(16))) * np.uint32(0x7FEB352D)
    out = (out ^ (out >> np.uint32(15))) * np.uint32(0x846CA68B)
    return out ^ (out >> np.uint32(16))


def shingles(texts: list[str], wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shingles of the texts laid end to end (32 bits, or 64 if ``wide``), and where each text's begin."""
    padded = [t if len(t) >= SHINGLE else t.ljust(SHINGLE, "\x00") for t in texts]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    found = mixed(codes, 0x2C1B3C6D)
    if wide:
        found = found.astype(np.uint64) | mixed(codes, 0x165667B1).astype(np.uint64) << np.uint64(32)
    ends = np.cumsum(lengths)
    keep = np.ones(len(found), bool)
    for k in range(1, SHINGLE):
        keep[ends[:-1] - k] = False
    counts = lengths - SHINGLE + 1
    return found[keep], np.cumsum(counts) - counts


def signature(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Least permuted hash of each text; (texts, permutations)."""
    out = np.empty((len(starts), len(_PERMS)), np.uint32)
    for k, factor in enumerate(_PERMS):  # the hashes are mixed already, so an odd factor is a permutation that is random enough
        out[:, k] = np.minimum.reduceat(hashes * factor, starts)
    return out


def bands(sign: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` values, the band's number mixed in."""
    parts = sign.reshape(len(sign), -1, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for r in range(rows):
        key = (key ^ parts[:, :, r]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketches(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of distinct shingles of each text; the words of its sketch laid end to end, and how many it has.

    A sketch has a power of two of slots, 256 or no fewer than there are shingles, and holds each slot's parity. The first bits of a
    hash are the word, the last six the bit, so neighbouring words of a sketch add up (xor) to one of half the size.
    """
    counts, numbers = np.diff(np.append(starts, len(hashes))), np.arange(len(starts), dtype=np.uint64)
    owned = np.repeat(numbers << np.uint64(32), counts)
    owned |= hashes
    owned.sort()
    owned = owned[np.append(True, owned[1:] != owned[:-1])]
    sizes = np.bincount((owned >> np.uint64(32)).astype(np.int64), minlength=len(starts))
    power = np.clip(np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64) - 6, 2, MOST_WORDS)
    words = np.int64(1) << power
    ends = np.cumsum(words)
    if power.min() == power.max():  # a text's number and the first bits of the hash are its word's place
        at = owned >> np.uint64(32 - power[0])
    else:
        at = owned >> np.repeat((32 - power).astype(np.uint64), sizes)
        at += np.repeat((ends - words).astype(np.uint64) - (numbers << power.astype(np.uint64)), sizes)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    out = np.zeros(int(ends[-1]), np.uint64)
    owned &= np.uint64(63)
    out[at[first].astype(np.int64)] = np.bitwise_xor.reduceat(np.left_shift(np.uint64(1), owned, out=owned), first)
    return sizes, out, words


class Reach:
    """Whether sizes and sketches leave it open that two texts are alike: slots that differ are no more than the shingles that do.

    Sketches and sizes are of 32-bit hashes. Two shingles of one text share such a hash about n * n / 2**33 times, so true sizes may be larger by a few: by more than ``slack``
    for some one in 10**12 texts.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray, lengths: np.ndarray, threshold: float):
        self.sizes, self.words, self.lengths, self.threshold = sizes, words, lengths, threshold
        self.starts, self.apart = np.cumsum(lengths) - lengths, (1 - threshold) / (1 + threshold)
        shared = sizes.astype(float) ** 2 / 2.0**33
        self.slack = 1 + (sizes > 300) + 2 * (sizes > 3000) + shared + 8 * np.sqrt(shared)
        self.short = self.folded(np.arange(len(sizes)), 4)

    def folded(self, rows: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(rows), width), np.uint64)
        for n in np.unique(self.lengths[rows]):
            own = np.flatnonzero(self.lengths[rows] == n)
            out[own] = np.bitwise_xor.reduce(self.words[self.starts[rows[own]][:, None] + np.arange(n)].reshape(len(own), width, n // width), axis=2)
        return out

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Positions of the pairs that may be alike."""
        a, b = self.sizes[i], self.sizes[j]
        slack = np.maximum(self.slack[i], self.slack[j])
        left = np.flatnonzero(np.minimum(a, b) + slack >= self.threshold * np.maximum(a, b))
        most = self.apart * (a + b + 2 * slack) + 1e-6
        left = left[np.bitwise_count(self.short[i[left]] ^ self.short[j[left]]).sum(1, dtype=np.int64) <= most[left]]
        width = np.minimum(self.lengths[i[left]], self.lengths[j[left]])
        keep = [left[width == 4]]
        for n in np.unique(width[width > 4]):
            some = left[width == n]
            for k in range(0, len(some), step := max(1, 4_000_000 // int(n))):
                part = some[k : k + step]
                rows, at = np.unique(np.concatenate((i[part], j[part])), return_inverse=True)
                full = self.folded(rows, int(n))
                keep.append(part[np.bitwise_count(full[at[: len(part)]] ^ full[at[len(part) :]]).sum(1, dtype=np.int64) <= most[part]])
        return np.concatenate(keep)


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets of shingles have at least that Jaccard similarity, compared in whole thousandths."""
    share = round(1000 * threshold)
    if 1000 * min(len(a), len(b)) < share * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 1000 * both >= share * (len(a) + len(b) - both)


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Exact Jaccard similarity of each of ``a`` with each of a few ``b``; all are sorted sets."""
    slots = np.unique(np.concatenate(b))
    has = np.zeros((len(slots) + 1, len(b)), np.int8)
    for k, x in enumerate(b):
        has[np.searchsorted(slots, x), k] = 1
    sizes = np.fromiter(map(len, a), np.int64, len(a))
    flat = np.concatenate(a)
    at = np.searchsorted(slots, flat)
    at[slots[np.minimum(at, len(slots) - 1)] != flat] = len(slots)
    both = np.add.reduceat(has[at], np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)
    return both / (sizes[:, None] + np.fromiter(map(len, b), np.int64, len(b))[None, :] - both)


def with_bands(lines: DataFrame, cut: Callable = shingles) -> DataFrame:
    """``lines`` with ``bands``: the band keys, then the number of distinct shingles and the words of the sketch."""

    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts, out, widths = batch.to_pylist(), [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
            for a, b in slices(texts, SLICE):
                hashes, starts = cut(texts[a:b])
                sizes, words, lengths = sketches(hashes, starts)
                width = lengths + BANDS + 1
                flat, ends = np.zeros(int(width.sum()), np.int64), np.cumsum(width)
                flat[(ends - width)[:, None] + np.arange(BANDS + 1)] = np.column_stack((bands(signature(hashes, starts), ROWS), sizes))
                flat[np.repeat(ends - np.cumsum(lengths), lengths) + np.arange(len(words))] = words.view(np.int64)
                out.append(flat)
                widths.append(width)
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(widths)).astype(np.int32)), pa.array(np.concatenate(out)))

    return lines.withColumn("bands", F.arrow_udf(keys, "array<long>")("line"))
