"""Viterbi over many sequences at once: step t advances every sequence that is longer than t, in one array operation."""

from __future__ import annotations

import numpy as np

CELLS = 4_000_000


def viterbi(scores: np.ndarray, lengths: np.ndarray, change: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Best labels of sequences laid end to end.

    ``scores`` (total, labels), ``lengths`` of the sequences, ``change[i, j]`` added from label i to j, ``start`` added at
    the first place. Ties go to the lower label. Memory is two bytes a place and label beyond the scores, and at most about
    ``CELLS`` numbers for one step.
    """
    total, labels = scores.shape
    out = np.zeros(total, np.int16)
    if not total:
        return out
    order = np.argsort(-lengths, kind="stable")
    at = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    longest = int(size[0])
    active = np.searchsorted(-size, -np.arange(longest), side="left")
    back = np.zeros((total, labels), np.int8 if labels < 128 else np.int16)
    best = scores[at[: active[0]]] + (0 if start is None else start)
    final = np.zeros((len(size), labels), best.dtype)
    lane = np.arange(labels)
    for t in range(1, longest):
        n = active[t]
        if n < len(best):
            final[n : len(best)] = best[n:]
            best = best[:n]
        some = max(1, CELLS // (labels * labels))
        new = scores[at[:n] + t]
        for a in range(0, n, some):
            step = best[a : a + some, :, None] + change
            back[at[a : min(n, a + some)] + t] = came = step.argmax(1)
            new[a : a + some] += step[np.arange(len(came))[:, None], came, lane]
        best = new
    final[: len(best)] = best
    label = final.argmax(1)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        here = label[:n]
        place = at[:n] + t
        out[place] = here
        label[:n] = back[place, here]
    return out
