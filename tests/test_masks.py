import numpy as np

from terrainframe.operators import masks


def brute(m, least):
    """Flood from outside (all eight neighbours) for holes, side neighbours for objects, then dilation and erosion by a cross."""
    wide = np.pad(m, 4)
    out, todo = np.zeros(wide.shape, bool), [(0, 0)]
    while todo:
        r, c = todo.pop()
        if not (0 <= r < wide.shape[0] and 0 <= c < wide.shape[1]) or out[r, c] or wide[r, c]:
            continue
        out[r, c] = True
        todo += [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    full, seen = ~out, np.zeros(wide.shape, bool)
    for r, c in np.argwhere(full):
        if seen[r, c]:
            continue
        part, todo = [], [(r, c)]
        while todo:
            a, b = todo.pop()
            if full[a, b] and not seen[a, b]:
                seen[a, b] = True
                part.append((a, b))
                todo += [(a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)]
        if len(part) < least:
            for a, b in part:
                full[a, b] = False
    shift = lambda x, f: f([x, np.roll(x, 1, 0), np.roll(x, -1, 0), np.roll(x, 1, 1), np.roll(x, -1, 1)])
    return {(int(r) - 4, int(c) - 4) for r, c in np.argwhere(shift(shift(full, np.logical_or.reduce), np.logical_and.reduce))}


def test_cleaned_masks(spark):
    rng = np.random.default_rng(9)
    own = [rng.random((12, 14)) < p for p in (0.15, 0.4, 0.55, 0.7, 0.9)]
    rows = [(k, int(r), int(c)) for k, m in enumerate(own) for r, c in np.argwhere(m)]
    got = {}
    for r in masks.cleaned(spark.createDataFrame(rows, "pour_id long, row long, col long").repartition(3)).collect():
        got.setdefault(r.pour_id, set()).add((r.row, r.col))
    for k, m in enumerate(own):
        assert got.get(k, set()) == brute(m, masks.LEAST_CELLS), k
