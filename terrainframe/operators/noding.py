"""Noding and rays for shapes of few edges: a task's shapes are worked on together, by the arithmetic of ``overlay`` on whole columns.

Rows come by shape. Shapes are taken in passes, so what a pass holds is bounded by ``PAIRS`` and one shape's own: its edges are at most some hundred.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rays run along a slant that no edge of round coordinates has.
SLANT = 0.6180339887498949
#: Rows that a task gathers before it works on them, and pairs that are looked at together.
ROWS, PAIRS = 200_000, 1_000_000
Columns = dict[str, np.ndarray]


def spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each element of ranges of ``counts`` elements: its range and its place there."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def passes(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of ranges with at most ``most`` elements, or one range."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, upto
        at = upto


def _starts(shape: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], shape[1:] != shape[:-1]]))


def cuts(shape: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edge, x and y of the places where other edges of its shape cross or touch an edge, or end on it; edges come by shape and least x."""
    n, near, unit = len(shape), 2.0 * 10**-digits, float(10**digits)
    own = np.arange(n)
    left, right, low, high = np.minimum(x0, x1), np.maximum(x0, x1), np.minimum(y0, y1), np.maximum(y0, y1)
    first, last = own + 1, np.searchsorted(shape, shape, side="right")
    while (open_ := first < last).any():  # the first edge of the shape that begins right of this one
        middle = (first + last) // 2
        before = left[np.minimum(middle, n - 1)] <= right + near
        first, last = np.where(open_ & before, middle + 1, first), np.where(open_ & ~before, middle, last)
    counts = first - own - 1
    dx, dy = x1 - x0, y1 - y0
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(own[:0], x0[:0], y0[:0])]

    def off(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ax, ay = x - x0[p], y - y0[p]
        t = np.maximum(0.0, np.minimum(1.0, (ax * dx[p] + ay * dy[p]) / (dx[p] * dx[p] + dy[p] * dy[p])))
        ex, ey = ax - t * dx[p], ay - t * dy[p]
        return np.sqrt(ex * ex + ey * ey)

    for begin, end in passes(counts, PAIRS):
        a, k = spans(counts[begin:end])
        a += begin
        b = a + 1 + k
        close = (low[a] <= high[b] + near) & (low[b] <= high[a] + near)
        a, b = a[close], b[close]
        met = np.zeros(len(a), bool)
        for p, q in ((a, b), (b, a)):
            for x, y in ((x0, y0), (x1, y1)):
                on = off(p, x[q], y[q]) <= near
                met |= on
                found.append((p[on], x[q][on], y[q][on]))
        a, b = a[~met], b[~met]
        wx, wy = x0[b] - x0[a], y0[b] - y0[a]
        cross = dx[a] * dy[b] - dy[a] * dx[b]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (wx * dy[b] - wy * dx[b]) / cross, (wx * dy[a] - wy * dx[a]) / cross
        inner = (cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        a, b, t = a[inner], b[inner], t[inner]
        x, y = np.rint((x0[a] + t * dx[a]) * unit) / unit + 0.0, np.rint((y0[a] + t * dy[a]) * unit) / unit + 0.0
        found += [(a, x, y), (b, x, y)]
    edge, x, y = (np.concatenate(k) for k in zip(*found, strict=True))
    return edge, x, y


def pieces(rows: Columns, digits: int) -> Columns:
    """Pieces of the edges ``shape``, owner, x0, y0, x1, y1 as ``overlay.noded`` tells them, by shape."""
    order = np.lexsort((np.minimum(rows["x0"], rows["x1"]), rows["shape"]))
    shape, owner, x0, y0, x1, y1 = (rows[k][order] for k in ("shape", "owner", "x0", "y0", "x1", "y1"))
    edge, cx, cy = cuts(shape, x0, y0, x1, y1, digits)
    along = (cx - x0[edge]) * (x1 - x0)[edge] + (cy - y0[edge]) * (y1 - y0)[edge]
    order = np.lexsort((cy, cx, along, edge))
    edge, cx, cy = edge[order], cx[order], cy[order]
    counts = np.bincount(edge, minlength=len(shape)) + 2  # an edge's first end, its cuts in order and its last end
    ends = np.cumsum(counts)
    x, y = np.empty(ends[-1]), np.empty(ends[-1])
    x[ends - counts], y[ends - counts], x[ends - 1], y[ends - 1] = x0, y0, x1, y1
    at = np.arange(len(edge)) + 2 * edge + 1
    x[at], y[at] = cx, cy
    of = np.repeat(np.arange(len(shape)), counts)
    step = np.flatnonzero((of[1:] == of[:-1]) & ((x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    px, py, qx, qy, of = x[step], y[step], x[step + 1], y[step + 1], of[step]
    ahead = (px < qx) | ((px == qx) & (py < qy))
    x0, y0, x1, y1 = np.where(ahead, px, qx), np.where(ahead, py, qy), np.where(ahead, qx, px), np.where(ahead, qy, py)
    order = np.lexsort((y1, x1, y0, x0, shape[of]))
    x0, y0, x1, y1, of, way = x0[order], y0[order], x1[order], y1[order], of[order], np.where(ahead, 1, -1)[order]
    name, who = shape[of], owner[of]
    if not len(name):
        return {"shape": name, "x0": x0, "y0": y0, "x1": x1, "y1": y1, **{k: way for k in ("a", "b", "n", "net")}}
    differ = np.concatenate([[True], (name[1:] != name[:-1]) | (x0[1:] != x0[:-1]) | (y0[1:] != y0[:-1]) | (x1[1:] != x1[:-1]) | (y1[1:] != y1[:-1])])
    first = np.flatnonzero(differ)
    count = lambda v: np.add.reduceat(v.astype(np.int64), first)
    return {"shape": name[first], "x0": x0[first], "y0": y0[first], "x1": x1[first], "y1": y1[first], "a": count(who == 0) % 2, "b": count(who == 1) % 2, "n": count(way * way), "net": count(way)}


def rays(rows: Columns) -> Columns:
    """``rows`` with rising, and sums over the pieces of its shape that a slanted ray from just right of its middle meets: na and nb of their parities, w of how they wind.

    Pieces of a shape meet by bands of heights within the task; a ray lies in one band."""
    x0, y0, x1, y1, net, shape = (rows[k] for k in ("x0", "y0", "x1", "y1", "net", "shape"))
    h0, h1 = y0 + SLANT * x0, y1 + SLANT * x1
    low, high, mx, mh, rising = np.minimum(h0, h1), np.maximum(h0, h1), (x0 + x1) / 2, (h0 + h1) / 2, h1 > h0
    values = {"na": rows["a"], "nb": rows["b"], "w": np.where(rising, net, -net)}
    sums = {k: np.zeros(len(shape), np.int64) for k in values}
    if len(shape):
        first = _starts(shape)
        sizes = np.diff(np.append(first, len(shape)))
        of = np.repeat(np.arange(len(first)), sizes)
        base, top = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        with np.errstate(divide="ignore"):
            scale = np.where(top > base, sizes / (top - base), 0.0)
        band = lambda h: np.minimum(((h - base[of]) * scale[of]).astype(np.int64), sizes[of] - 1) + first[of]
        lowest, probe = band(low), band(mh)
        counts = band(high) - lowest + 1
        for begin, end in passes(np.add.reduceat(counts, first), PAIRS):
            begin, end = first[begin], first[end] if end < len(first) else len(shape)
            piece, k = spans(counts[begin:end])
            piece += begin
            held = lowest[piece] + k
            piece = piece[np.argsort(held, kind="stable")]
            ends = np.cumsum(np.bincount(held - begin, minlength=end - begin))
            n = np.bincount(held - begin, minlength=end - begin)[probe[begin:end] - begin]
            start = ends[probe[begin:end] - begin] - n
            for p, q in passes(n, PAIRS):
                i, k = spans(n[p:q])
                i += p
                j = piece[start[i] + k]
                i += begin
                met = (low[j] <= mh[i]) & (mh[i] < high[j]) & (i != j)
                i, j = i[met], j[met]
                right = x0[j] + (mh[i] - h0[j]) / (h1[j] - h0[j]) * (x1[j] - x0[j]) > mx[i]
                i, j = i[right] - begin, j[right]
                for name, v in values.items():
                    sums[name][begin:end] += np.bincount(i, weights=v[j], minlength=end - begin).astype(np.int64)
    return {**rows, "rising": rising, **sums}


def by_shape(work: Callable[[Columns], Columns], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``, of partitions that hold shapes whole and in order: ``work`` on the columns of many shapes at a time; ``shape`` is the number of the shape_id."""

    def done(rows: pa.Table, name: pa.DictionaryArray) -> Iterator[pa.RecordBatch]:
        columns = {k: rows[k].to_numpy() for k in rows.column_names if k != "shape_id"} | {"shape": name.indices.to_numpy().astype(np.int64)}
        first = np.append(_starts(columns["shape"]), len(columns["shape"]))
        sizes = np.diff(first)
        for begin, end in passes(sizes * sizes, 2 * PAIRS):
            out = work({k: v[first[begin] : first[end]] for k, v in columns.items()})
            ids = name.dictionary.take(pa.array(out["shape"]))
            yield from pa.Table.from_arrays([(ids if f.name == "shape_id" else pa.array(out[f.name])).cast(f.type) for f in schema], schema=schema).to_batches(max_chunksize=100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                rows = pa.Table.from_batches(held).combine_chunks()
                name = pc.dictionary_encode(rows["shape_id"].combine_chunks(), null_encoding="encode")
                keep = int(np.argmax(name.indices.to_numpy() == name.indices[-1].as_py()))  # the last shape may go on
                if keep:
                    yield from done(rows.slice(0, keep), name.slice(0, keep))
                held, n = rows.slice(keep).to_batches(), len(rows) - keep
        if n:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from done(rows, pc.dictionary_encode(rows["shape_id"].combine_chunks(), null_encoding="encode"))

    return run
