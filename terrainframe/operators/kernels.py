"""Polygon kernels that have no relational form, as Arrow UDFs over rings; each is a small helper on one shape at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def near_pairs(low: np.ndarray, high: np.ndarray, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of boxes that touch, a block of boxes at a time against those that begin before it ends."""
    order = np.argsort(low[:, 0], kind="stable")
    lo, hi = low[order], high[order]
    for a in range(0, len(order), block):
        mine = slice(a, min(len(order), a + block))
        last = np.searchsorted(lo[:, 0], hi[mine, 0].max(), side="right")
        for c in range(a, last, 4 * block):
            theirs = slice(c, min(last, c + 4 * block))
            touch = (lo[mine, None] <= hi[None, theirs]).all(2) & (lo[None, theirs] <= hi[mine, None]).all(2)
            i, j = np.nonzero(touch)
            i, j = i + a, j + c
            once = i < j
            i, j = order[i[once]], order[j[once]]
            yield np.minimum(i, j), np.maximum(i, j)


def turn(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return (q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0]) > 0


def crossings(points: np.ndarray) -> int:
    """Pairs of edges that properly cross, adjacent ones (and first with last) aside; boxes first, then four turns."""
    a, b = points[:-1], points[1:]
    n, found = len(a), 0
    if n < 4:
        return 0
    for i, j in near_pairs(np.minimum(a, b), np.maximum(a, b)):
        apart = (j - i > 1) & ~((i == 0) & (j == n - 1))
        i, j = i[apart], j[apart]
        found += int(((turn(a[i], a[j], b[j]) != turn(b[i], a[j], b[j])) & (turn(a[i], b[i], a[j]) != turn(a[i], b[i], b[j]))).sum())
    return found


def ring_points(ring: list[dict] | None) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring or []], float).reshape(-1, 2)


def shoelace(p: np.ndarray) -> float:
    return float(abs(np.dot(p[:-1, 0], p[1:, 1]) - np.dot(p[1:, 0], p[:-1, 1])) / 2)


#: Rings of up to so many points are taken together, all of one length; pairs of edges worked on at once.
SHORT_RING, PAIRS_AT_ONCE = 64, 1 << 20


def _by_length(rings: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rings in the batch, and their points (ring, point, axis): all rings of one length, or a long one alone."""
    n = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rings.flatten()
    points = np.stack([pc.struct_field(flat, k).to_numpy(zero_copy_only=False).astype(float) for k in ("x", "y")], axis=1)
    start = np.cumsum(n) - n
    for k in np.unique(n):
        of = np.flatnonzero(n == k)
        step = 1 if k > SHORT_RING else max(1, PAIRS_AT_ONCE // max(1, k * k))
        for i in range(0, len(of), step):
            mine = of[i : i + step]
            yield mine, points[start[mine, None] + np.arange(k)]


def crossings_each(points: np.ndarray) -> np.ndarray:
    """``crossings`` of rings (ring, point, axis) of one length."""
    n = points.shape[1] - 1
    if n < 4 or n >= SHORT_RING:
        return np.array([crossings(p) for p in points], np.int64)
    i, j = np.triu_indices(n, 2)
    i, j = (k[~((i == 0) & (j == n - 1))] for k in (i, j))
    a, b, p, q = (points[:, k].reshape(-1, 2) for k in (i, i + 1, j, j + 1))
    touch = ((np.minimum(a, b) <= np.maximum(p, q)) & (np.minimum(p, q) <= np.maximum(a, b))).all(1)
    proper = touch & (turn(a, p, q) != turn(b, p, q)) & (turn(a, b, p) != turn(a, b, q))
    return proper.reshape(len(points), -1).sum(1)


def self_intersections(ring: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rings in batches:
            out = np.zeros(len(rings), np.int64)
            for mine, points in _by_length(rings):
                out[mine] = crossings_each(points)
            yield pa.array(out)

    return F.arrow_udf(run, "long")(ring)


#: Limits of the diagnosis (fixed values): length over area of a thin shape, least area, least and largest length.
THIN, TINY, SHORT, LONG = 1e6, 1e-10, 1e-10, 1e8


def issue_of(p: np.ndarray) -> tuple[str, str]:
    """Issue and repair strategy of a ring; the first rule that holds."""
    if not len(p):
        return "empty", "remove"
    if not np.isfinite(p).all():
        return "invalid_coordinates", "remove"
    if len(p) < 4:
        return "too_few_points", "remove"
    if not np.array_equal(p[0], p[-1]):
        return "not_closed", "close_ring"
    if crossings(p):
        return "self_intersection", "buffer_fix"
    area, length = shoelace(p), float(np.hypot(*np.diff(p, axis=0).T).sum())
    if length < SHORT or area < TINY:
        return "tiny", "remove"
    if length > LONG:
        return "very_long", "simplify"
    if length / area > THIN:
        return "thin", "simplify"
    if len(np.unique(p[:-1], axis=0)) < len(p) - 1:
        return "repeated_point", "make_valid"
    return "valid", "none"


def issues_each(points: np.ndarray) -> list[tuple[str, str]]:
    """``issue_of`` of rings (ring, point, axis) of one length."""
    n = points.shape[1]
    if n < 4 or n > SHORT_RING:
        return [issue_of(p) for p in points]
    x, y = points[..., 0], points[..., 1]
    with np.errstate(all="ignore"):
        area = np.abs((x[:, :-1] * y[:, 1:]).sum(1) - (x[:, 1:] * y[:, :-1]).sum(1)) / 2
        length = np.hypot(np.diff(x), np.diff(y)).sum(1)
        i, j = np.triu_indices(n - 1, 1)
        rules = [  # in the order of issue_of, the first that holds
            (~np.isfinite(points).all((1, 2)), ("invalid_coordinates", "remove")), ((points[:, 0] != points[:, -1]).any(1), ("not_closed", "close_ring")),
            (crossings_each(points) > 0, ("self_intersection", "buffer_fix")), ((length < SHORT) | (area < TINY), ("tiny", "remove")), (length > LONG, ("very_long", "simplify")),
            (length / area > THIN, ("thin", "simplify")), ((points[:, i] == points[:, j]).all(2).any(1), ("repeated_point", "make_valid")), (np.ones(len(points), bool), ("valid", "none")),
        ]
    which = np.argmax([holds for holds, _ in rules], axis=0)
    return [rules[k][1] for k in which]


def diagnose(ring: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rings in batches:
            out = np.empty((len(rings), 2), object)
            for mine, points in _by_length(rings):
                out[mine] = issues_each(points)
            yield pa.StructArray.from_arrays([pa.array(out[:, 0], pa.string()), pa.array(out[:, 1], pa.string())], ["issue", "strategy"])

    return F.arrow_udf(run, "issue string, strategy string")(ring)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull by monotone chain, closed and counter-clockwise."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return np.vstack((p, p[:1]))

    def chain(seq: np.ndarray) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1] + [p[0]])


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on an open or closed line, with a stack."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, d = points[i], points[j] - points[i]
        rel, size = points[i + 1 : j] - a, float(d @ d)
        far = np.hypot(*rel.T) if size == 0 else np.hypot(*(rel - np.clip(rel @ d / size, 0, 1)[:, None] * d).T)
        if far.max() > tolerance:
            m = i + 1 + int(far.argmax())
            keep[m] = True
            todo += [(i, m), (m, j)]
    return points[keep]


def edges_of(rings: list[np.ndarray]) -> np.ndarray:
    """Edges (x0, y0, x1, y1) that rise or fall, lower end first."""
    both = np.concatenate([np.hstack((r[:-1], r[1:])) for r in rings if len(r) > 1] or [np.zeros((0, 4))])
    both = both[both[:, 1] != both[:, 3]]
    return np.where((both[:, 1] > both[:, 3])[:, None], both[:, [2, 3, 0, 1]], both)


def common_areas(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[float, float, float]:
    """Areas of two shapes and of their common part. A shape is all its rings: parts and holes, inside by the even-odd rule.

    Between the heights of all corners and crossings edges keep their order, so there a shape is trapezoids, whose area is their
    width at half height; common widths come from the sorted borders there.
    """
    edges, owner = edges_of(a), edges_of(b)
    owner, edges = np.repeat([0, 1], [len(edges), len(owner)]), np.vstack((edges, owner))
    if not len(edges):
        return 0.0, 0.0, 0.0
    heights = [edges[:, 1], edges[:, 3]]
    low, high = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    for i, j in near_pairs(low, high):
        p, d, q, e = edges[i, :2], edges[i, 2:] - edges[i, :2], edges[j, :2], edges[j, 2:] - edges[j, :2]
        cross = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((q[:, 0] - p[:, 0]) * e[:, 1] - (q[:, 1] - p[:, 1]) * e[:, 0]) / cross
        t = t[ok := np.isfinite(t) & (t > 0) & (t < 1)]
        heights.append(p[ok, 1] + t * d[ok, 1])
    ys = np.unique(np.concatenate(heights))
    areas = np.zeros(3)
    for k in range(0, len(ys) - 1, 256):
        y0, y1 = ys[k : k + 257][:-1], ys[k : k + 257][1:]
        mid = (y0 + y1) / 2
        some = np.flatnonzero((edges[:, 1] < y1[-1]) & (edges[:, 3] > y0[0]))
        for h, y in zip(y1 - y0, mid, strict=True):
            on = some[(edges[some, 1] < y) & (edges[some, 3] > y)]
            x = edges[on, 0] + (y - edges[on, 1]) / (edges[on, 3] - edges[on, 1]) * (edges[on, 2] - edges[on, 0])
            order = np.argsort(x, kind="stable")
            gaps, mine = np.diff(x[order]), owner[on[order]]
            inside = [np.cumsum(mine == k)[:-1] % 2 == 1 for k in (0, 1)]
            areas += h * np.array([gaps[inside[0]].sum(), gaps[inside[1]].sum(), gaps[inside[0] & inside[1]].sum()])
    return tuple(float(x) for x in areas)


def shape_issue(rings: list[np.ndarray]) -> str:
    """The first issue of a shape's rings, or that two of them cross, or "valid"."""
    if not rings:
        return "empty"
    for r in rings:
        issue, strategy = issue_of(r)
        if strategy != "none" and issue != "repeated_point":
            return issue
    if len(rings) > 1:
        a, b = np.vstack([r[:-1] for r in rings]), np.vstack([r[1:] for r in rings])
        owner = np.repeat(np.arange(len(rings)), [len(r) - 1 for r in rings])
        for i, j in near_pairs(np.minimum(a, b), np.maximum(a, b)):
            i, j = i[owner[i] != owner[j]], j[owner[i] != owner[j]]
            if ((turn(a[i], a[j], b[j]) != turn(b[i], a[j], b[j])) & (turn(a[i], b[i], a[j]) != turn(a[i], b[i], b[j]))).any():
                return "rings_cross"
    return "valid"


def shape_iou(a: Column, b: Column) -> Column:
    """(iou, common, status) of two shapes, each an array of rings; an invalid shape gives null and why. Exact but for rounding."""
    kind = pa.struct([("iou", pa.float64()), ("common", pa.float64()), ("status", pa.string())])

    def one(p: list | None, q: list | None) -> dict:
        shapes = [[ring_points(r) for r in x or []] for x in (p, q)]
        for name, rings in zip(("predicted", "truth"), shapes, strict=True):
            if (issue := shape_issue(rings)) != "valid":
                return {"iou": None, "common": None, "status": f"{name}_{issue}"}
        first, second, common = common_areas(*shapes)
        return {"iou": common / (first + second - common), "common": common, "status": "valid"}

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array([one(x, y) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], kind)

    return F.arrow_udf(run, "iou double, common double, status string")(a, b)


def polygon_iou(a: Column, b: Column) -> Column:
    """(iou, common, status) of two rings, concave ones included."""
    return shape_iou(F.array(a), F.array(b))
