import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrainframe.operators import fill, hydrology, stencil
from terrainframe.operators.stencil import STEPS, Grid


def grid_of(spark, z):
    rows = [(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return Grid(spark.createDataFrame(rows, "row long, col long, elev double"), *z.shape)


def spec_d8(z, enforce=True):
    code = np.zeros(z.shape, int)
    for r in range(1, z.shape[0] - 1):
        for c in range(1, z.shape[1] - 1):
            best, k_best = -np.inf, 0
            for k, (dr, dc) in STEPS.items():
                drop = z[r, c] - z[r + dr, c + dc]
                if not np.isnan(drop) and drop > best:
                    best, k_best = drop, k
            code[r, c] = k_best if best > (0 if enforce else -np.inf) else 0
    return code


def spec_fill(z):
    h, w = z.shape
    level, heap = np.full(z.shape, np.inf), []
    for r in range(h):
        for c in range(w):
            near = [(r + a, c + b) for a, b in STEPS.values()]
            if not np.isnan(z[r, c]) and any(not (0 <= a < h and 0 <= b < w) or np.isnan(z[a, b]) for a, b in near):
                level[r, c] = z[r, c]
                heapq.heappush(heap, (z[r, c], r, c))
    while heap:
        at, r, c = heapq.heappop(heap)
        if at > level[r, c]:
            continue
        for a, b in STEPS.values():
            a, b = r + a, c + b
            if 0 <= a < h and 0 <= b < w and not np.isnan(z[a, b]) and max(at, z[a, b]) < level[a, b]:
                level[a, b] = max(at, z[a, b])
                heapq.heappush(heap, (level[a, b], a, b))
    return level


def grids():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 9, (14, 11)).astype(float)
    a[rng.random(a.shape) < 0.08] = np.nan
    y, x = np.mgrid[0:12, 0:17]
    return {"ties": a, "slope": (x + 2.0 * y), "flat": np.full((5, 6), 3.0), "row": np.arange(6.0)[None, :], "none": np.full((4, 4), np.nan), "bowl": (x - 8.0) ** 2 + (y - 6.0) ** 2}


@pytest.mark.parametrize("name", grids())
def test_directions(spark, name):
    z = grids()[name]
    for enforce in (True, False):
        got = {(r.row, r.col): r.code for r in stencil.d8(grid_of(spark, z), enforce).collect()}
        want = spec_d8(z, enforce)
        assert all(got[r, c] == want[r, c] for r in range(z.shape[0]) for c in range(z.shape[1]))


@pytest.mark.parametrize("name", ["ties", "slope", "bowl"])
def test_accumulation_and_watersheds(spark, name):
    z = grids()[name]
    g, code = grid_of(spark, z), spec_d8(z)
    flow = stencil.d8(g)
    down = {(r, c): (r + STEPS[k][0], c + STEPS[k][1]) for r, c in np.argwhere(code) if (k := code[r, c])}
    acc = {(r, c): 1 for r in range(z.shape[0]) for c in range(z.shape[1])}
    hops = {}
    for cell in down:
        at, n = cell, 0
        while at in down:
            at, n = down[at], n + 1
            if at in down:
                acc[at] += 1
        hops[cell] = n
    assert {(r.row, r.col): r.acc for r in hydrology.accumulate(flow, g).collect()} == acc
    assert {(r.row, r.col): r.hops for r in hydrology.hops_to_outlet(flow, g).collect()} == hops
    pours = [(1, 3, 4), (2, 0, 2), (3, 2, 2), (4, 99, 0)]
    got = {(r.pour_id, r.row, r.col) for r in hydrology.watersheds(flow, g, spark.createDataFrame(pours, "pour_id long, row long, col long")).collect()}
    want = set()
    for p, r, c in pours[:3]:
        for cell in acc:
            at = cell
            while at != (r, c) and at in down:
                at = down[at]
            if at == (r, c):
                want.add((p, *cell))
    assert got == want


@pytest.mark.parametrize("name", grids())
def test_fill(spark, name):
    z = grids()[name]
    want = spec_fill(z)
    for tile, most_passes in ((256, 1000), (4, 1000), (4, 0)):  # the last in Boruvka rounds on the executors
        got = np.full(z.shape, np.nan)
        for r in hydrology.fill(grid_of(spark, z), tile, most_passes).collect():
            got[r.row, r.col] = r.elev
        assert np.array_equal(got, np.where(np.isnan(z), np.nan, want), equal_nan=True)


def test_fill_graph_rounds_equal_the_driver(spark):
    """Random graphs with ties, chains and parts without a way to the outlet."""
    rng = np.random.default_rng(4)
    for n, m in ((30, 60), (200, 260), (60, 59)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        if m == n - 1:
            a, b = np.arange(m), np.arange(1, n)  # one long chain
        keep = a != b
        a, b, w = np.minimum(a, b)[keep], np.maximum(a, b)[keep], rng.integers(0, 12, keep.sum()).astype(float)
        want = fill.solved(a, b, w)
        df = spark.createDataFrame([(int(x), int(y), float(v)) for x, y, v in zip(a, b, w, strict=True)], "a long, b long, w double")
        assert {r.basin: r.level for r in fill.basin_levels(df).collect()} == want


def test_subtree_sums_on_a_serpentine(spark):
    """One river through all cells, a pour point on every cell: sums come without a row a cell and pour point."""
    height, width = 24, 25
    code = np.full((height, width), 3)
    code[1::2] = 7
    code[0::2, -1] = 5
    code[1::2, 0] = 5
    code[-1, 0] = 0
    cells = [(r, c) for r in range(height) for c in range(width)]
    flow = spark.createDataFrame([(r, c, int(code[r, c])) for r, c in cells], "row long, col long, code int")
    grid = stencil.Grid(flow.select("row", "col", F.lit(1.0).alias("elev")), height, width)
    pours = spark.createDataFrame([(r * width + c, r, c) for r, c in cells] + [(-1, 99, 0)], "pour_id long, row long, col long")
    acc = flow.select("row", "col", (F.col("row") * width + F.col("col")).alias("acc"))
    got = {r.pour_id: (r.n_cells, r.n_stream, r.max_acc) for r in hydrology.watershed_counts(flow, grid, pours, acc, 300).collect()}
    place = lambda r, c: r * width + (c if r % 2 == 0 else width - 1 - c)
    number = {place(r, c): r * width + c for r, c in cells}
    for r, c in cells:
        above = [number[k] for k in range(place(r, c) + 1)]
        assert got[r * width + c] == (len(above), sum(v >= 300 for v in above), max(above))
    assert -1 not in got


def test_smoothing_against_two_passes(spark):
    z = np.random.default_rng(2).random((7, 9))
    w = np.exp(-0.5 * (np.arange(-2, 3) / 0.5) ** 2)
    w /= w.sum()
    p = np.pad(z, 2, mode="symmetric")
    once = sum(w[k] * p[k : k + 7, :] for k in range(5))
    want = sum(w[k] * once[:, k : k + 9] for k in range(5))
    got = {(r.row, r.col): r.elev for r in stencil.smooth(grid_of(spark, z)).collect()}
    assert all(abs(got[r, c] - want[r, c]) < 1e-12 for r in range(7) for c in range(9))


def test_equal_with_any_partitioning(spark):
    z = grids()["ties"]
    one, many = grid_of(spark, z), grid_of(spark, z)
    one.cells, many.cells = one.cells.coalesce(1), many.cells.repartition(16)
    key = lambda df: sorted(map(tuple, df.select("row", "col", F.round("angle", 9), "slope").collect()))
    assert key(stencil.dinf(one)) == key(stencil.dinf(many))
