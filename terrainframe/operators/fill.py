"""Depression filling by a graph of spills: each tile floods once, and what travels between tiles is a small graph.

A tile floods from its border inwards; each border cell that no lower one reached starts a basin, and cells next to no data or to the grid's edge drain to the outlet. Two
basins that touch, in a tile or across a tile's border, are joined by their least pass. The least highest pass on any way from a basin to the outlet is the level that
its cells are raised to; it lies on a minimum spanning forest. So a cell's level is the greater of its own tile's flood and its basin's level.

Plan: one exchange of cells with a border of one cell around each tile, one Arrow-sized row a tile written, one join of border cells, Boruvka rounds over the basins' graph
(about a hundredth of the cells; basins at least halve in each round), one join of levels by tile. A graph of at most ``MOST_PASSES`` passes is solved on the driver, which
gives the same levels without the rounds' jobs; beyond that it never leaves the executors.

Edge cases: cells without a row or elevation are no data and have no result; a grid of one cell is unchanged; ties change no level; an empty grid gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrainframe.operators.stencil import STEPS, Grid
from terrainframe.tables import discard, written

TILE, MOST_PASSES, BASINS_A_TILE = 256, 250_000, 1 << 24
OUTLET = 0
_TILES = "tile long, trow int, tcol int, h int, n int, level binary, basin binary"


def flood(z: np.ndarray, outlet: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level, basin) of a tile: flooded from outlet cells (basin 0) and border cells, lowest first; basins are numbered from 1."""
    h, n = z.shape
    wide = n + 2
    heights = np.pad(z, 1, constant_values=np.nan)
    levels = np.where(np.isnan(heights), -np.inf, np.inf).ravel()
    basins = np.full(len(levels), -1, np.int64)
    seeds = np.pad((outlet | border) & ~np.isnan(z), 1).ravel()
    drains = np.pad(outlet, 1).ravel()
    levels[seeds] = heights.ravel()[seeds]
    basins[seeds & drains] = OUTLET
    heap = [(levels[i], i) for i in np.flatnonzero(seeds).tolist()]
    heapq.heapify(heap)
    heights, levels, basins, count = heights.ravel().tolist(), levels.tolist(), basins.tolist(), 0
    steps = [dr * wide + dc for dr, dc in STEPS.values()]
    while heap:
        at, i = heapq.heappop(heap)
        if basins[i] < 0:
            count += 1
            basins[i] = count
        own = basins[i]
        for step in steps:
            j = i + step
            if levels[j] > at or basins[j] < 0 and levels[j] == at:  # no data has the least level of all
                new = heights[j] if heights[j] > at else at
                if new < levels[j]:
                    levels[j] = new
                    basins[j] = own
                    heapq.heappush(heap, (new, j))
                elif basins[j] < 0:
                    basins[j] = own
    cut = lambda x, kind: np.array(x, kind).reshape(h + 2, wide)[1:-1, 1:-1]
    return np.where(np.isnan(z), np.nan, cut(levels, float)), np.where(np.isnan(z), -1, cut(basins, np.int64))


def passes(level: np.ndarray, basin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, height): the least pass of each two basins that touch within a tile, a < b."""
    found = []
    for dr, dc in ((0, 1), (1, 0), (1, 1), (1, -1)):
        h, n = level.shape
        p = (slice(0, h - dr), slice(max(0, -dc), n - max(0, dc)))
        q = (slice(dr, h), slice(max(0, dc), n + min(0, dc)))
        a, b = basin[p], basin[q]
        met = (a != b) & (a >= 0) & (b >= 0)
        found.append(np.column_stack((np.minimum(a, b)[met], np.maximum(a, b)[met], np.maximum(level[p], level[q])[met])))
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    first = np.append(True, (every[1:, :2] != every[:-1, :2]).any(1))[: len(every)]
    return every[first, 0].astype(np.int64), every[first, 1].astype(np.int64), every[first, 2]


def solved(a: np.ndarray, b: np.ndarray, height: np.ndarray) -> dict[int, float]:
    """Levels by basin of a graph in memory: passes from the lowest on join basins; what joins the outlet's has its level."""
    order = np.argsort(height, kind="stable")
    group: dict[int, list[int]] = {}
    of: dict[int, int] = {}
    for x in np.unique(np.concatenate((a, b, [OUTLET]))).tolist():
        group[x], of[x] = [x], x
    out: dict[int, float] = {}
    for x, y, w in zip(a[order].tolist(), b[order].tolist(), height[order].tolist(), strict=True):
        x, y = of[x], of[y]
        if x == y:
            continue
        sea = of[OUTLET]
        if sea in (x, y):
            dry = y if x == sea else x
            out.update((k, w) for k in group[dry])
        if len(group[x]) < len(group[y]):
            x, y = y, x
        for k in group[y]:
            of[k] = x
        group[x] += group.pop(y)
    return out


def _least_passes(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a", "b").agg(F.min("w").alias("w"))


def _chained(links: DataFrame) -> DataFrame:
    """(node, root, w) from (node, to, w): the end of each chain of links, by pointer doubling; w is the node's own."""
    now = written(links.select("node", F.col("to").alias("root"), "w"), "chains")
    while True:
        ahead = now.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = written(now.join(ahead, "root", "left").select("node", F.coalesce("further", "root").alias("root"), "w", (F.coalesce("further", "root") != F.col("root")).alias("moved")), "chains")
        discard(now)
        ended = new.where("moved").isEmpty()
        now = new.drop("moved")
        now._terrainframe_path = new._terrainframe_path
        if ended:
            return now


def basin_levels(edges: DataFrame) -> DataFrame:
    """(basin, level) of every basin of ``(a, b, w)`` passes, a < b, that has a way to the outlet: Boruvka rounds.

    In a round every group of basins but the outlet's takes its least pass out (ties by the pass's ends, so that no ring of groups can form); all ways out of it are at least
    as high. Along such links passes only fall, so a basin's level is the highest of its own groups' passes up to the round that reaches the outlet.
    """
    c = F.col
    edges = written(_least_passes(edges), "passes")
    nodes = edges.select("a").union(edges.select("b")).distinct().where(c("a") != OUTLET)
    state = written(nodes.select(c("a").alias("basin"), c("a").alias("group"), F.lit(float("-inf")).alias("level")), "basin-groups")
    while not edges.isEmpty():
        ends = edges.select(c("a").alias("node"), c("b").alias("to"), "w", "a", "b").unionByName(edges.select(c("b").alias("node"), c("a").alias("to"), "w", "a", "b")).where(c("node") != OUTLET)
        least = ends.groupBy("node").agg(F.min(F.struct("w", "a", "b", "to")).alias("m")).select("node", "m.to", "m.w", "m.a", "m.b")
        least = written(least, "least-passes")
        mutual = least.select(c("node").alias("to"), c("to").alias("node"), c("a").alias("oa"), c("b").alias("ob"))
        # of two groups that take the same pass, the lesser is the root of their tree
        rooted = least.join(mutual, ["node", "to"], "left").select("node", F.when(c("oa").isNotNull() & (c("node") < c("to")), c("node")).otherwise(c("to")).alias("to"), "w")
        ends_at = _chained(rooted.unionByName(rooted.select(F.lit(OUTLET).cast("long").alias("node"), F.lit(OUTLET).cast("long").alias("to"), F.lit(float("-inf")).alias("w")).limit(1)))
        of = lambda k: ends_at.select(c("node").alias(k), c("root").alias(f"{k}_root"))  # noqa: B023, E731
        moved = state.join(ends_at.select(c("node").alias("group"), "root", "w"), "group", "left")
        new_state = written(moved.select("basin", F.coalesce("root", "group").alias("group"), F.when(c("group") == OUTLET, c("level")).otherwise(F.greatest("level", F.coalesce("w", "level"))).alias("level")), "basin-groups")
        joined = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y"), "w").where("x <> y")
        new_edges = written(_least_passes(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "w")), "passes")
        for used in (state, edges, least, ends_at):
            discard(used)
        state, edges = new_state, new_edges
    return state.where(c("group") == OUTLET).select("basin", "level")


def fill(grid: Grid, tile: int = TILE, most_passes: int = MOST_PASSES) -> DataFrame:
    """row, col, elev with depressions filled: the least height of the highest cell on any way to the edge or to no data."""
    c, spark = F.col, grid.cells.sparkSession
    height, width = grid.height, grid.width
    last = ((height - 1) // tile, (width - 1) // tile)
    spread = F.array(*[F.struct(F.floor((c("row") + dr) / tile).cast("int").alias("trow"), F.floor((c("col") + dc) / tile).cast("int").alias("tcol")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)])
    haloed = grid.cells.select("row", "col", c("elev").cast("double").alias("elev"), F.explode(F.array_distinct(spread)).alias("t")).select("row", "col", "elev", "t.trow", "t.tcol")
    haloed = haloed.where(c("trow").between(0, last[0]) & c("tcol").between(0, last[1]))

    def flooded(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tr, tc = key
        h, n = min(tile, height - tr * tile), min(tile, width - tc * tile)
        wide = np.full((h + 2, n + 2), np.nan)
        wide[rows["row"] - tr * tile + 1, rows["col"] - tc * tile + 1] = rows["elev"]
        z, gap = wide[1:-1, 1:-1], np.isnan(wide)
        outlet = np.zeros((h, n), bool)
        for dr, dc in STEPS.values():
            outlet |= gap[1 + dr : 1 + dr + h, 1 + dc : 1 + dc + n]
        border = np.ones((h, n), bool)
        border[1:-1, 1:-1] = False
        level, basin = flood(z, outlet & ~np.isnan(z), border)
        name = tr * (last[1] + 1) + tc
        basin = np.where(basin > 0, basin + name * BASINS_A_TILE, basin)
        return pd.DataFrame([(name, tr, tc, h, n, level.tobytes(), basin.tobytes())], columns=["tile", "trow", "tcol", "h", "n", "level", "basin"])

    def arrays(t) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(t.level).reshape(t.h, t.n), np.frombuffer(t.basin, np.int64).reshape(t.h, t.n)

    def inner(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for t in frame.itertuples():
                yield pd.DataFrame(dict(zip("abw", passes(*arrays(t)), strict=True)))

    def borders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for t in frame.itertuples():
                level, basin = arrays(t)
                edge = np.ones(level.shape, bool)
                edge[1:-1, 1:-1] = False
                r, k = np.nonzero(edge & (basin >= 0))
                yield pd.DataFrame({"tile": t.tile, "row": r + t.trow * tile, "col": k + t.tcol * tile, "w": level[r, k], "basin": basin[r, k]})

    tiles = written(haloed.groupBy("trow", "tcol").applyInPandas(flooded, _TILES), "tiles")
    rim = tiles.mapInPandas(borders, "tile long, row long, col long, w double, basin long")
    half = [s for k, s in STEPS.items() if k in (2, 3, 4, 5)]  # each two neighbours once
    sent = rim.select("tile", "w", "basin", F.explode(F.array(*[F.struct((c("row") + dr).alias("row"), (c("col") + dc).alias("col")) for dr, dc in half])).alias("to")).select(c("tile").alias("other"), c("w").alias("ow"), c("basin").alias("ob"), "to.row", "to.col")
    crossing = rim.join(sent, ["row", "col"]).where((c("tile") != c("other")) & (c("basin") != c("ob"))).select(F.least("basin", "ob").alias("a"), F.greatest("basin", "ob").alias("b"), F.greatest("w", "ow").alias("w"))
    edges = written(_least_passes(tiles.mapInPandas(inner, "a long, b long, w double").unionByName(crossing)), "passes")
    if edges.count() <= most_passes:
        found = edges.toPandas()
        known = solved(found["a"].to_numpy(), found["b"].to_numpy(), found["w"].to_numpy())
        levels = spark.createDataFrame(pd.DataFrame({"basin": list(known), "level": list(known.values())}, columns=["basin", "level"]).astype({"basin": "int64", "level": "float64"}), "basin long, level double")
    else:
        levels = basin_levels(edges)
    by_tile = levels.groupBy(F.floor((c("basin") - 1) / BASINS_A_TILE).alias("tile")).agg(F.collect_list(F.struct("basin", "level")).alias("levels"))

    def raised(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for t in frame.itertuples():
                level, basin = arrays(t)
                told = [(x["basin"], x["level"]) for x in t.levels] if t.levels is not None else []
                table = np.full(max([0, *(int(b) % BASINS_A_TILE for b, _ in told)]) + 1, -np.inf)
                for b, v in told:
                    table[int(b) % BASINS_A_TILE] = v
                r, k = np.nonzero(basin >= 0)
                own = basin[r, k] % BASINS_A_TILE
                lift = np.where((own > 0) & (own < len(table)), table[np.minimum(own, len(table) - 1)], -np.inf)
                yield pd.DataFrame({"row": r + t.trow * tile, "col": k + t.tcol * tile, "elev": np.maximum(level[r, k], lift)})

    return tiles.join(by_tile, "tile", "left").mapInPandas(raised, "row long, col long, elev double")
