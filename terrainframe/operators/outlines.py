"""Outlines of cell sets: no group of cells meets in one task.

A cell's side towards a cell outside is a border edge from corner to corner, the set on its left. Edges meet end to start; where two
begin at one corner, the walk turns left, so cells that touch at a corner only are parts of their own. Straight runs don't matter for rings,
so an edge and the next make a bend or not.

1. ``steps``: cells are dealt by set and tile, once, with those at a tile's edge in the tiles beside it, too. Which of the four cells around a corner are inside tells the edges that end there,
   and the edges that follow them.
2. ``chained``: edges of a partition that follow each other become chains, and rings where they close. What lies together only saves work: a chain may break anywhere.
3. ``ring_places``: pointer doubling over chains alone gives each the least edge of its ring and its place in it, in log2(longest ring's chains) rounds of two joins, each written
   to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrainframe.tables import discard, shuffle_parts, shuffled, written

#: Sides of a cell: its number, the neighbour's step, the edge's first corner and its direction (rows grow downwards).
SIDES = {0: ((-1, 0), (0, 1), (0, -1)), 1: ((0, -1), (0, 0), (1, 0)), 2: ((1, 0), (1, 0), (0, 1)), 3: ((0, 1), (1, 1), (-1, 0))}
#: Cells around a corner (row, col), as steps from it, with their bits.
AROUND = {1: (-1, -1), 2: (-1, 0), 4: (0, -1), 8: (0, 0)}
#: Rows and columns of a tile as a power of two, edges that one pass of a task holds, and the half of the range of rows and columns.
TILE, CHUNK, HALF = 8, 1_000_000, 1 << 29


def _turns() -> dict[int, list[tuple[int, int, bool]]]:
    """For each set of inside cells around a corner: sides of the edges that end there, of the edges that follow, and whether that is a bend."""
    found: dict[int, list[tuple[int, int, bool]]] = {}
    for inside in range(16):
        held = {AROUND[bit] for bit in AROUND if inside & bit}
        at = lambda corner: [(cell, k) for cell in held for k, (beside, first, way) in SIDES.items() if tuple(np.add(cell, np.add(first, way) if corner else first)) == (0, 0) and tuple(np.add(cell, beside)) not in held]  # noqa: E731, B023
        starts = [k for _, k in at(False)]
        for _, k in at(True):
            after = max(starts, key=lambda side: (side - k + 2) % 4)  # left turn 3, straight on 2, right turn 1
            found.setdefault(inside, []).append((k, after, (after - k + 2) % 4 != 2))
    return found


def coded(row: Column, col: Column, side: Column) -> Column:
    """An edge as one number, in the order of its first corner's row and column and its side. Rows and columns lie between -2**29 and 2**29."""
    return F.shiftleft((row + HALF).cast("long"), 32) + F.shiftleft((col + HALF).cast("long"), 2) + side.cast("long")


def edge_row(edge: Column) -> Column:
    return F.shiftright(edge, 32) - HALF


def edge_col(edge: Column) -> Column:
    return F.shiftright(edge, 2).bitwiseAND(F.lit((1 << 30) - 1)) - HALF


def edge_side(edge: Column) -> Column:
    return edge.bitwiseAND(F.lit(3)).cast("int")


def _of_side(axis: int) -> Column:
    """The step of an edge's way."""
    return F.create_map(*[F.lit(x) for k, s in SIDES.items() for x in (k, s[2][axis])])[edge_side(F.col("edge"))]


def steps(cells: DataFrame) -> DataFrame:
    """pour_id, edge, next, bend of each border edge of ``(pour_id, row, col)`` cells and the edge that follows it, dealt by set and tile."""
    c = F.col
    tile = lambda k, d: F.shiftright((c(k) + d).cast("long"), TILE)
    tiles = F.array_distinct(F.array(*[F.struct(tile("row", dr).alias("tr"), tile("col", dc).alias("tc")) for dr in (0, 1) for dc in (0, 1)]))
    inner = (tile("row", 0) == tile("row", 1)) & (tile("col", 0) == tile("col", 1))
    own = F.array(F.struct(tile("row", 0).alias("tr"), tile("col", 0).alias("tc")))
    sent = cells.select("pour_id", c("row").cast("long").alias("row"), c("col").cast("long").alias("col")).select("pour_id", "row", "col", F.inline(F.when(inner, own).otherwise(tiles)))
    sent = sent.repartition(shuffle_parts(cells), "pour_id", "tr", "tc")
    corners = F.inline(F.array(*[F.struct((c("row") - dr).alias("r"), (c("col") - dc).alias("c"), F.lit(bit).alias("bit")) for bit, (dr, dc) in AROUND.items()]))
    here = sent.select("pour_id", "tr", "tc", corners).where((F.shiftright("r", TILE) == c("tr")) & (F.shiftright("c", TILE) == c("tc")))
    met = here.groupBy("pour_id", "tr", "tc", "r", "c").agg(F.bit_or("bit").alias("inside")).where("inside < 15")
    kind = "array<struct<k:int,after:int,bend:boolean>>"
    turn = F.create_map(*[x for inside, found in _turns().items() for x in (F.lit(inside), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(after).alias("after"), F.lit(bend).alias("bend")) for k, after, bend in found]).cast(kind))])
    each = met.select("pour_id", "tr", "tc", "r", "c", F.inline(turn[c("inside")]))
    back = lambda axis: F.create_map(*[F.lit(x) for k, s in SIDES.items() for x in (k, s[2][axis])])[c("k")]
    found = each.select("pour_id", "tr", "tc", coded(c("r") - back(0), c("c") - back(1), c("k")).alias("edge"), coded(c("r"), c("c"), c("after")).alias("next"), "bend")
    return found.sortWithinPartitions("pour_id", "tr", "tc").select("pour_id", "edge", "next", "bend")


def _chains(pour: np.ndarray, edge: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, ...]:
    """For the edges of a chunk: their ring's or chain's least edge, the chain's first edge (-1: the ring is closed), its last edge's follower, its edges, each edge's place in it, and the least one's."""
    n = len(edge)
    names = np.unique(np.concatenate([edge, after]))
    key = pour * len(names) + np.searchsorted(names, edge)
    order = np.argsort(key, kind="stable")
    key, edge, after, pour = key[order], edge[order], after[order], pour[order]
    wanted = pour * len(names) + np.searchsorted(names, after)
    at = np.minimum(np.searchsorted(key, wanted), n - 1)
    own = np.arange(n)
    ends = key[at] != wanted
    jump, least = np.where(ends, own, at), own.copy()
    # rings: those that never reach an end are cut before their least edge
    while True:
        further, lower = jump[jump], np.minimum(least, least[jump])
        if np.array_equal(lower, least) and np.array_equal(further[ends[further] | ends[jump]], jump[ends[further] | ends[jump]]):
            break
        jump, least = further, lower
    ring = ~ends[jump]
    jump = np.where(ends | (ring & (at == least)), own, at)
    left = (jump != own).astype(np.int64)
    while (left[jump] > 0).any():
        left, jump = left + left[jump], jump[jump]
    low = np.full(n, n)
    np.minimum.at(low, jump, own)  # of the whole chain, by its last edge
    count = np.bincount(jump, minlength=n)[jump]
    place = count - 1 - left
    first = np.zeros(n, np.int64)
    first[jump[place == 0]] = own[place == 0]
    back = np.empty(n, np.int64)
    back[order] = own
    out = edge[low[jump]], np.where(ring, -1, edge[first[jump]]), after[jump], count, place, place[low[jump]]
    return tuple(k[back] for k in out)


def chained(steps: DataFrame) -> DataFrame:
    """``(pour_id, edge, next, ...)`` with least, chain (its first edge; null in a closed ring), onward (the edge after its last; told by its first), n, at (the edge's place in it), least_at (the least edge's; told by its first)."""
    kept = [k for k in steps.columns if k != "next"]
    schema = T.StructType([*[steps.schema[k] for k in kept], *[T.StructField(k, T.LongType()) for k in ("least", "chain", "onward", "n", "at", "least_at")]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            pour = pd.factorize(rows["pour_id"].to_pandas(), use_na_sentinel=False)[0].astype(np.int64)
            least, chain, onward, n, at, least_at = _chains(pour, rows["edge"].to_numpy(), rows["next"].to_numpy())
            told = [pa.array(least), pa.array(chain, mask=chain < 0), pa.array(onward, mask=at > 0), pa.array(n), pa.array(at), pa.array(least_at, mask=at > 0)]
            out = rows.select(kept)
            for name, column in zip(("least", "chain", "onward", "n", "at", "least_at"), told, strict=True):
                out = out.append_column(name, column)
            yield from out.to_batches(max_chunksize=100_000)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield from done(held)
                held, n = [], 0
        if n:
            yield from done(held)

    return steps.mapInArrow(work, schema)


def ring_places(steps: DataFrame) -> DataFrame:
    """pour_id, ring (its least edge), place (steps from there), edge and further columns, from ``(pour_id, edge, next, ...)``: each edge (a number of 0 or more) with the one that follows it.

    It is fast where a partition holds edges that follow each other; the result is the same however they are dealt.
    """
    c = F.col
    more = [k for k in steps.columns if k not in ("pour_id", "edge", "next")]
    every = written(chained(steps), "ring-edges")
    chains = written(every.where("chain IS NOT NULL AND at = 0").select("pour_id", c("chain").alias("edge"), c("onward").alias("next"), "least", "n", "least_at"), "chains")
    whole = every.where("chain IS NULL").select("pour_id", c("least").alias("ring"), c("at").alias("place"), "edge", *more)
    if chains.isEmpty():
        return whole
    state = written(chains.select("pour_id", "edge", c("next").alias("far"), c("least").alias("ring")), "ring-jumps")
    while True:  # after round k a ring's name is the least edge of the next 2**k chains
        far = state.select("pour_id", c("edge").alias("far"), c("far").alias("further"), c("ring").alias("other"))
        new = state.join(far, ["pour_id", "far"]).select("pour_id", "edge", c("further").alias("far"), F.least("ring", "other").alias("ring"), (F.least("ring", "other") != c("ring")).alias("moved"))
        new = written(new, "ring-jumps")
        discard(state)
        state = new.drop("moved")
        state._terrainframe_path = new._terrainframe_path
        if new.where("moved").isEmpty():
            break
    named = written(chains.join(state.select("pour_id", "edge", "ring"), ["pour_id", "edge"]), "ring-chains")
    discard(state)
    heads = named.where("least = ring").select("pour_id", c("edge").alias("next"), F.lit(True).alias("head"))  # the chain before the one that holds a ring's least edge ends the list
    state = written(named.join(shuffled(heads), ["pour_id", "next"], "left").select("pour_id", "edge", F.when(c("head").isNull(), c("next")).alias("far"), c("n").alias("left")), "ranks")
    while not state.where("far IS NOT NULL").isEmpty():
        far = state.select("pour_id", c("edge").alias("far"), c("far").alias("further"), c("left").alias("more"))
        new = written(state.join(far, ["pour_id", "far"], "left").select("pour_id", "edge", c("further").alias("far"), (c("left") + F.coalesce("more", F.lit(0))).alias("left")), "ranks")
        discard(state)
        state = new
    told = written(named.select("pour_id", c("edge").alias("chain"), "ring", F.when(c("least") == c("ring"), c("least_at")).otherwise(0).alias("behind")).join(state.select("pour_id", c("edge").alias("chain"), "left"), ["pour_id", "chain"]), "chain-places")
    parts = every.where("chain IS NOT NULL").join(told, ["pour_id", "chain"])
    place = F.when(c("at") < c("behind"), c("at")).otherwise(c("at") - c("left"))  # what lies before the least edge in its chain comes last
    return whole.unionByName(parts.select("pour_id", "ring", place.alias("place"), "edge", *more))


def rings(cells: DataFrame) -> DataFrame:
    """pour_id, ring, place, edge, bend (whether the edge's end is a corner of the outline) of the outlines of ``(pour_id, row, col)`` cells."""
    return ring_places(steps(cells))


def signed_rings(corners: DataFrame) -> DataFrame:
    """pour_id, ring, r (closed, outer ones counter-clockwise), area (below 0: a hole), from ``(pour_id, ring, p)`` with p of place, x and y."""
    whole = corners.groupBy("pour_id", "ring").agg(F.sort_array(F.collect_list("p")).alias("p"))
    points = F.transform("p", lambda q: F.struct(q.x.alias("x"), q.y.alias("y")))
    closed = whole.select("pour_id", "ring", F.concat(points, F.slice(points, 1, 1)).alias("r"))
    origin = F.get("r", F.lit(0))  # turns around a near point keep their digits
    turns = F.aggregate(F.sequence(F.lit(1), F.size("r") - 1), F.lit(0.0), lambda t, i: t + (F.get("r", i - 1).x - origin.x) * (F.get("r", i).y - origin.y) - (F.get("r", i).x - origin.x) * (F.get("r", i - 1).y - origin.y)) / 2
    return closed.withColumn("area", turns)


def gathered(corners: DataFrame) -> DataFrame:
    """pour_id, rings (by falling area), n_outer, n_holes, n_corners, area, from ``(pour_id, ring, p)`` as ``signed_rings`` takes."""
    return signed_rings(corners).groupBy("pour_id").agg(
        F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("area", "r")))), lambda q: q.r).alias("rings"), F.count_if(F.col("area") > 0).cast("int").alias("n_outer"),
        F.count_if(F.col("area") < 0).cast("int").alias("n_holes"), F.sum(F.size("r") - 1).alias("n_corners"), F.sum("area").alias("area"),
    )


def corners(cells: DataFrame, origin_x: float, origin_y: float, step: float) -> DataFrame:
    """pour_id, ring, p (place, x, y): the cell corners where outlines bend, in world coordinates."""
    edge = F.col("edge")
    x, y = F.lit(origin_x) + (edge_col(edge) + _of_side(1)) * step, F.lit(origin_y) - (edge_row(edge) + _of_side(0)) * step
    return rings(cells).where("bend").select("pour_id", "ring", F.struct("place", x.alias("x"), y.alias("y")).alias("p"))


def outlines(cells: DataFrame, origin_x: float, origin_y: float, step: float) -> DataFrame:
    """pour_id, rings (closed, outer ones counter-clockwise in world coordinates), n_outer, n_holes, n_corners, area.

    Points are cell corners where the outline bends. Rings are gathered by watershed; bends, not cells or edges, travel then.
    """
    return gathered(corners(cells, origin_x, origin_y, step))


def contours(cells: DataFrame) -> DataFrame:
    """pour_id, contours (closed, by falling number of points), n_contours, n_points, longest (points of the first), area (holes taken off).

    The line between inside and outside, halfway between cell centres: marching squares over ``(pour_id, row, col)`` cells, one point a side of a cell that borders
    on the outside. At a saddle the inside stays apart. x is the column, y the row, cell centres at whole numbers.
    """
    traced = rings(cells)
    x, y = edge_col(F.col("edge")) + _of_side(1) / 2 - 0.5, edge_row(F.col("edge")) + _of_side(0) / 2 - 0.5
    points = traced.select("pour_id", "ring", F.struct("place", x.alias("x"), y.alias("y")).alias("p"))
    whole = points.groupBy("pour_id", "ring").agg(F.sort_array(F.collect_list("p")).alias("p"))
    line = F.transform("p", lambda q: F.struct(q.x.alias("x"), q.y.alias("y")))
    closed = whole.select("pour_id", F.size("p").alias("n"), F.concat(line, F.slice(line, 1, 1)).alias("r"))
    turns = F.aggregate(F.sequence(F.lit(1), F.size("r") - 1), F.lit(0.0), lambda t, i: t + F.get("r", i).x * F.get("r", i - 1).y - F.get("r", i - 1).x * F.get("r", i).y) / 2
    lines = closed.withColumn("area", turns).groupBy("pour_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", "r")))).alias("c"), F.count("*").alias("n_contours"), F.sum("n").alias("n_points"), F.max("n").alias("longest"), F.sum("area").alias("area"))
    return lines.select("pour_id", F.transform("c", lambda q: q.r).alias("contours"), "n_contours", "n_points", "longest", "area")


def by_angle(points: DataFrame) -> DataFrame:
    """``(pour_id, x, y)`` points in the order of their angle around their mean, as pour_id, place, x, y: right for star-shaped outlines.

    Angles are rounded to nine digits; points of one angle go by x and y. A window sorts each shape's points, and may spill.
    """
    centre = points.groupBy("pour_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    turned = points.join(centre, "pour_id").withColumn("angle", F.round(F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")), 9))
    order = Window.partitionBy("pour_id").orderBy("angle", "x", "y")
    return turned.withColumn("place", F.row_number().over(order)).select("pour_id", "place", "x", "y")


def ordered_areas(ordered: DataFrame) -> DataFrame:
    """pour_id, n_points, area: of the closed ring through the points in their order."""
    c, order = F.col, Window.partitionBy("pour_id").orderBy("place")
    nxt = lambda k: F.coalesce(F.lead(k).over(order), F.first(k).over(order))
    cross = ordered.withColumns({"nx": nxt("x"), "ny": nxt("y")}).withColumn("cross", c("x") * c("ny") - c("nx") * c("y"))
    return cross.groupBy("pour_id").agg(F.count("*").alias("n_points"), (F.abs(F.sum("cross")) / 2).alias("area"))
