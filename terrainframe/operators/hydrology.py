"""Flow graphs: networks, accumulation, watersheds.

Enforced flow codes descend strictly, so the network is a forest. Fix-points over it use pointer doubling: after round k a
cell knows its ancestor 2**k steps down, so a river of a million cells takes twenty rounds, each two joins on cell keys. Rounds
are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrainframe.operators.fill import fill
from terrainframe.operators.stencil import STEPS, Grid
from terrainframe.tables import discard, materialise, written

__all__ = [
    "accumulate", "areas", "boundary", "downstream", "fill", "hops_to_outlet", "materialise", "network", "perimeters", "streams", "subtree",
    "upstream_degree", "watershed_counts", "watershed_sums", "watersheds",
]


def downstream(flow: DataFrame, grid: Grid) -> DataFrame:
    """row, col, to_row, to_col of every cell with a code, within the grid."""
    step = lambda axis: F.create_map(*[F.lit(x) for k, s in STEPS.items() for x in (k, s[axis])])
    out = flow.where("code <> 0").select("row", "col", (F.col("row") + step(0)[F.col("code")]).alias("to_row"), (F.col("col") + step(1)[F.col("code")]).alias("to_col"))
    return out.where(F.col("to_row").between(0, grid.height - 1) & F.col("to_col").between(0, grid.width - 1))


def network(flow: DataFrame, grid: Grid) -> DataFrame:
    """Edges whose source and target both have a code: sinks and borders receive nothing."""
    targets = flow.where("code <> 0").select(F.col("row").alias("to_row"), F.col("col").alias("to_col"))
    return downstream(flow, grid).join(targets, ["to_row", "to_col"], "left_semi").select("row", "col", "to_row", "to_col")


def upstream_degree(flow: DataFrame, grid: Grid) -> DataFrame:
    """row, col, n: how many neighbours flow straight into a cell."""
    return downstream(flow, grid).groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.count("*").alias("n"))


def _doubled(jumps: DataFrame) -> DataFrame:
    """Ancestors twice as far; chains that end are dropped."""
    far = jumps.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("far_row"), F.col("to_col").alias("far_col"))
    return jumps.join(far, ["to_row", "to_col"]).select("row", "col", F.col("far_row").alias("to_row"), F.col("far_col").alias("to_col"))


def subtree(jumps: DataFrame, values: DataFrame, sums: list[str] = (), maxima: list[str] = ()) -> DataFrame:
    """``values`` (row, col and measures) with each measure summed, or its largest value taken, over a cell and all cells upstream of it.

    ``jumps`` are the edges of a forest (row, col, to_row, to_col). What lies within 2**(k + 1) steps is what lies within 2**k, with that of every cell whose
    2**k-th ancestor this is: a row a cell and round, in log2(longest river) rounds, however many cells lie on how many ways.
    """
    names = [*sums, *maxima]
    state = written(values.select("row", "col", *names), "subtree")
    jumps = jumps if hasattr(jumps, "_terrainframe_path") else written(jumps, "jumps")
    while not jumps.isEmpty():
        target = [F.col("to_row").alias("row"), F.col("to_col").alias("col")]
        more = [F.sum(k).alias(f"_{k}") for k in sums] + [F.max(k).alias(f"_{k}") for k in maxima]
        gained = jumps.join(state, ["row", "col"]).groupBy(*target).agg(*more)
        both = [(F.col(k) + F.coalesce(f"_{k}", F.lit(0))).alias(k) for k in sums] + [F.greatest(k, f"_{k}").alias(k) for k in maxima]
        new = written(state.join(gained, ["row", "col"], "left").select("row", "col", *both), "subtree")
        further = written(_doubled(jumps), "jumps")
        discard(state)
        discard(jumps)
        state, jumps = new, further
    return state


def accumulate(flow: DataFrame, grid: Grid) -> DataFrame:
    """row, col, acc: a cell and all cells upstream of it. Cells without a code stay 1."""
    jumps = written(network(flow, grid), "network")
    cells = jumps.select("row", "col").union(jumps.select("to_row", "to_col")).distinct().withColumn("acc", F.lit(1).cast("long"))
    counts = subtree(jumps, cells, ["acc"])
    return grid.cells.select("row", "col").join(counts, ["row", "col"], "left").select("row", "col", F.coalesce("acc", F.lit(1)).cast("long").alias("acc"))


def watershed_sums(flow: DataFrame, grid: Grid, pours: DataFrame, measured: DataFrame, sums: list[str], maxima: list[str] = ()) -> DataFrame:
    """pour_id and measures of ``measured`` (row, col, ...) summed, or the largest, over each pour's watershed, without a row for each of its cells.

    The walk's graph holds every cell that flows somewhere and every cell it flows to; a pour cell off it is alone, one off the grid has no row.
    """
    found = subtree(downstream(flow, grid), measured, sums, maxima)
    inside = pours.select("pour_id", "row", "col").where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))
    return inside.join(found, ["row", "col"]).select("pour_id", *sums, *maxima)


def watershed_counts(flow: DataFrame, grid: Grid, pours: DataFrame, acc: DataFrame, threshold: int) -> DataFrame:
    """pour_id, n_cells, n_stream (cells that gather at least ``threshold``), max_acc."""
    measured = acc.select("row", "col", F.lit(1).cast("long").alias("n_cells"), (F.col("acc") >= threshold).cast("long").alias("n_stream"), F.col("acc").alias("max_acc"))
    return watershed_sums(flow, grid, pours, measured, ["n_cells", "n_stream"], ["max_acc"])


def hops_to_outlet(flow: DataFrame, grid: Grid) -> DataFrame:
    """row, col, hops: steps to the end of the downstream walk, for cells with a code. Ends point at themselves; jumps double."""
    down = downstream(flow, grid)
    ends = down.select(F.col("to_row").alias("row"), F.col("to_col").alias("col")).distinct().join(flow.where("code <> 0").select("row", "col"), ["row", "col"], "left_anti")
    state = down.withColumn("hops", F.lit(1).cast("long")).unionByName(ends.select("row", "col", F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.lit(0).cast("long").alias("hops")))
    state = written(state.withColumn("moved", F.lit(True)), "hops")
    while not state.where("moved").isEmpty():
        far = state.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("far_row"), F.col("to_col").alias("far_col"), F.col("hops").alias("more"))
        moved = (F.col("far_row") != F.col("to_row")) | (F.col("far_col") != F.col("to_col"))
        joined = state.join(far, ["to_row", "to_col"])
        new = written(joined.select("row", "col", F.col("far_row").alias("to_row"), F.col("far_col").alias("to_col"), (F.col("hops") + F.col("more")).alias("hops"), moved.alias("moved")), "hops")
        discard(state)
        state = new
    return state.where("hops > 0").select("row", "col", "hops")


def watersheds(flow: DataFrame, grid: Grid, pours: DataFrame) -> DataFrame:
    """pour_id, row, col: each pour cell and every cell whose walk reaches it, for all pours ``(pour_id, row, col)`` at once.

    A flow that is still a plan is written first: filters on its codes would be pushed below them, with a copy of the whole stencil's arithmetic for each use of a code.
    """
    flow = flow if hasattr(flow, "_terrainframe_path") else written(flow.select("row", "col", "code"), "flow")
    jumps = written(downstream(flow, grid), "walks")
    held = written(pours.select("pour_id", "row", "col").where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1)), "held")
    while not jumps.isEmpty():
        met = held.select("pour_id", F.col("row").alias("to_row"), F.col("col").alias("to_col"))
        gained = jumps.join(met, ["to_row", "to_col"]).select("pour_id", "row", "col")
        new = written(held.unionByName(gained), "held")
        further = written(_doubled(jumps), "walks")
        discard(held)
        discard(jumps)
        held, jumps = new, further
    return held


def streams(acc: DataFrame, cells: DataFrame, threshold: int = 1000) -> DataFrame:
    """Watershed cells that gather at least ``threshold`` cells."""
    return cells.join(acc.where(F.col("acc") >= threshold), ["row", "col"]).select(*cells.columns, "acc")


def boundary(cells: DataFrame) -> DataFrame:
    """Watershed cells of which one of the eight neighbours is outside; the grid's edge is outside."""
    spread = F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.lit(k).alias("k")) for k, (dr, dc) in {0: (0, 0), **STEPS}.items()])
    sent = cells.select("pour_id", F.explode(spread).alias("m")).select("pour_id", "m.row", "m.col", "m.k")
    around = sent.groupBy("pour_id", "row", "col").agg(F.max(F.col("k") == 0).alias("here"), F.count("*").alias("n"))
    return around.where("here and n < 9").select("pour_id", "row", "col")


def areas(cells: DataFrame, resolution: float) -> DataFrame:
    """pour_id, n_cells, area_km2."""
    return cells.groupBy("pour_id").agg(F.count("*").alias("n_cells")).withColumn("area_km2", F.col("n_cells") * (resolution * resolution) / 1e6)


def perimeters(edge: DataFrame, resolution: float) -> DataFrame:
    """pour_id, n_boundary, perimeter_km."""
    return edge.groupBy("pour_id").agg(F.count("*").alias("n_boundary")).withColumn("perimeter_km", F.col("n_boundary") * resolution / 1000)
