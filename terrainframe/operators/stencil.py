"""Raster stencils over a cell relation ``(row, col, elev)``; a missing cell and a null elevation are both no data.

``neighbourhood`` gathers the eight neighbours of every cell in one aggregation: each cell sends its elevation to the cells
around it, and the messages are summed in each task before the shuffle, so about one row a cell is exchanged. All
stencils are plain column expressions over its result, inside whole-stage code generation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrainframe.tables import shuffle_parts, shuffled

#: Direction codes 1 to 8 with their row and column steps, clockwise from north.
STEPS = {1: (-1, 0), 2: (-1, 1), 3: (0, 1), 4: (1, 1), 5: (1, 0), 6: (1, -1), 7: (0, -1), 8: (-1, -1)}
#: Facets as pairs of direction codes, counter-clockwise from east; facet i spans from i to i + 1 eighths of a turn.
FACETS = [(3, 2), (2, 1), (1, 8), (8, 7), (7, 6), (6, 5), (5, 4), (4, 3)]


@dataclass
class Grid:
    """A raster: its cells and its size. Rows count from the north."""

    cells: DataFrame
    height: int
    width: int

    @property
    def interior(self) -> Column:
        return F.col("row").between(1, self.height - 2) & F.col("col").between(1, self.width - 2)


def neighbourhood(grid: Grid) -> DataFrame:
    """row, col, z and e1 .. e8 of every cell of the relation."""
    messages = F.array(F.struct(F.lit(0).alias("k"), F.col("row").alias("r"), F.col("col").alias("c")), *[F.struct(F.lit(k).alias("k"), (F.col("row") - dr).alias("r"), (F.col("col") - dc).alias("c")) for k, (dr, dc) in STEPS.items()])
    sent = grid.cells.select("elev", F.explode(messages).alias("m")).select(F.col("m.r").alias("row"), F.col("m.c").alias("col"), "m.k", "elev")
    own = lambda k: F.max(F.when(F.col("k") == k, F.col("elev")))
    around = sent.groupBy("row", "col").agg(F.max(F.col("k") == 0).alias("here"), own(0).alias("z"), *[own(k).alias(f"e{k}") for k in STEPS])
    return around.where("here").drop("here")


def _first_of(values: dict[int, Column], top: Column) -> Column:
    """The first key whose value is the top one."""
    return reduce(lambda out, kv: out.when(kv[1] == top, kv[0]), list(values.items())[1:], F.when(next(iter(values.values())) == top, next(iter(values))))


def drops() -> dict[int, Column]:
    return {k: F.col("z") - F.col(f"e{k}") for k in STEPS}


def d8(grid: Grid, enforce: bool = True) -> DataFrame:
    """row, col, elev, code, drop: the steepest raw drop, first direction on ties. Border and no-data cells have code 0.

    With ``enforce`` a target must be strictly lower, else the code is 0; without, a pit keeps its least bad direction.
    """
    top = F.greatest(*drops().values())
    found = neighbourhood(grid).withColumn("top", F.when(grid.interior & F.col("z").isNotNull(), top))
    flows = F.col("top") > 0 if enforce else F.col("top").isNotNull()
    code = F.when(flows, _first_of(drops(), F.col("top"))).otherwise(0)
    return found.select("row", "col", F.col("z").alias("elev"), code.cast("int").alias("code"), F.when(flows, F.col("top")).alias("drop"))


def mfd(grid: Grid) -> DataFrame:
    """row, col, code, n_lower: the dominant of several flow directions and how many neighbours are lower."""
    lower = reduce(lambda a, b: a + b, [F.when(d > 0, 1).otherwise(0) for d in drops().values()])
    top = F.greatest(*drops().values())
    here = grid.interior & F.col("z").isNotNull()
    found = neighbourhood(grid).withColumn("top", F.when(here, top))
    return found.select("row", "col", F.when(F.col("top") > 0, _first_of(drops(), F.col("top"))).otherwise(0).cast("int").alias("code"), F.when(here, lower).otherwise(0).cast("int").alias("n_lower"))


def dinf(grid: Grid) -> DataFrame:
    """row, col, angle, slope of interior cells with data: per facet the larger drop, its angle an eighth of half a turn to that side."""
    turn = 2 * math.pi
    found = neighbourhood(grid).where(grid.interior & F.col("z").isNotNull())
    d = drops()
    facets = []
    for i, (a, b) in enumerate(FACETS):
        base = i * math.pi / 4
        flat = (d[a] <= 0) & (d[b] <= 0)
        slope = F.when(flat, 0.0).otherwise(F.greatest(d[a], d[b]))
        angle = F.when(flat, base).when(d[a] > d[b], (base - math.pi / 8) % turn).otherwise((base + math.pi / 8) % turn)
        facets.append(F.when(d[a].isNotNull() & d[b].isNotNull(), F.struct(slope.alias("slope"), F.lit(-i).alias("order"), angle.alias("angle"))))
    best = F.greatest(*facets)
    return found.withColumn("best", best).select("row", "col", F.coalesce("best.angle", F.lit(0.0)).alias("angle"), F.coalesce("best.slope", F.lit(0.0)).alias("slope"))


def gradient_angle(grid: Grid) -> DataFrame:
    """row, col, angle in degrees from central differences, 0 where both vanish; interior cells whose four neighbours have data."""
    dx, dy = (F.col("e3") - F.col("e7")) / 2, (F.col("e1") - F.col("e5")) / 2
    turned = F.degrees(F.atan2("dy", "dx"))
    found = neighbourhood(grid).where(grid.interior & F.col("z").isNotNull()).select("row", "col", dx.alias("dx"), dy.alias("dy")).where("dx is not null and dy is not null")
    return found.select("row", "col", F.when((F.col("dx") == 0) & (F.col("dy") == 0), 0.0).otherwise(F.when(turned < 0, turned + 360).otherwise(turned)).alias("angle"))


def gradient_slope(grid: Grid) -> DataFrame:
    """row, col, slope: length of the unit-spaced gradient, one-sided at the edges; null where a needed cell has no data."""

    def along(before: str, after: str, at: Column, last: int) -> Column:
        return F.when(at == 0, F.col(after) - F.col("z")).when(at == last, F.col("z") - F.col(before)).otherwise((F.col(after) - F.col(before)) / 2)

    gy, gx = along("e1", "e5", F.col("row"), grid.height - 1), along("e7", "e3", F.col("col"), grid.width - 1)
    return neighbourhood(grid).select("row", "col", F.sqrt(gx * gx + gy * gy).alias("slope"))


def bresenham(lines: DataFrame) -> DataFrame:
    """Pixels of lines ``(line_id, r0, c0, r1, c1)``: line_id, row, col. The running error has a closed form, so pixels are a generated sequence."""
    steep = F.abs(F.col("r1") - F.col("r0")) > F.abs(F.col("c1") - F.col("c0"))
    x0, y0 = F.when(steep, F.col("r0")).otherwise(F.col("c0")), F.when(steep, F.col("c0")).otherwise(F.col("r0"))
    x1, y1 = F.when(steep, F.col("r1")).otherwise(F.col("c1")), F.when(steep, F.col("c1")).otherwise(F.col("r1"))
    turned = x0 > x1
    ends = {"xa": F.least(x0, x1), "xb": F.greatest(x0, x1), "ya": F.when(turned, y1).otherwise(y0), "yb": F.when(turned, y0).otherwise(y1)}
    found = lines.select("line_id", steep.alias("steep"), *[v.alias(k) for k, v in ends.items()])
    found = found.withColumns({"dx": F.col("xb") - F.col("xa"), "dy": F.abs(F.col("yb") - F.col("ya")), "step": F.when(F.col("ya") < F.col("yb"), 1).otherwise(-1)})
    # lines are few and pixels many: one small file of lines must not be one task's work
    found = found.repartition(shuffle_parts(lines), "line_id", "xa", "ya").select("*", F.explode(F.sequence("xa", "xb")).alias("x"))
    # before pixel i the error is dx // 2 - i * dy + dx * steps, kept at 0 or above: steps = ceil((i * dy - dx // 2) / dx)
    i = F.col("x") - F.col("xa")
    over = i * F.col("dy") - F.floor(F.col("dx") / 2)
    steps = F.when(over > 0, F.ceil(over / F.when(F.col("dx") == 0, 1).otherwise(F.col("dx")))).otherwise(0)
    y = (F.col("ya") + F.col("step") * steps).cast("long")
    x = F.col("x").cast("long")
    return found.select("line_id", F.when(F.col("steep"), x).otherwise(y).alias("row"), F.when(F.col("steep"), y).otherwise(x).alias("col"))


def burn(grid: Grid, pixels: DataFrame, depth: float = 5.0) -> DataFrame:
    """Cells lowered by ``depth`` for each line over them; a line counts once a cell, lines add up."""
    hits = pixels.select("line_id", "row", "col").distinct().groupBy("row", "col").agg(F.count("*").alias("n"))
    return grid.cells.join(hits, ["row", "col"], "left").select("row", "col", (F.col("elev") - depth * F.coalesce("n", F.lit(0))).alias("elev"))


#: Rows, or columns, of a block that lines are counted over at once.
RUN_BLOCK = 4096


def line_runs(lines: DataFrame) -> DataFrame:
    """line_id, steep, at, low, high: pixels of lines ``(line_id, r0, c0, r1, c1)`` as straight runs: of a steep line the rows low to high of column at, else the columns of row at.

    Step j of a line's shorter way holds pixels up to (j * dx + dx // 2) // dy of its longer one, so there are as many runs as the shorter way has steps.
    """
    c = F.col
    steep = F.abs(c("r1") - c("r0")) > F.abs(c("c1") - c("c0"))
    way = lambda r, k: F.when(steep, c(r)).otherwise(c(k)).cast("long")
    x0, y0, x1, y1 = way("r0", "c0"), way("c0", "r0"), way("r1", "c1"), way("c1", "r1")
    turned = x0 > x1
    found = lines.select("line_id", steep.alias("steep"), F.least(x0, x1).alias("xa"), F.greatest(x0, x1).alias("xb"), F.when(turned, y1).otherwise(y0).alias("ya"), F.when(turned, y0).otherwise(y1).alias("yb"))
    found = found.withColumns({"dx": c("xb") - c("xa"), "dy": F.abs(c("yb") - c("ya"))}).select("*", F.explode(F.sequence(F.lit(0).cast("long"), "dy")).alias("j"))
    last = lambda j: F.when(c("dy") == 0, c("dx")).otherwise(F.least(c("dx"), F.expr(f"(({j}) * dx + dx div 2) div if(dy = 0, 1, dy)")))
    first = F.when(c("j") == 0, F.lit(0)).otherwise(last("j - 1") + 1)
    runs = found.select("line_id", "steep", (c("ya") + F.when(c("ya") < c("yb"), c("j")).otherwise(-c("j"))).alias("at"), (c("xa") + first).alias("low"), (c("xa") + last("j")).alias("high"))
    return runs.where("low <= high")


def _running(cells: DataFrame, changes: DataFrame, along: str, other: str, name: str) -> DataFrame:
    """``cells`` with ``name``, the sum of ``changes`` (row, col, d) up to them along one axis: within blocks, and what the blocks before add up to."""
    c, block = F.col, F.floor(F.col(along) / RUN_BLOCK).alias("_block")
    both = cells.withColumns({"d": F.lit(0).cast("long"), "_cell": F.lit(True)}).unionByName(changes.groupBy("row", "col").agg(F.sum("d").alias("d")).withColumn("_cell", F.lit(False)), allowMissingColumns=True).withColumn("_block", block)
    before = Window.partitionBy(other).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = shuffled(both.groupBy(other, "_block").agg(F.sum("d").alias("d")).select(c(other).alias("_other"), c("_block").alias("_of"), F.coalesce(F.sum("d").over(before), F.lit(0)).alias("_carried")))
    upto = Window.partitionBy(other, "_block").orderBy(along).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = both.withColumn(name, F.sum("d").over(upto)).where("_cell")
    same = c(other).eqNullSafe(c("_other")) & c("_block").eqNullSafe(c("_of"))
    return summed.join(carried, same).withColumn(name, c(name) + c("_carried")).drop("d", "_cell", "_block", "_other", "_of", "_carried")


def burn_lines(grid: Grid, lines: DataFrame, depth: float = 5.0) -> DataFrame:
    """``burn`` of lines ``(line_id, r0, c0, r1, c1)`` by the ends of their runs: no row a pixel, so long lines cost no more than short ones.

    Pixels are made of lines of several segments alone, as a line counts once a cell.
    """
    c = F.col
    segments = lines.select("line_id", "r0", "c0", "r1", "c1").distinct()
    counted = segments.withColumn("_n", F.count("*").over(Window.partitionBy("line_id")))
    runs = line_runs(counted.where("_n = 1"))
    spots = bresenham(counted.where("_n > 1")).distinct().select("line_id", F.lit(True).alias("steep"), c("col").alias("at"), c("row").alias("low"), c("row").alias("high"))
    ends = runs.unionByName(spots).select("steep", "at", F.explode(F.array(F.struct(c("low").alias("x"), F.lit(1).cast("long").alias("d")), F.struct((c("high") + 1).alias("x"), F.lit(-1).cast("long").alias("d")))).alias("e"))
    down = ends.where("steep").select(c("e.x").alias("row"), c("at").alias("col"), "e.d")
    across = ends.where("not steep").select(c("at").alias("row"), c("e.x").alias("col"), "e.d")
    found = _running(_running(grid.cells.select("row", "col", "elev"), down, "row", "col", "_down"), across, "col", "row", "_across")
    return found.select("row", "col", (c("elev") - depth * (c("_down") + c("_across"))).alias("elev"))


def smooth(grid: Grid, sigma: float = 0.5) -> DataFrame:
    """Gaussian of five taps in each direction, reflected at the edges. Cells without data stay so, and weigh nothing in others."""
    taps = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-2, 3)]
    weight = [t / sum(taps) for t in taps]

    def spread(cells: DataFrame, axis: str, size: int) -> DataFrame:
        mirrored = lambda i: F.when(i < 0, -1 - i).when(i >= size, 2 * size - 1 - i).otherwise(i)
        other = "col" if axis == "row" else "row"
        sent = [F.struct(F.lit(float(w)).alias("w"), (F.col(axis) + k).alias("to")) for k, w in zip(range(-2, 3), weight, strict=True)]
        out = cells.select(other, "elev", F.explode(F.array(*sent)).alias("m"))
        # a tap beyond the edge is the mirrored cell: what a cell sends outside comes back to the mirrored place
        out = out.select(other, "elev", F.col("m.w").alias("w"), mirrored(F.col("m.to")).alias(axis))
        return out.groupBy("row", "col").agg((F.sum(F.col("elev") * F.col("w")) / F.sum(F.when(F.col("elev").isNotNull(), F.col("w")))).alias("elev"))

    once = spread(grid.cells.where("elev is not null"), "row", grid.height)
    twice = spread(once, "col", grid.width)
    return grid.cells.select("row", "col", F.col("elev").alias("raw")).join(twice, ["row", "col"], "left").select("row", "col", F.when(F.col("raw").isNotNull(), F.col("elev")).alias("elev"))
