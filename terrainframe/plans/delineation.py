"""The composed plan: fill, direct, accumulate, trace every pour point at once, outline, grade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrainframe.functions import geometry as g
from terrainframe.operators import hydrology, outlines, scoring, stencil
from terrainframe.operators.stencil import Grid
from terrainframe.tables import written

#: Bounds of a plausible watershed (fixed values): least and largest square kilometres, largest P squared over A.
AREA_LEAST, AREA_MOST, COMPLEX_MOST = 0.01, 10_000.0, 100.0


def delineate(grid: Grid, pours: DataFrame, origin: tuple[float, float], step: float, resolution: float, filled: bool = True, threshold: int = 1000) -> DataFrame:
    """One row a pour point ``(pour_id, row, col)``: cells, area, stream cells, outline, holes, crossings, errors and topology score.

    Traced outlines turn left where they meet themselves, so they never cross and are valid as they are.
    """
    ground = Grid(written(hydrology.fill(grid), "filled"), grid.height, grid.width) if filled else grid
    flow = written(stencil.d8(ground), "flow")
    acc = hydrology.accumulate(flow, grid)
    shed = written(hydrology.watersheds(flow, grid, pours), "sheds")
    counts = hydrology.watershed_counts(flow, grid, pours, acc, threshold)
    shapes = outlines.outlines(shed, *origin, step)
    outer = F.col("rings")[0]
    joined = counts.join(shapes, "pour_id").withColumns({"area_km2": F.col("n_cells") * (resolution * resolution) / 1e6, "m": g.measures(outer), "crossings": F.lit(0).cast("long")})
    valid = F.col("n_outer") >= 1
    errors = F.array_compact(F.array(
        F.when(~valid, "invalid_geometry"), F.when(F.col("crossings") > 0, "not_simple"), F.when(F.col("area_km2") < AREA_LEAST, "too_small"), F.when(F.col("area_km2") > AREA_MOST, "too_large"),
        F.when(g.shape_complexity(F.col("m.area"), F.col("m.length")) > COMPLEX_MOST, "too_complex"),
    ))
    graded = joined.withColumn("errors", errors).withColumn("score", scoring.topology_score(valid, F.col("crossings") == 0, F.col("n_holes"), F.col("crossings"), F.size(errors)))
    return graded.select("pour_id", "n_cells", "area_km2", "n_stream", "rings", "n_holes", "crossings", "errors", "score")
