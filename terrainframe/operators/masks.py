"""Cleaning of cell sets and outlines of raster classes, by outlines and neighbours; all relational."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrainframe.operators import outlines
from terrainframe.tables import shuffled

CROSS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
#: Least cells of an object that stays (fixed value).
LEAST_CELLS = 4


def filled(cells: DataFrame, least_cells: int = 1) -> DataFrame:
    """``(pour_id, row, col)`` with holes filled and filled objects (side neighbours hang together) of fewer than ``least_cells`` dropped.

    Each outer ring's inside is the filled object; objects in the hole of another lie inside it. Its cells in a row lie between its upright edges, two by two, and its area counts them.
    """
    c, side = F.col, outlines.edge_side(F.col("edge"))
    upright = outlines.rings(cells).where((side == 1) | (side == 3)).select("pour_id", "ring", (outlines.edge_row(c("edge")) - (side == 3).cast("long")).alias("row"), outlines.edge_col(c("edge")).alias("low"), (side == 1).alias("enters"))
    big = upright.groupBy("pour_id", "ring").agg(F.sum(F.when(c("enters"), -c("low")).otherwise(c("low"))).alias("n")).where(c("n") >= max(least_cells, 1))  # a hole's is below 0
    line = Window.partitionBy("pour_id", "ring", "row").orderBy("low")
    spans = upright.join(shuffled(big), ["pour_id", "ring"], "left_semi").withColumn("high", F.lead("low").over(line)).where("enters")
    inside = spans.select("pour_id", "row", F.explode(F.sequence("low", c("high") - 1)).alias("col"))
    return inside.distinct()


def closed(cells: DataFrame) -> DataFrame:
    """Closing by a cross: a cell stays or comes if it and its four neighbours each lie in or beside the set."""
    step = lambda df: df.select("pour_id", F.explode(F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr, dc in CROSS])).alias("m")).select("pour_id", "m.row", "m.col")
    wide = step(cells).distinct()
    return step(wide).groupBy("pour_id", "row", "col").agg(F.count("*").alias("n")).where(F.col("n") == len(CROSS)).select("pour_id", "row", "col")


def cleaned(cells: DataFrame, least_cells: int = LEAST_CELLS) -> DataFrame:
    """Holes filled, small objects dropped, then closed."""
    return closed(filled(cells, least_cells))


def class_outlines(cells: DataFrame, origin_x: float, origin_y: float, step: float) -> DataFrame:
    """Outlines of a raster's classes ``(value, row, col)``: value, rings, n_outer, n_holes, n_corners, area."""
    return outlines.outlines(cells.select(F.col("value").alias("pour_id"), "row", "col"), origin_x, origin_y, step).withColumnRenamed("pour_id", "value")
