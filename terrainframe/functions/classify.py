"""Bins and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrainframe.functions.quantiles import exact_quantiles


def size_class_closed(area: Column) -> Column:
    """Right-closed bins; outside 0 to 500 null."""
    return F.when((area >= 0) & (area <= 20), "small").when((area > 20) & (area <= 100), "medium").when((area > 100) & (area <= 500), "large")


def size_class_halfopen(area: Column) -> Column:
    return F.when(area < 20, "small").when(area < 100, "medium").when(area.isNotNull(), "large")


def terrain_class(slope: Column) -> Column:
    return F.when((slope >= 0) & (slope <= 5), "flat").when((slope > 5) & (slope <= 15), "moderate").when(slope > 15, "steep")


def tertiles(df: DataFrame, column: str, out: str) -> DataFrame:
    """low, medium, high by the linear quantiles at .33 and .67. One row of cut points is broadcast."""
    cuts = exact_quantiles(df, column, {"a": 0.33, "b": 0.67}).select(F.array("a", "b").alias("_cuts"))
    value = F.col(column)
    label = F.when(value <= F.col("_cuts")[0], "low").when(value <= F.col("_cuts")[1], "medium").when(value.isNotNull(), "high")
    return df.join(F.broadcast(cuts), F.lit(True), "left").withColumn(out, label).drop("_cuts")


def qcut3(df: DataFrame, column: str, out: str) -> DataFrame:
    """1, 2, 3 by quantile edges, lowest included; 1 throughout where edges coincide."""
    cuts = exact_quantiles(df, column, {"a": 0.0, "b": 1 / 3, "c": 2 / 3, "d": 1.0}).select(F.array("a", "b", "c", "d").alias("_cuts"))
    value, c = F.col(column), F.col("_cuts")
    label = F.when(F.size(F.array_distinct(c)) < 4, 1).when(value <= c[1], 1).when(value <= c[2], 2).when(value.isNotNull(), 3)
    return df.join(F.broadcast(cuts), F.lit(True), "left").withColumn(out, label.cast("int")).drop("_cuts")
