"""Comparison of several tools' results at the same places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrainframe.functions import geometry as g


def efficiency(runtime: Column, limit: Column, timed_out: Column) -> Column:
    return F.when(timed_out, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - runtime / limit)))


def status(error: Column, timed_out: Column, has_geometry: Column) -> Column:
    return F.when(error, "failed").when(timed_out, "timeout").when(~has_geometry, "partial").otherwise("success")


def pairwise(results: DataFrame) -> DataFrame:
    """Every ordered pair of tools at a place, from ``(place, tool, x0, y0, x1, y1)``: iou, distance_km, area_ratio.

    The matrix is the result, so it grows with the square of a place's tools; a tool without geometry gives 0, infinity, 0.
    """
    c = F.col
    side = lambda s: results.select("place", *[c(k).alias(f"{s}_{k}") for k in ("tool", "x0", "y0", "x1", "y1")])
    pairs = side("a").join(side("b"), "place")
    box = lambda s: [c(f"{s}_{k}") for k in ("x0", "y0", "x1", "y1")]
    area = lambda s: (c(f"{s}_x1") - c(f"{s}_x0")) * (c(f"{s}_y1") - c(f"{s}_y0"))
    both, same = c("a_x0").isNotNull() & c("b_x0").isNotNull(), c("a_tool") == c("b_tool")
    common = g.overlap_area(box("a"), box("b"))
    middle = lambda s, i, j: (c(f"{s}_{i}") + c(f"{s}_{j}")) / 2
    far = g.haversine_km(middle("a", "y0", "y1"), middle("a", "x0", "x1"), middle("b", "y0", "y1"), middle("b", "x0", "x1"))
    return pairs.select(
        "place", c("a_tool").alias("tool1"), c("b_tool").alias("tool2"),
        F.when(same, 1.0).when(both, F.coalesce(F.try_divide(common, area("a") + area("b") - common), F.lit(0.0))).otherwise(0.0).alias("iou"),
        F.when(same, 0.0).when(both, far).otherwise(F.lit(float("inf"))).alias("distance_km"),
        F.when(same, 1.0).when(both, F.coalesce(F.try_divide(area("a"), area("b")), F.lit(0.0))).otherwise(0.0).alias("area_ratio"),
    )


def agreement(pairs: DataFrame) -> DataFrame:
    """place, agreement: mean IoU of different tools, failed ones counting 0."""
    return pairs.groupBy("place").agg(F.coalesce(F.avg(F.when(F.col("tool1") != F.col("tool2"), F.col("iou"))), F.lit(0.0)).alias("agreement"))


def best_tools(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """place, fastest and most_accurate among successful tools; accuracy needs two of them. First name on ties."""
    done = results.where("success").select("place", "tool", "runtime_s")
    fastest = done.groupBy("place").agg(F.min(F.struct("runtime_s", "tool"))["tool"].alias("fastest"), F.count("*").alias("n_success"))
    ok1, ok2 = done.select("place", F.col("tool").alias("tool1")), done.select("place", F.col("tool").alias("tool2"))
    means = pairs.where("tool1 <> tool2").join(ok1, ["place", "tool1"], "left_semi").join(ok2, ["place", "tool2"], "left_semi").groupBy("place", "tool1").agg(F.avg("iou").alias("mean"))
    accurate = means.groupBy("place").agg(F.min(F.struct((-F.round("mean", 9)).alias("m"), "tool1"))["tool1"].alias("most_accurate"))
    return fastest.join(accurate, "place", "left").select("place", "fastest", "most_accurate", "n_success")


def by_tool(results: DataFrame) -> DataFrame:
    return results.groupBy("tool").agg(F.count("*").alias("runs"), (F.avg(F.col("success").cast("double")) * 100).alias("success_pct"), F.avg(F.when(F.col("success"), F.col("runtime_s"))).alias("mean_runtime_s"))
