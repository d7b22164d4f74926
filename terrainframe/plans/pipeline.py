"""Stages over files: each writes Parquet, is skipped when its output is complete, and is tried again with growing pauses."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrainframe.functions import classify
from terrainframe.operators import joins, sampling, scoring


@dataclass
class Stage:
    name: str
    build: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    needs: list[str] = field(default_factory=list)


def complete(spark: SparkSession, path: str) -> bool:
    """Spark marks a whole output with a _SUCCESS file; the path may be in any store."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop))


def run(spark: SparkSession, stages: list[Stage], out: str, tries: int = 3, pause_s: float = 30.0) -> DataFrame:
    """Runs what is missing; returns stage, status, seconds, error. Stops at the first stage that fails all its tries."""
    done: dict[str, DataFrame] = {}
    status = []
    for stage in stages:
        path, began, error = f"{out}/{stage.name}", time.time(), None
        missing = [n for n in stage.needs if n not in done]
        state = "blocked" if missing else "skipped" if complete(spark, path) else "failed"
        for attempt in range(tries if state == "failed" else 0):
            if attempt:
                time.sleep(pause_s * 2 ** (attempt - 1))
            try:
                stage.build(spark, done).write.mode("overwrite").parquet(path)
                state, error = "completed", None
                break
            except Exception as e:  # noqa: BLE001  the report carries it
                error = str(e)[:500]
        status.append((stage.name, state, time.time() - began, error or (f"needs {missing}" if missing else None)))
        if state in ("completed", "skipped"):
            done[stage.name] = spark.read.parquet(path)
    return spark.createDataFrame(status, "stage string, status string, seconds double, error string")


def accuracy_stages(basins: DataFrame, flowlines: DataFrame, catchments: DataFrame, per_stratum: int = 2, snap: float = 4.0, radius: float = 6.0) -> list[Stage]:
    """Sampling, truth extraction and scoring of predicted boxes, as stages."""

    def sample(spark: SparkSession, _: dict[str, DataFrame]) -> DataFrame:
        c = F.col
        points = basins.select(c("basin_id").alias("point_id"), ((c("x0") + c("x1")) / 2).alias("px"), ((c("y0") + c("y1")) / 2).alias("py"))
        snapped = joins.snap(points, flowlines, snap).withColumnRenamed("point_id", "basin_id").select("basin_id", "x", "y", "snapped")
        found = classify.qcut3(basins, "stream_density", "complexity").withColumns({"size": classify.size_class_closed(c("area_km2")), "terrain": classify.terrain_class(c("slope"))})
        return sampling.stratified(found, "basin_id", ["size", "terrain", "complexity"], per_stratum).join(snapped, "basin_id")

    def truth(spark: SparkSession, done: dict[str, DataFrame]) -> DataFrame:
        points = done["sample"].select(F.col("basin_id").alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py"))
        return joins.truth_pick(joins.truth_candidates(points, catchments, radius)).withColumnRenamed("point_id", "basin_id")

    def scores(spark: SparkSession, done: dict[str, DataFrame]) -> DataFrame:
        boxes = catchments.select("catchment_id", *[F.col(k).alias(f"t{k}") for k in ("x0", "y0", "x1", "y1")])
        pairs = done["sample"].join(done["truth"].join(boxes, "catchment_id"), "basin_id", "left")
        c = F.col
        side = lambda a, b, p, q: F.greatest(F.lit(0.0), F.least(c(b), c(q)) - F.greatest(c(a), c(p)))
        common = F.when(c("tx0").isNotNull(), side("x0", "x1", "tx0", "tx1") * side("y0", "y1", "ty0", "ty1"))
        both = (c("x1") - c("x0")) * (c("y1") - c("y0")) + (c("tx1") - c("tx0")) * (c("ty1") - c("ty0")) - common
        offset = F.hypot((c("x0") + c("x1") - c("tx0") - c("tx1")) / 2, (c("y0") + c("y1") - c("ty0") - c("ty1")) / 2)
        return scoring.assess(pairs.select("basin_id", "terrain", "size", F.try_divide(common, both).alias("iou"), offset.alias("centroid_m"), "method"))

    return [Stage("sample", sample), Stage("truth", truth, ["sample"]), Stage("scores", scores, ["sample", "truth"])]
