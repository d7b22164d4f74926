"""Scores of predicted against true basins: pass rules and grouped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrainframe.functions.means import exact_mean
from terrainframe.functions.quantiles import with_quantiles

#: Thresholds by terrain (fixed values): least IoU, largest centroid offset in metres; the last pair for any other terrain.
IOU_LEAST = {"flat": 0.95, "moderate": 0.92, "steep": 0.85}
CENTROID_MOST = {"flat": 200.0, "moderate": 500.0, "steep": 1000.0}
IOU_DEFAULT, CENTROID_DEFAULT = 0.90, 500.0
TARGET_RUNTIME_S, TARGET_IOU = 30.0, 0.95


def _lookup(key: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def assess(scores: DataFrame) -> DataFrame:
    """iou_target, centroid_target, iou_pass, centroid_pass, overall_pass; a missing measure fails."""
    targets = scores.withColumns({"iou_target": _lookup(F.col("terrain"), IOU_LEAST, IOU_DEFAULT), "centroid_target": _lookup(F.col("terrain"), CENTROID_MOST, CENTROID_DEFAULT)})
    judged = targets.withColumns({"iou_pass": F.coalesce(F.col("iou") >= F.col("iou_target"), F.lit(False)), "centroid_pass": F.coalesce(F.col("centroid_m") <= F.col("centroid_target"), F.lit(False))})
    return judged.withColumn("overall_pass", F.col("iou_pass") & F.col("centroid_pass"))


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double")) * 100


def measures() -> list[Column]:
    return [F.count("*").alias("n"), exact_mean("iou").alias("iou_mean"), F.count_if(F.col("iou").isNull()).alias("n_invalid"), share(F.col("iou").isNull()).alias("invalid_pct"), exact_mean("runtime_s").alias("runtime_mean")]


def rates() -> list[Column]:
    return [share(F.col("iou_pass")).alias("iou_pass_pct"), share(F.col("centroid_pass")).alias("centroid_pass_pct"), share(F.col("overall_pass")).alias("overall_pass_pct")]


def overall(scores: DataFrame) -> DataFrame:
    wanted = {"iou": {"iou_median": 0.5, "iou_p90": 0.9, "iou_p95": 0.95}, "runtime_s": {"runtime_median": 0.5, "runtime_p95": 0.95}}
    return with_quantiles(assess(scores).agg(*measures(), *rates()), scores, wanted)


def by(scores: DataFrame, key: str) -> DataFrame:
    found = assess(scores).groupBy(key).agg(F.count("*").alias("n"), exact_mean("iou").alias("iou_mean"), *rates())
    return with_quantiles(found, scores, {"iou": {"iou_median": 0.5}}, [key])


def targets(scores: DataFrame) -> DataFrame:
    """Runtime share over all rows, IoU share over rows that have one."""
    return scores.agg(share(F.col("runtime_s") <= TARGET_RUNTIME_S).alias("runtime_met_pct"), (F.avg(F.when(F.col("iou").isNotNull(), (F.col("iou") >= TARGET_IOU).cast("double"))) * 100).alias("iou_met_pct"))


def outliers(scores: DataFrame, low_iou: float = 0.8, slow_s: float = 60.0) -> DataFrame:
    return scores.agg(F.count_if(F.col("iou") < low_iou).alias("n_low_iou"), F.count_if(F.col("runtime_s") > slow_s).alias("n_slow"), F.count_if(F.col("iou").isNull()).alias("n_invalid"))


def truth_quality(pairs: DataFrame, low: float = 0.5, high: float = 2.0, least: float = 0.1) -> DataFrame:
    """Issues of each truth polygon from ``(id, valid, truth_area, sample_area)``; a missing or zero sample area skips the ratio."""
    ratio = F.when(F.col("sample_area") > 0, F.col("truth_area") / F.col("sample_area"))
    issues = F.array_compact(F.array(F.when(~F.col("valid"), "invalid_topology"), F.when((ratio < low) | (ratio > high), "area_ratio_violation"), F.when(F.col("truth_area") < least, "area_too_small")))
    return pairs.withColumn("issues", issues)


#: Grades by least IoU, and what a topology score loses (fixed values).
GRADES = {"Excellent": 0.95, "Good": 0.90, "Fair": 0.80, "Poor": 0.70}
LOSS_INVALID, LOSS_NOT_SIMPLE = 0.5, 0.3
LOSS_HOLE, LOSS_HOLES, LOSS_CROSSING, LOSS_CROSSINGS, LOSS_ERROR, LOSS_ERRORS = 0.1, 0.3, 0.05, 0.2, 0.05, 0.3
TOPOLOGY_GOOD = 0.8
#: Overall quality of a good topology by how many of performance and accuracy are met, of those that were measured (fixed values).
QUALITY = {2: ("Fair", "Good", "Excellent"), 1: ("Fair", "Good")}


def accuracy_grade(iou: Column) -> Column:
    return F.coalesce(*[F.when(iou >= least, grade) for grade, least in GRADES.items()], F.lit("Unacceptable"))


def overall_quality(performance: Column, topology: Column, accuracy: Column) -> Column:
    """A null accuracy means that none was measured."""
    met = performance.cast("int") + F.coalesce(accuracy.cast("int"), F.lit(0))
    by = {n: F.array(*map(F.lit, names)) for n, names in QUALITY.items()}
    return F.when(topology > TOPOLOGY_GOOD, F.get(F.when(accuracy.isNull(), by[1]).otherwise(by[2]), met)).otherwise("Poor")


def topology_score(valid: Column, simple: Column, holes: Column, crossings: Column, errors: Column) -> Column:
    lost = F.when(valid, 0.0).otherwise(LOSS_INVALID) + F.when(simple, 0.0).otherwise(LOSS_NOT_SIMPLE)
    for count, each, most in ((holes, LOSS_HOLE, LOSS_HOLES), (crossings, LOSS_CROSSING, LOSS_CROSSINGS), (errors, LOSS_ERROR, LOSS_ERRORS)):
        lost += F.least(count * each, F.lit(most))
    return F.greatest(1.0 - lost, F.lit(0.0))
