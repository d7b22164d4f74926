"""Data validators: one aggregation, then a rule table in long form (rule, severity, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrainframe.functions.means import exact_mean

#: DEM limits (fixed values).
NODATA_ERROR, NODATA_WARN, NODATA_NOTE = 80.0, 50.0, 20.0
ELEVATION_LEAST, ELEVATION_MOST, ALL_HIGH, FLAT_STD, RANGE_MOST = -500.0, 5000.0, 4000.0, 1.0, 6000.0


def dem_stats(cells: DataFrame) -> DataFrame:
    return cells.agg(
        F.count("*").alias("n_cells"), F.count("elev").alias("n_valid"), F.min("elev").alias("elev_min"), F.max("elev").alias("elev_max"), exact_mean("elev", 1000).alias("elev_mean"),
        F.stddev_pop("elev").alias("elev_std"), (F.avg(F.col("elev").isNotNull().cast("double")) * 100).alias("valid_pct"),
    )


def long_rules(row: DataFrame, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """The rules that fire: (rule, severity, fires, value)."""
    fired = F.array_compact(F.array(*[F.when(fires, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), value.cast("double").alias("value"))) for rule, severity, fires, value in rules]))
    return row.select(F.explode(fired).alias("r")).select("r.rule", "r.severity", "r.value")


def dem_quality(cells: DataFrame) -> DataFrame:
    """No-data and elevation rules over the whole grid; limits above."""
    c = F.col
    gone = (F.avg(c("elev").isNull().cast("double")) * 100).alias("gone")
    row = cells.agg(gone, F.min("elev").alias("low"), F.max("elev").alias("high"), F.stddev_pop("elev").alias("std"))
    rules = [
        ("nodata_share", "error", c("gone") > NODATA_ERROR, c("gone")),
        ("nodata_share", "warning", (c("gone") > NODATA_WARN) & (c("gone") <= NODATA_ERROR), c("gone")),
        ("nodata_share", "note", (c("gone") > NODATA_NOTE) & (c("gone") <= NODATA_WARN), c("gone")),
        ("elevation_low", "warning", c("low") < ELEVATION_LEAST, c("low")), ("elevation_high", "warning", c("high") > ELEVATION_MOST, c("high")),
        ("elevation_all_high", "warning", c("low") > ALL_HIGH, c("low")), ("elevation_flat", "warning", c("std") < FLAT_STD, c("std")), ("elevation_range", "warning", c("high") - c("low") > RANGE_MOST, c("high") - c("low")),
    ]
    return long_rules(row, rules)


def dem_admission(cells: DataFrame, resolution: float, target: float = 10.0, least_valid: float = 50.0, least_range: float = 10.0) -> DataFrame:
    """resolution_ok, coverage_ok, range_ok, admitted."""
    checks = dem_stats(cells).select((F.lit(resolution) <= 2 * target).alias("resolution_ok"), (F.col("valid_pct") >= least_valid).alias("coverage_ok"), (F.col("elev_max") - F.col("elev_min") >= least_range).alias("range_ok"))
    return checks.withColumn("admitted", F.col("resolution_ok") & F.col("coverage_ok") & F.col("range_ok"))


def dem_suitability(cells: DataFrame) -> DataFrame:
    """data_ok, stats_ok, relief_ok, suitable: enough cells with data, statistics at all, and some relief."""
    checks = dem_stats(cells).select((F.col("valid_pct") >= 100 - NODATA_ERROR).alias("data_ok"), (F.col("n_valid") > 0).alias("stats_ok"), F.coalesce(F.col("elev_std") >= FLAT_STD, F.lit(False)).alias("relief_ok"))
    return checks.withColumn("suitable", F.col("data_ok") & F.col("stats_ok") & F.col("relief_ok"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_null, null_pct in one pass."""
    counted = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("n_null")) for c in columns])
    return counted.select("n", F.explode(rows).alias("r")).select("r.column_name", "r.n_null", (F.try_divide(F.col("r.n_null"), F.col("n")) * 100).alias("null_pct"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """n_rows, n_distinct, n_duplicate: rows beyond the first of each key; null keys are one."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicate"))


def ranges(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """column, low, high, n_below, n_above."""
    counted = df.agg(*[x for c, (a, b) in limits.items() for x in (F.min(c).cast("double").alias(f"low_{c}"), F.max(c).cast("double").alias(f"high_{c}"), F.count_if(F.col(c) < a).alias(f"below_{c}"), F.count_if(F.col(c) > b).alias(f"above_{c}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"low_{c}").alias("low"), F.col(f"high_{c}").alias("high"), F.col(f"below_{c}").alias("n_below"), F.col(f"above_{c}").alias("n_above")) for c in limits])
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def unexpected(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values outside the allowed set, with their counts."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).groupBy(F.col(column).alias("found")).agg(F.count("*").alias("n"))


def regressions(base: DataFrame, current: DataFrame, limit: float) -> DataFrame:
    """metric, change, direction, regressed from ``(metric, value)``: absolute relative change over the limit; a zero base is skipped."""
    pairs = base.select("metric", F.col("value").alias("was")).join(current.select("metric", F.col("value").alias("is")), "metric").where("was <> 0")
    change = (F.col("is") - F.col("was")) / F.col("was")
    return pairs.select("metric", change.alias("change"), F.when(change > 0, "up").when(change < 0, "down").otherwise("same").alias("direction"), (F.abs(change) > limit).alias("regressed"))


def schema_rules(df: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """column_name, rule, severity, found: required columns that are missing, or of none of the named types (any, where none is named)."""
    kinds = dict(df.dtypes)
    rows = [(c, "missing", "error", None) for c in required if c not in kinds]
    rows += [(c, "type", "warning", kinds[c]) for c, allowed in required.items() if c in kinds and allowed and kinds[c] not in allowed]
    return df.sparkSession.createDataFrame(rows, "column_name string, rule string, severity string, found string")
