"""Exact linear quantiles without one task that holds every distinct value.

A first pass finds, for each quantile, two values that lie ``MARGIN`` of the rows to its sides (approximate percentiles, whose rank
error is at most a tenth of that by their accuracy). A second pass counts what lies below the lower one and sums up the values
in between, about twice ``MARGIN`` of the rows, by value; a window over these few finds the two ranks that the quantile lies between.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARGIN, ACCURACY = 0.001, 10_000
#: Parts that each group's rows are dealt to.
SALTS = 64


def exact_quantiles(df: DataFrame, column: str, quantiles: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """``by`` columns and one double for each named quantile; nulls don't count, a group without values has nulls. Keys are compared null-safe."""
    keys = [F.col(k).alias(f"_{k}") for k in by or []]
    values = df.select(*keys, F.col(column).cast("double").alias("v"))
    own = [f"_{k}" for k in by or []]
    names = list(quantiles)
    low = F.array(*[F.lit(max(0.0, q - MARGIN)) for q in quantiles.values()])
    high = F.array(*[F.lit(min(1.0, q + MARGIN)) for q in quantiles.values()])
    bounds = values.groupBy(*own).agg(F.count("v").alias("n"), F.percentile_approx("v", low, ACCURACY).alias("low"), F.percentile_approx("v", high, ACCURACY).alias("high"), F.min("v").alias("least"), F.max("v").alias("most"))
    few = F.col("n") < 5 / MARGIN  # the margin is less than a few rows: all lie in between
    all_of = lambda c: F.array_repeat(F.col(c), len(names))
    bounds = bounds.withColumns({"low": F.when(few, all_of("least")).otherwise(F.col("low")), "high": F.when(few, all_of("most")).otherwise(F.col("high"))})
    item = lambda i, q: F.struct(F.lit(i).alias("i"), F.get("low", i).alias("low"), F.get("high", i).alias("high"), ((F.col("n") - 1) * F.lit(q)).alias("at"))
    tasks = bounds.select(*[F.col(k) for k in own], F.explode(F.array(*[item(i, q) for i, q in enumerate(quantiles.values())])).alias("t")).select(*own, "t.*")
    same: Column = reduce(lambda a, k: a & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")), own, F.lit(True))
    salt = F.pmod(F.xxhash64("v", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int").alias("salt")
    given = values.where("v IS NOT NULL").select("*", salt) if own else values.where("v IS NOT NULL")  # one group's rows must not meet in one task
    tasks = tasks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))) if own else F.broadcast(tasks)
    same = same & (F.col("a.salt") == F.col("b.salt")) if own else same
    met = given.alias("a").join(tasks.alias("b"), same & (F.col("v") <= F.col("b.high"))).select(*[F.col(f"a.{k}") for k in own], "i", "at", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v"))
    counted = met.groupBy(*own, "i", "at", "v").agg(F.count("*").alias("c"))
    order = Window.partitionBy(*own, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counted.withColumn("upto", F.sum("c").over(order)).where("v IS NOT NULL")
    rank = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    pair = upto.groupBy(*own, "i").agg(rank(F.floor("at")).alias("lower"), rank(F.ceil("at")).alias("upper"), F.first("at").alias("at"))
    value = F.when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise((F.ceil("at") - F.col("at")) * F.col("lower") + (F.col("at") - F.floor("at")) * F.col("upper"))
    wide = pair.groupBy(*own).agg(*[F.max(F.when(F.col("i") == i, value)).alias(name) for i, name in enumerate(names)])
    return wide.select(*[F.col(f"_{k}").alias(k) for k in by or []], *names)


def with_quantiles(aggregated: DataFrame, df: DataFrame, columns: dict[str, dict[str, float]], by: list[str] | None = None) -> DataFrame:
    """``aggregated``, one row for each group of ``by``, with exact quantiles of ``df``: {column: {name: quantile}}."""
    out = aggregated
    for column, quantiles in columns.items():
        found = exact_quantiles(df, column, quantiles, by)
        if not by:
            out = out.join(F.broadcast(found), F.lit(True), "left")
            continue
        found = found.select(*[F.col(k).alias(f"_{k}") for k in by], *quantiles)
        same: Column = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_{k}")), by, F.lit(True))
        out = out.join(found, same, "left").drop(*[f"_{k}" for k in by])
    return out
