"""Stratified sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified(df: DataFrame, key: str, strata: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows a stratum by the hash of seed and key, all of a smaller one; a null part of a stratum reads "nan".

    The rank filter is pushed into the window, so each task keeps at most ``n`` rows a stratum before the shuffle.
    """
    stratum = F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in strata])
    order = Window.partitionBy("stratum").orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")).cast("binary")), key)
    return df.withColumn("stratum", stratum).withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= n)
