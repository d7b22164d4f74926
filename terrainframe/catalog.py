"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrainframe.plans import monitoring, raster, reports, shapes, upkeep, vector  # noqa: F401
from terrainframe.plans.registry import ORACLES, QUERIES

FLAGSHIP = "watershed_summary"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
