"""Deterministic views of the driver's tables in this library's schemas.

Each view is one list of expressions that Spark and other SQL engines read alike, so a query and its SQL counterpart start
from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrainframe.operators.stencil import Grid
from terrainframe.tables import table

WIDTH = 120
STATES = "CASE c_nationkey % 6 WHEN 0 THEN 'CO' WHEN 1 THEN 'UT' WHEN 2 THEN 'NM' WHEN 3 THEN 'WY' WHEN 4 THEN 'CO,UT' END"
CELLS = ["CAST(floor(o_orderkey / 120) AS BIGINT) AS row", "CAST(o_orderkey % 120 AS BIGINT) AS col", "o_totalprice AS elev"]
GAPPY = [*CELLS[:2], "CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice END AS elev"]
BASINS = [
    "c_custkey AS basin_id", f"{STATES} AS states", "(c_acctbal + 1000) / 20 AS area_km2",
    "CAST((c_custkey * 37) % 997 AS DOUBLE) AS x0", "CAST((c_custkey * 53) % 991 AS DOUBLE) AS y0",
    "CAST((c_custkey * 37) % 997 AS DOUBLE) + 2 + c_custkey % 9 AS x1", "CAST((c_custkey * 53) % 991 AS DOUBLE) + 2 + c_custkey % 7 AS y1",
    "CASE WHEN c_custkey % 23 <> 0 THEN CAST((c_custkey * 7) % 200 AS DOUBLE) / 10 END AS slope", "CAST((c_custkey * 13) % 101 AS DOUBLE) / 10 AS stream_density", "c_mktsegment AS segment",
]
CATCHMENTS = [
    "p_partkey AS catchment_id", "CAST((p_partkey * 41) % 997 AS DOUBLE) AS x0", "CAST((p_partkey * 29) % 991 AS DOUBLE) AS y0",
    "CAST((p_partkey * 41) % 997 AS DOUBLE) + 1 + p_size AS x1", "CAST((p_partkey * 29) % 991 AS DOUBLE) + 1 + p_size % 17 AS y1",
]
FLOWLINES = [
    "p_partkey AS line_id", "CAST((p_partkey * 31) % 997 AS DOUBLE) AS x0", "CAST((p_partkey * 47) % 991 AS DOUBLE) AS y0",
    "CAST((p_partkey * 31) % 997 AS DOUBLE) + (p_size % 11) - 5 AS x1", "CAST((p_partkey * 47) % 991 AS DOUBLE) + (p_size % 7) - 3 AS y1",
]
SCORES = [
    "l_orderkey AS score_id", "CASE WHEN l_linenumber <> 7 THEN 1 - l_discount - l_tax / 2 END AS iou", "l_quantity AS runtime_s", "l_extendedprice / 50 AS centroid_m",
    "CASE l_returnflag WHEN 'A' THEN 'flat' WHEN 'N' THEN 'moderate' WHEN 'R' THEN 'steep' END AS terrain", "CASE l_linestatus WHEN 'F' THEN 'small' ELSE 'large' END AS size_class", "1 + l_tax - l_discount AS boundary_ratio", "l_partkey AS part_id", "l_linenumber AS line_no",
]
RUNS = ["event_id AS run_id", "event_type AS tool", "user_id AS location", "value AS runtime_s", "value > 20 AS failed", "ts"]


def view(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*columns)


def grid(spark: SparkSession, sf_dir: str, gappy: bool = False) -> Grid:
    """Orders as a raster of 120 columns, elevations from prices; with ``gappy`` every 19th cell has no data."""
    height = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return Grid(view(spark, sf_dir, "orders", GAPPY if gappy else CELLS), 0 if height is None else height // WIDTH + 1, WIDTH)


def sql(name: str, columns: list[str], of: str) -> str:
    """The view as a common table expression."""
    return f"{name} AS (SELECT {', '.join(columns)} FROM {of})"
