"""Queries on the upkeep of layers, distances, rankings, samples and raster windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrainframe.functions import geometry as g
from terrainframe.operators import hydrology, kernels, layers, masks, outlines, overlay, stencil, validators
from terrainframe.plans import delineation
from terrainframe.plans.raster import _ACC, _DOWN, _NET, _POURS, _SHED, RESOLUTION, STREAM, _all_filled, _pours
from terrainframe.plans.registry import query
from terrainframe.plans.reports import RUNS, W, _rings, results, scores
from terrainframe.plans.vector import _QUADS, BASINS, LINES, ORIGIN, POINTS, STEP, basins, points
from terrainframe.sources import bridge

_ISSUE = "CASE WHEN p_partkey % 3 = 1 THEN 'self_intersection' WHEN p_partkey % 11 = 0 THEN 'too_few_points' ELSE 'valid' END"
_STRATEGY = "CASE WHEN p_partkey % 3 = 1 THEN 'buffer_fix' WHEN p_partkey % 11 = 0 THEN 'remove' ELSE 'none' END"
_OUTCOME = "CASE WHEN p_partkey % 3 = 1 THEN 'repaired' WHEN p_partkey % 11 = 0 THEN 'removed' ELSE 'unchanged' END"


@query(f"SELECT issue, strategy, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM part), 6) AS share_pct FROM (SELECT {_ISSUE} AS issue, {_STRATEGY} AS strategy FROM part) GROUP BY 1, 2")
def geometry_issue_stats(spark, sf_dir):
    found = _rings(spark, sf_dir).select(kernels.diagnose(F.col("ring")).alias("d")).select("d.issue", "d.strategy")
    return layers.issue_stats(found).withColumn("share_pct", F.round("share_pct", 6))


@query(f"SELECT p_partkey AS id, {_OUTCOME} AS outcome, CASE {_OUTCOME} WHEN 'removed' THEN 0.0 WHEN 'repaired' THEN (1.0 + p_size % 9) * (1.0 + p_size % 9) / 2 ELSE (1.0 + p_size % 9) * (1.0 + p_size % 9) END AS area FROM part")
def geometry_repair(spark, sf_dir):
    """A bow-tie becomes its two faces, a flat ring goes."""
    shapes = _rings(spark, sf_dir).select(F.col("id").alias("shape_id"), F.array("ring").alias("rings"))
    return overlay.make_valid(shapes).select(F.col("shape_id").alias("id"), "outcome", F.round("area", 6).alias("area"))


@query(f"SELECT outcome, count(*) AS n FROM (SELECT {_OUTCOME} AS outcome FROM part) GROUP BY 1")
def repair_tallies(spark, sf_dir):
    return geometry_repair(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey AS id FROM part WHERE {_ISSUE} = 'valid'")
def drop_invalid(spark, sf_dir):
    return _rings(spark, sf_dir).where(kernels.diagnose(F.col("ring"))["strategy"] == "none").select("id")


_ODD = "o AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN o_custkey * 1.0 WHEN 2 THEN o_custkey * 1e6 ELSE (o_custkey % 360) - 180.0 END AS x, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN o_custkey * 0.5 ELSE (o_custkey % 180) - 90.0 END AS y, o_orderkey % 2 = 0 AS deg FROM orders)"


@query(f"WITH {_ODD} SELECT o_orderkey, coalesce(CASE WHEN x IS NULL OR y IS NULL OR isnan(x) OR isnan(y) THEN 'not_finite' WHEN deg AND abs(x) > 180 THEN 'longitude_range' WHEN deg AND abs(y) > 90 THEN 'latitude_range' WHEN NOT deg AND (abs(x) > 1e8 OR abs(y) > 1e8) THEN 'extreme' END, 'ok') AS error FROM o")
def coordinate_errors(spark, sf_dir):
    """Finite, in the range of degrees or of any projection."""
    k = F.col("o_custkey")
    m, n = F.col("o_orderkey") % 7, F.col("o_orderkey") % 5
    x = F.when(m == 0, float("nan")).when(m == 1, k * 1.0).when(m == 2, k * 1e6).otherwise(k % 360 - 180.0)
    y = F.when(n == 0, F.lit(None)).when(n == 1, k * 0.5).otherwise(k % 180 - 90.0)
    return bridge.table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(layers.coordinate_error(x, y, F.col("o_orderkey") % 2 == 0), F.lit("ok")).alias("error"))


@query(f"WITH {BASINS}, p AS (SELECT basin_id, (CASE WHEN basin_id % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN basin_id % 4 = 0 THEN 1 ELSE 0 END) AS bad FROM basins) SELECT basin_id, CAST(CASE WHEN bad > 1 THEN -1 ELSE 5 - bad END AS INTEGER) AS n_points FROM p")
def coordinate_cleanup(spark, sf_dir):
    """A far point and a missing one go from a box; what keeps three corners is closed again, anything less has no ring."""
    c = F.col
    far, gone = F.when(c("basin_id") % 3 == 0, 5e8).otherwise(c("x1")), F.when(c("basin_id") % 4 == 0, F.lit(None)).otherwise(c("y1"))
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(at(c("x0"), c("y0")), at(far, c("y0")), at(c("x1"), c("y1")), at(c("x0"), gone), at(c("x0"), c("y0")))
    return basins(spark, sf_dir).select("basin_id", layers.cleaned_ring(ring, F.lit(False)).alias("r")).select("basin_id", F.coalesce(F.size("r"), F.lit(-1)).alias("n_points"))


@query(f"WITH {BASINS}, p AS (SELECT basin_id, CASE WHEN basin_id % 5 = 0 THEN 3857 END AS d, x0 * CASE basin_id % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 1000 ELSE 1e6 END AS a, x1 * CASE basin_id % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 1000 ELSE 1e6 END AS b, y0 / 20 AS e, y1 / 20 AS f FROM basins)"
       " SELECT basin_id, CAST(CASE WHEN d IS NOT NULL THEN d WHEN a >= -180 AND b <= 180 AND e >= -90 AND f <= 90 THEN 4326 WHEN abs(a) <= 1e8 AND abs(b) <= 1e8 AND abs(e) <= 1e8 AND abs(f) <= 1e8 THEN 5070 END AS INTEGER) AS epsg, CASE WHEN d IS NOT NULL THEN 'declared' WHEN a >= -180 AND b <= 180 AND e >= -90 AND f <= 90 THEN 'degrees' WHEN abs(a) <= 1e8 AND abs(b) <= 1e8 AND abs(e) <= 1e8 AND abs(f) <= 1e8 THEN 'metres' ELSE 'none' END AS how FROM p")
def crs_fallback(spark, sf_dir):
    c = F.col
    by = F.when(c("basin_id") % 4 == 0, 0.1).when(c("basin_id") % 4 == 1, 1000.0).otherwise(1e6)
    found = layers.assumed_crs(F.when(c("basin_id") % 5 == 0, 3857), c("x0") * by, c("y0") / 20, c("x1") * by, c("y1") / 20)
    return basins(spark, sf_dir).select("basin_id", found.alias("f")).select("basin_id", "f.epsg", "f.how")


def _vincenty(rounds: int) -> str:
    """The same formula in SQL, one table a round."""
    f, b, a = layers.FLATTENING, layers.MINOR, layers.MAJOR
    ang = "c2 * sin(lam) AS pa, c1 * s2 - s1 * c2 * cos(lam) AS pb, s1 * s2 + c1 * c2 * cos(lam) AS cosine"
    out = [f"u AS (SELECT basin_id, atan({1 - f!r} * tan(radians(lat1))) AS u1, atan({1 - f!r} * tan(radians(lat2))) AS u2, radians(lon2 - lon1) AS lon FROM ends)", "v0 AS (SELECT basin_id, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, lon, lon AS lam FROM u)"]
    for k in range(rounds + 1):
        out.append(f"a{k} AS (SELECT *, sqrt(pa * pa + pb * pb) AS sine FROM (SELECT *, {ang} FROM v{k}))")
        out.append(f"b{k} AS (SELECT *, atan2(sine, cosine) AS sigma, CASE WHEN sine = 0 THEN 0 ELSE c1 * c2 * sin(lam) / sine END AS alpha FROM a{k})")
        out.append(f"d{k} AS (SELECT *, CASE WHEN square = 0 THEN 0 ELSE cosine - 2 * s1 * s2 / square END AS middle FROM (SELECT *, 1 - alpha * alpha AS square FROM b{k}))")
        out.append(f"e{k} AS (SELECT *, {f / 16!r} * square * (4 + {f!r} * (4 - 3 * square)) AS c FROM d{k})")
        out.append(f"v{k + 1} AS (SELECT basin_id, s1, c1, s2, c2, lon, lon + (1 - c) * {f!r} * alpha * (sigma + c * sine * (middle + c * cosine * (2 * middle * middle - 1))) AS lam FROM e{k})")
    u = f"square * {(a * a - b * b) / (b * b)!r}"
    out.append(f"w AS (SELECT *, {u} AS u FROM d{rounds})")
    out.append("x AS (SELECT *, 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768)) AS ka, u / 1024 * (256 + u * (u * (74 - 47 * u) - 128)) AS kb FROM w)")
    return ", ".join(out) + f" SELECT basin_id, round({b!r} * ka * (sigma - kb * sine * (middle + kb / 4 * (cosine * (2 * middle * middle - 1) - kb / 6 * middle * (4 * sine * sine - 3) * (4 * middle * middle - 3)))), 3) AS metres FROM x"


@query(f"WITH {BASINS}, ends AS (SELECT basin_id, y0 / 20 AS lat1, x0 / 10 - 150 AS lon1, y1 / 18 AS lat2, x1 / 9 - 140 AS lon2 FROM basins), " + _vincenty(layers.ROUNDS))
def geodesic_pairs(spark, sf_dir):
    c = F.col
    return basins(spark, sf_dir).select("basin_id", F.round(layers.geodesic_m(c("y0") / 20, c("x0") / 10 - 150, c("y1") / 18, c("x1") / 9 - 140), 3).alias("metres"))


@query()
def projected_areas(spark, sf_dir):
    """Boxes in degrees as rings of the equal-area projection; tests hold areas against the closed form."""
    c = F.col
    ring = g.box_ring(c("x0") / 20 - 120, 25 + c("y0") / 50, c("x1") / 20 - 120, 25 + c("y1") / 50)
    return basins(spark, sf_dir).select("basin_id", F.round(g.area(layers.projected_ring(ring)) / 1e6, 6).alias("km2"))


_V = "SELECT p_partkey AS line_id, unnest([{'x': x0, 'y': y0}, {'x': x1, 'y': y1}]) AS p FROM (SELECT line_id AS p_partkey, x0, y0, x1, y1 FROM flowlines)"


@query(f"WITH {BASINS}, {POINTS}, {LINES}, v AS ({_V}), d AS (SELECT point_id, line_id, p.x AS x, p.y AS y, sqrt((px - p.x) * (px - p.x) + (py - p.y) * (py - p.y)) AS d FROM points JOIN v ON abs(px - p.x) <= 4 AND abs(py - p.y) <= 4) SELECT point_id, line_id, round(x, 6) AS x, round(y, 6) AS y, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, line_id, x, y) AS r FROM d WHERE d <= 4) WHERE r = 1")
def nearest_vertex(spark, sf_dir):
    found = layers.nearest_vertex(points(spark, sf_dir), bridge.view(spark, sf_dir, "part", bridge.FLOWLINES), 4.0)
    return found.select("point_id", "line_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("d", 6).alias("d"))


@query(W + "SELECT terrain, score_id, line_no, part_id, iou, rank FROM (SELECT terrain, score_id, line_no, part_id, round(iou, 6) AS iou, CAST(row_number() OVER (PARTITION BY terrain ORDER BY round(iou, 6), score_id, line_no, part_id, round(runtime_s, 6), round(centroid_m, 6)) AS INTEGER) AS rank FROM scores WHERE iou IS NOT NULL) WHERE rank <= 10")
def worst_scores(spark, sf_dir):
    """The ten lowest scores of each terrain."""
    rows = scores(spark, sf_dir).where("iou IS NOT NULL").withColumns({"iou": F.round("iou", 6), "r": F.round("runtime_s", 6), "c": F.round("centroid_m", 6)})
    return layers.worst(rows, ["terrain"], [F.col(k) for k in ("iou", "score_id", "line_no", "part_id", "r", "c")], 10).select("terrain", "score_id", "line_no", "part_id", "iou", "rank")


@query(W + "SELECT score_id, line_no, part_id, round(iou, 6) AS iou, runtime_s FROM scores WHERE iou < 0.86 OR runtime_s > 48 OR iou IS NULL")
def outlier_rows(spark, sf_dir):
    c = F.col
    return scores(spark, sf_dir).where((c("iou") < 0.86) | (c("runtime_s") > 48) | c("iou").isNull()).select("score_id", "line_no", "part_id", F.round("iou", 6).alias("iou"), "runtime_s")


@query(f"WITH {RUNS} SELECT place, tool, CAST(row_number() OVER (PARTITION BY place ORDER BY runtime_s, tool) AS INTEGER) AS rank FROM results WHERE success")
def runtime_ranking(spark, sf_dir):
    return layers.ranked(results(spark, sf_dir).where("success"), ["place"], [F.col("runtime_s"), F.col("tool")]).select("place", "tool", "rank")


@query(f"WITH {RUNS} SELECT tool, count(DISTINCT place) AS places, count(*) FILTER (WHERE success) AS n_success, round(min(runtime_s) FILTER (WHERE success), 6) AS fastest_s, round(max(runtime_s) FILTER (WHERE success), 6) AS slowest_s FROM results GROUP BY 1")
def experiment_summary(spark, sf_dir):
    """All places of an experiment by tool."""
    ok = lambda c: F.when(F.col("success"), F.col(c))
    out = results(spark, sf_dir).groupBy("tool").agg(F.count_distinct("place").alias("places"), F.count_if("success").alias("n_success"), F.min(ok("runtime_s")).alias("a"), F.max(ok("runtime_s")).alias("b"))
    return out.select("tool", "places", "n_success", F.round("a", 6).alias("fastest_s"), F.round("b", 6).alias("slowest_s"))


@query("SELECT id, kind FROM (SELECT o_orderkey AS id, 'kept' AS kind FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT o_orderkey, 'failed' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))")
def sample_split(spark, sf_dir):
    """Samples with a truth, and failed ones for the error table, put together again."""
    samples = bridge.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    kept, failed = layers.split_samples(samples, bridge.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")))
    return kept.withColumn("kind", F.lit("kept")).unionByName(failed.withColumn("kind", F.lit("failed")))


@query("WITH " + bridge.sql("cells", bridge.CELLS, "orders") + " SELECT row - 3 AS row, col - 20 AS col, elev FROM cells WHERE row BETWEEN 3 AND 9 AND col BETWEEN 20 AND 69")
def raster_window(spark, sf_dir):
    return layers.window_of(bridge.view(spark, sf_dir, "orders", bridge.CELLS), 3, 20, 7, 50)


@query("WITH " + bridge.sql("cells", bridge.GAPPY, "orders") + " SELECT 100.0 * count(elev) / count(*) >= 20 AS data_ok, count(elev) > 0 AS stats_ok, stddev_pop(elev) >= 1 AS relief_ok, 100.0 * count(elev) / count(*) >= 20 AND count(elev) > 0 AND stddev_pop(elev) >= 1 AS suitable FROM cells")
def dem_suitability(spark, sf_dir):
    return validators.dem_suitability(bridge.grid(spark, sf_dir, True).cells)


@query(_all_filled(_DOWN, _NET, _ACC, _POURS, _SHED, _QUADS) + f", cnt AS (SELECT pour_id, count(*) AS n_cells, count(CASE WHEN acc >= {STREAM} THEN 1 END) AS n_stream FROM shed JOIN acc USING (row, col) GROUP BY 1) SELECT n.pour_id, n_cells, n_cells * {RESOLUTION * RESOLUTION} / 1e6 AS area_km2, n_stream, q1 + q3 + 2 * qd AS n_corners, n_cells * {RESOLUTION * RESOLUTION} / 1e6 < 0.01 AS too_small FROM n JOIN cnt USING (pour_id)".replace(", cnt AS", " , cnt AS", 1))
def delineate(spark, sf_dir):
    """The whole chain for every pour point: fill, direction, accumulation, trace, outline, size check."""
    grid = bridge.grid(spark, sf_dir)
    found = delineation.delineate(grid, _pours(spark, sf_dir, grid), ORIGIN, STEP, RESOLUTION, threshold=STREAM)
    n_corners = F.aggregate("rings", F.lit(0).cast("long"), lambda t, r: t + F.size(r) - 1)
    return found.select("pour_id", "n_cells", "area_km2", "n_stream", n_corners.alias("n_corners"), F.array_contains("errors", "too_small").alias("too_small"))


_CLASSES = "shed AS (SELECT CAST(floor(elev / 100000) AS BIGINT) AS pour_id, row, col FROM cells WHERE elev IS NOT NULL)"


@query("WITH " + bridge.sql("cells", bridge.GAPPY, "orders") + f", {_CLASSES}, {_QUADS} SELECT n.pour_id AS value, q1 + q3 + 2 * qd AS n_corners, (q1 - q3 + 2 * qd) // 4 AS outer_less_holes, area FROM n JOIN (SELECT pour_id, CAST(count(*) AS DOUBLE) AS area FROM shed GROUP BY 1) USING (pour_id)")
def polygonise_classes(spark, sf_dir):
    """Outlines of elevation classes."""
    cells = bridge.grid(spark, sf_dir, True).cells.where("elev IS NOT NULL").select(F.floor(F.col("elev") / 100000).cast("long").alias("value"), "row", "col")
    found = masks.class_outlines(cells, 0.0, 0.0, 1.0)
    return found.select("value", "n_corners", (F.col("n_outer") - F.col("n_holes")).cast("long").alias("outer_less_holes"), F.round("area", 3).alias("area"))


@query()
def clean_masks(spark, sf_dir):
    """Elevation classes with holes filled, small objects dropped and closed; tests hold it against a flood from outside."""
    cells = bridge.grid(spark, sf_dir, True).cells.where("elev IS NOT NULL").select(F.floor(F.col("elev") / 100000).cast("long").alias("pour_id"), "row", "col")
    return masks.cleaned(cells).groupBy("pour_id").agg(F.count("*").alias("n_cells"))
