"""Score, comparison, quality and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrainframe.functions import geometry as g
from terrainframe.functions import text as tx
from terrainframe.functions.means import exact_mean, exact_mean_sql
from terrainframe.functions.quantiles import with_quantiles
from terrainframe.operators import comparison, scoring, validators
from terrainframe.operators import kernels as k
from terrainframe.plans.registry import query
from terrainframe.plans.vector import BASINS, basins
from terrainframe.sources import bridge
from terrainframe.tables import table

SCORES = bridge.sql("scores", bridge.SCORES, "lineitem")
_T = "CASE terrain WHEN 'flat' THEN 0.95 WHEN 'moderate' THEN 0.92 WHEN 'steep' THEN 0.85 ELSE 0.90 END"
_C = "CASE terrain WHEN 'flat' THEN 200.0 WHEN 'moderate' THEN 500.0 WHEN 'steep' THEN 1000.0 ELSE 500.0 END"
JUDGED = f"j AS (SELECT *, {_T} AS iou_target, {_C} AS centroid_target, coalesce(iou >= {_T}, false) AS iou_pass, coalesce(centroid_m <= {_C}, false) AS centroid_pass FROM scores), judged AS (SELECT *, iou_pass AND centroid_pass AS overall_pass FROM j)"
_RATES = "round(avg(CAST(iou_pass AS INT)) * 100, 6) AS iou_pass_pct, round(avg(CAST(centroid_pass AS INT)) * 100, 6) AS centroid_pass_pct, round(avg(CAST(overall_pass AS INT)) * 100, 6) AS overall_pass_pct"
W = f"WITH {SCORES}, {JUDGED} "
_IOU_MEAN = exact_mean_sql("iou")


def scores(spark, sf_dir):
    return bridge.view(spark, sf_dir, "lineitem", bridge.SCORES)


def rounded(df, digits=6, exact=()):
    """Doubles rounded but for the columns ``exact``, which come of whole numbers and one division, so that they are the same anywhere."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" and c not in exact else F.col(c) for c, kind in df.dtypes])


@query(W + "SELECT score_id, line_no, part_id, iou_target, centroid_target, iou_pass, centroid_pass, overall_pass FROM judged")
def assess_performance(spark, sf_dir):
    return scoring.assess(scores(spark, sf_dir)).select("score_id", "line_no", "part_id", "iou_target", "centroid_target", "iou_pass", "centroid_pass", "overall_pass")


@query(W + f"SELECT count(*) AS n, {_IOU_MEAN} AS iou_mean, round(quantile_cont(iou, 0.5), 6) AS iou_median, round(quantile_cont(iou, 0.9), 6) AS iou_p90, round(quantile_cont(iou, 0.95), 6) AS iou_p95, count(*) FILTER (WHERE iou IS NULL) AS n_invalid, round(100.0 * count(*) FILTER (WHERE iou IS NULL) / count(*), 6) AS invalid_pct, {exact_mean_sql("runtime_s")} AS runtime_mean, round(quantile_cont(runtime_s, 0.5), 6) AS runtime_median, round(quantile_cont(runtime_s, 0.95), 6) AS runtime_p95, {_RATES} FROM judged")
def report_overall(spark, sf_dir):
    return rounded(scoring.overall(scores(spark, sf_dir)), exact=("iou_mean", "runtime_mean"))


@query(W + f"SELECT terrain, count(*) AS n, {_IOU_MEAN} AS iou_mean, round(quantile_cont(iou, 0.5), 6) AS iou_median, {_RATES} FROM judged GROUP BY 1")
def report_by_terrain(spark, sf_dir):
    return rounded(scoring.by(scores(spark, sf_dir), "terrain"), exact=("iou_mean",))


@query(W + f"SELECT size_class, count(*) AS n, {_IOU_MEAN} AS iou_mean, round(quantile_cont(iou, 0.5), 6) AS iou_median, {_RATES} FROM judged GROUP BY 1")
def report_by_size(spark, sf_dir):
    return rounded(scoring.by(scores(spark, sf_dir), "size_class"), exact=("iou_mean",))


@query(W + "SELECT round(avg(CAST(runtime_s <= 30 AS INT)) * 100, 6) AS runtime_met_pct, round(avg(CAST(iou >= 0.95 AS INT)) * 100, 6) AS iou_met_pct FROM judged")
def report_targets(spark, sf_dir):
    return rounded(scoring.targets(scores(spark, sf_dir)))


@query(W + "SELECT count(*) FILTER (WHERE iou < 0.9) AS n_low_iou, count(*) FILTER (WHERE runtime_s > 45) AS n_slow, count(*) FILTER (WHERE iou IS NULL) AS n_invalid FROM judged")
def report_outliers(spark, sf_dir):
    return scoring.outliers(scores(spark, sf_dir), 0.9, 45.0)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, count(l_partkey) AS n_scores, round(coalesce(sum(1 - l_discount), 0.0), 6) AS total FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def score_join(spark, sf_dir):
    """Samples with their truth by id, whose types differ between the two sides."""
    samples = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    truth = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.count("*").alias("n"), F.sum(1 - F.col("l_discount")).alias("t"))
    return samples.join(truth, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_scores"), F.round(F.coalesce("t", F.lit(0.0)), 6).alias("total"))


@query("SELECT o_orderkey AS id, 'missing_truth' AS error_type FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def score_missing_truth(spark, sf_dir):
    truth = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(truth, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("id"), F.lit("missing_truth").alias("error_type"))


PAIRS = "tq AS (SELECT p_partkey AS id, p_size <> 13 AS valid, CAST(p_size AS DOUBLE) / 10 AS truth_area, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice / 400 END AS sample_area FROM part), q AS (SELECT *, CASE WHEN sample_area > 0 THEN truth_area / sample_area END AS ratio FROM tq)"


@query(f"WITH {PAIRS} SELECT id, concat_ws(',', CASE WHEN NOT valid THEN 'invalid_topology' END, CASE WHEN ratio < 0.5 OR ratio > 2.0 THEN 'area_ratio_violation' END, CASE WHEN truth_area < 0.5 THEN 'area_too_small' END) AS issues FROM q")
def truth_quality(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_size <> 13 AS valid", "CAST(p_size AS DOUBLE) / 10 AS truth_area", "CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice / 400 END AS sample_area")
    return scoring.truth_quality(pairs, least=0.5).select("id", F.array_join("issues", ",").alias("issues"))


@query(f"WITH {BASINS} SELECT segment, count(*) AS n, round(min(area_km2), 6) AS low, round(max(area_km2), 6) AS high, {exact_mean_sql("area_km2")} AS mean, round(quantile_cont(area_km2, 0.5), 6) AS median FROM basins GROUP BY 1")
def truth_area_stats(spark, sf_dir):
    given = basins(spark, sf_dir)
    found = given.groupBy("segment").agg(F.count("*").alias("n"), F.min("area_km2").alias("low"), F.max("area_km2").alias("high"), exact_mean("area_km2").alias("mean"))
    found = with_quantiles(found, given, {"area_km2": {"median": 0.5}}, ["segment"])
    return rounded(found, exact=("mean",))


_DEM = bridge.sql("cells", bridge.GAPPY, "orders")


@query(f"WITH {_DEM} SELECT count(*) AS n_cells, count(elev) AS n_valid, min(elev) AS elev_min, max(elev) AS elev_max, {exact_mean_sql("elev", 1000)} AS elev_mean, round(stddev_pop(elev), 4) AS elev_std, round(100.0 * count(elev) / count(*), 4) AS valid_pct FROM cells")
def dem_stats(spark, sf_dir):
    return rounded(validators.dem_stats(bridge.grid(spark, sf_dir, True).cells), 4, ("elev_mean",))


@query(f"WITH {_DEM} SELECT true AS resolution_ok, 100.0 * count(elev) / count(*) >= 50 AS coverage_ok, max(elev) - min(elev) >= 10 AS range_ok, 100.0 * count(elev) / count(*) >= 50 AND max(elev) - min(elev) >= 10 AS admitted FROM cells")
def dem_admission(spark, sf_dir):
    return validators.dem_admission(bridge.grid(spark, sf_dir, True).cells, 10.0)


@query(f"""WITH {_DEM}, s AS (SELECT 100 * avg(CAST(elev IS NULL AS INT)) AS gone, min(elev) AS low, max(elev) AS high, stddev_pop(elev) AS std FROM cells)
    SELECT 'nodata_share' AS rule, CASE WHEN gone > 80 THEN 'error' WHEN gone > 50 THEN 'warning' ELSE 'note' END AS severity, round(gone, 6) AS value FROM s WHERE gone > 20 UNION ALL SELECT 'elevation_low', 'warning', round(low, 6) FROM s WHERE low < -500 UNION ALL SELECT 'elevation_high', 'warning', round(high, 6) FROM s WHERE high > 5000
    UNION ALL SELECT 'elevation_all_high', 'warning', round(low, 6) FROM s WHERE low > 4000 UNION ALL SELECT 'elevation_flat', 'warning', round(std, 6) FROM s WHERE std < 1 UNION ALL SELECT 'elevation_range', 'warning', round(high - low, 6) FROM s WHERE high - low > 6000""")
def dem_quality_report(spark, sf_dir):
    return rounded(validators.dem_quality(bridge.grid(spark, sf_dir, True).cells))


RUNS = "runs AS (SELECT user_id AS place, event_type AS tool, min(value) AS runtime_s, count(*) AS n FROM events GROUP BY 1, 2), boxed AS (SELECT *, n % 5 <> 0 AS success, CASE WHEN n % 5 <> 0 THEN CAST(place % 50 AS DOUBLE) / 10 + n % 3 * 0.1 END AS x0, CASE WHEN n % 5 <> 0 THEN 30 + n % 4 * 0.1 END AS y0 FROM runs), results AS (SELECT *, x0 + 1 AS x1, y0 + 1 AS y1 FROM boxed)"
_PW = "pw AS (SELECT a.place, a.tool AS tool1, b.tool AS tool2, a.tool = b.tool AS same, a.x0 IS NOT NULL AND b.x0 IS NOT NULL AS both_, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS common, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab, (a.y0 + a.y1) / 2 AS lat1, (a.x0 + a.x1) / 2 AS lon1, (b.y0 + b.y1) / 2 AS lat2, (b.x0 + b.x1) / 2 AS lon2 FROM results a JOIN results b USING (place)), pairs AS (SELECT place, tool1, tool2, CASE WHEN same THEN 1.0 WHEN both_ THEN common / (aa + ab - common) ELSE 0.0 END AS iou, CASE WHEN same THEN 0.0 WHEN both_ THEN 2 * 6371.0 * asin(sqrt(least(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2), 1.0))) ELSE 1e308 END AS distance_km, CASE WHEN same THEN 1.0 WHEN both_ THEN aa / ab ELSE 0.0 END AS area_ratio FROM pw)"


def results(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("place"), F.col("event_type").alias("tool")).agg(F.min("value").alias("runtime_s"), F.count("*").alias("n"))
    ok = F.col("n") % 5 != 0
    boxed = runs.select("*", ok.alias("success"), F.when(ok, F.expr("CAST(place % 50 AS DOUBLE) / 10 + n % 3 * 0.1D")).alias("x0"), F.when(ok, F.expr("30 + n % 4 * 0.1D")).alias("y0"))
    return boxed.withColumns({"x1": F.col("x0") + 1, "y1": F.col("y0") + 1})


@query(f"WITH {RUNS}, {_PW} SELECT place, tool1, tool2, round(iou, 6) AS iou, CASE WHEN distance_km < 1e300 THEN round(distance_km, 4) END AS distance_km, round(area_ratio, 6) AS area_ratio FROM pairs")
def pairwise_matrix(spark, sf_dir):
    """An infinite distance is shown as null."""
    found = rounded(comparison.pairwise(results(spark, sf_dir)))
    return found.withColumn("distance_km", F.when(F.col("distance_km") < 1e300, F.round("distance_km", 4)))


@query(f"WITH {RUNS}, {_PW} SELECT place, round(coalesce(avg(iou) FILTER (WHERE tool1 <> tool2), 0.0), 6) AS agreement FROM pairs GROUP BY 1")
def agreement(spark, sf_dir):
    return rounded(comparison.agreement(comparison.pairwise(results(spark, sf_dir))))


@query(f"""WITH {RUNS}, {_PW}, ok AS (SELECT place, tool, runtime_s FROM results WHERE success), f AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY runtime_s, tool) AS r, count(*) OVER (PARTITION BY place) AS n_success FROM ok),
    m AS (SELECT p.place, tool1, round(avg(iou), 9) AS mean FROM pairs p JOIN ok a ON a.place = p.place AND a.tool = tool1 JOIN ok b ON b.place = p.place AND b.tool = tool2 WHERE tool1 <> tool2 GROUP BY 1, 2), a AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY mean DESC, tool1) AS r FROM m)
    SELECT f.place, f.tool AS fastest, a.tool1 AS most_accurate, n_success FROM f LEFT JOIN a ON a.place = f.place AND a.r = 1 WHERE f.r = 1""")
def best_tool(spark, sf_dir):
    found = results(spark, sf_dir)
    return comparison.best_tools(found, comparison.pairwise(found))


@query(f"WITH {RUNS} SELECT tool, count(*) AS runs, round(100.0 * avg(CAST(success AS INT)), 6) AS success_pct, round(avg(runtime_s) FILTER (WHERE success), 6) AS mean_runtime_s FROM results GROUP BY 1")
def tool_aggregate(spark, sf_dir):
    return rounded(comparison.by_tool(results(spark, sf_dir)))


@query("SELECT event_id, round(CASE WHEN value > 60 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - value / 50)) END, 9) AS efficiency FROM events")
def efficiency_score(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(comparison.efficiency(F.col("value"), F.lit(50.0), F.col("value") > 60), 9).alias("efficiency"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 40 THEN 'timeout' WHEN user_id % 7 = 0 THEN 'partial' ELSE 'success' END AS status FROM events")
def status_derivation(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", comparison.status(F.col("event_type") == "error", F.col("value") > 40, F.col("user_id") % 7 != 0).alias("status"))


@query(f"WITH {BASINS}, s AS (SELECT basin_id, (x1 - x0) * (y1 - y0) AS a, 2 * (x1 - x0) + 2 * (y1 - y0) AS p FROM basins) SELECT basin_id, round(a * 111.32 * 111.32, 4) AS area_km2, round(p * 111.32, 4) AS perimeter_km, round(p * p / a, 6) AS shape_complexity, round(4 * pi() * a / (p * p), 9) AS compactness FROM s")
def shape_quality(spark, sf_dir):
    c = F.col
    found = basins(spark, sf_dir).select("basin_id", g.measures(g.box_ring(c("x0"), c("y0"), c("x1"), c("y1"))).alias("m"))
    return found.select("basin_id", F.round(c("m.area") * 111.32 * 111.32, 4).alias("area_km2"), F.round(c("m.length") * g.KM_SUMMARY, 4).alias("perimeter_km"), F.round(g.shape_complexity(c("m.area"), c("m.length")), 6).alias("shape_complexity"), F.round(g.compactness(c("m.area"), c("m.length")), 9).alias("compactness"))


@query(f"WITH {SCORES} SELECT 'iou' AS column_name, count(*) FILTER (WHERE iou IS NULL) AS n_null, round(100.0 * count(*) FILTER (WHERE iou IS NULL) / count(*), 6) AS null_pct FROM scores UNION ALL SELECT 'terrain', count(*) FILTER (WHERE terrain IS NULL), round(100.0 * count(*) FILTER (WHERE terrain IS NULL) / count(*), 6) FROM scores")
def schema_nulls(spark, sf_dir):
    return rounded(validators.null_counts(scores(spark, sf_dir), ["iou", "terrain"]))


@query("SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n - 1) AS BIGINT) AS n_duplicate FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def schema_duplicates(spark, sf_dir):
    return validators.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"WITH {SCORES} SELECT 'iou' AS column_name, min(iou) AS low, max(iou) AS high, count(*) FILTER (WHERE iou < 0.9) AS n_below, count(*) FILTER (WHERE iou > 0.99) AS n_above FROM scores UNION ALL SELECT 'runtime_s', min(runtime_s), max(runtime_s), count(*) FILTER (WHERE runtime_s < 2), count(*) FILTER (WHERE runtime_s > 40) FROM scores")
def schema_ranges(spark, sf_dir):
    return validators.ranges(scores(spark, sf_dir), {"iou": (0.9, 0.99), "runtime_s": (2.0, 40.0)})


@query("SELECT o_orderpriority AS found, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def unexpected_values(spark, sf_dir):
    return validators.unexpected(table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("""WITH m AS (SELECT event_type AS metric, avg(value) FILTER (WHERE event_id % 2 = 0) AS was, avg(value) FILTER (WHERE event_id % 2 = 1) AS is_ FROM events GROUP BY 1), c AS (SELECT metric, (is_ - was) / was AS change FROM m WHERE was <> 0)
    SELECT metric, round(change, 6) AS change, CASE WHEN change > 0 THEN 'up' WHEN change < 0 THEN 'down' ELSE 'same' END AS direction, abs(change) > 0.02 AS regressed FROM c""")
def regression_check(spark, sf_dir):
    half = lambda r: table(spark, sf_dir, "events").where(F.col("event_id") % 2 == r).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return rounded(validators.regressions(half(0), half(1), 0.02))


_TOPO = "greatest(1.0 - (CASE WHEN p_size % 6 <> 0 THEN 0.0 ELSE 0.5 END + CASE WHEN p_size % 4 <> 0 THEN 0.0 ELSE 0.3 END + least(p_size % 5 * 0.1, 0.3) + least(p_size % 7 * 0.05, 0.2) + least(p_size % 3 * 0.05, 0.3)), 0.0)"


def _topology(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").withColumn("score", scoring.topology_score(s % 6 != 0, s % 4 != 0, s % 5, s % 7, s % 3))


@query(f"SELECT p_partkey AS id, round({_TOPO}, 6) AS score FROM part")
def topology_score(spark, sf_dir):
    return _topology(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.round("score", 6).alias("score"))


@query(W + "SELECT score_id, line_no, part_id, CASE WHEN iou >= 0.95 THEN 'Excellent' WHEN iou >= 0.9 THEN 'Good' WHEN iou >= 0.8 THEN 'Fair' WHEN iou >= 0.7 THEN 'Poor' ELSE 'Unacceptable' END AS grade FROM scores")
def accuracy_grade(spark, sf_dir):
    return scores(spark, sf_dir).select("score_id", "line_no", "part_id", scoring.accuracy_grade(F.col("iou")).alias("grade"))


@query(f"WITH q AS (SELECT p_partkey AS id, p_retailprice < 920 AS perf, round({_TOPO}, 6) > 0.8 AS topo, CASE WHEN p_size % 9 <> 0 THEN p_size % 2 = 0 END AS acc FROM part) SELECT id, CASE WHEN NOT topo THEN 'Poor' WHEN acc IS NULL THEN CASE WHEN perf THEN 'Good' ELSE 'Fair' END WHEN perf AND acc THEN 'Excellent' WHEN perf OR acc THEN 'Good' ELSE 'Fair' END AS quality FROM q")
def overall_quality(spark, sf_dir):
    accuracy = F.when(F.col("p_size") % 9 != 0, F.col("p_size") % 2 == 0)
    return _topology(spark, sf_dir).select(F.col("p_partkey").alias("id"), scoring.overall_quality(F.col("p_retailprice") < 920, F.round("score", 6), accuracy).alias("quality"))


def _rings(spark, sf_dir):
    """Closed rings of part keys' arithmetic; every third is a bow-tie, some are degenerate."""
    c = F.col
    x, y, s = (c("p_partkey") * 31 % 500).cast("double"), (c("p_partkey") * 17 % 400).cast("double"), 1.0 + c("p_size") % 9
    at = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    zero = F.lit(0.0)
    square = F.array(at(zero, zero), at(s, zero), at(s, s), at(zero, s), at(zero, zero))
    tie = F.array(at(zero, zero), at(s, s), at(s, zero), at(zero, s), at(zero, zero))
    flat = F.array(at(zero, zero), at(s, zero), at(zero, zero))
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), F.when(c("p_partkey") % 3 == 1, tie).when(c("p_partkey") % 11 == 0, flat).otherwise(square).alias("ring"))


@query("SELECT p_partkey AS id, CAST(CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END AS BIGINT) AS n FROM part")
def self_intersections(spark, sf_dir):
    return _rings(spark, sf_dir).select("id", k.self_intersections(F.col("ring")).alias("n"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 1 THEN 'self_intersection' WHEN p_partkey % 11 = 0 THEN 'too_few_points' ELSE 'valid' END AS issue, CASE WHEN p_partkey % 3 = 1 THEN 'buffer_fix' WHEN p_partkey % 11 = 0 THEN 'remove' ELSE 'none' END AS strategy FROM part")
def geometry_diagnosis(spark, sf_dir):
    return _rings(spark, sf_dir).select("id", k.diagnose(F.col("ring")).alias("d")).select("id", "d.issue", "d.strategy")


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), '\\b[0-9]+ *of *[0-9]+\\b', '', 'g')) AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


_SEC = "CAST(floor(o_totalprice / 10) AS BIGINT)"


@query(f"SELECT o_orderkey, CASE WHEN {_SEC} >= 3600 THEN ({_SEC} // 3600) || 'h ' || ({_SEC} % 3600 // 60) || 'm ' || ({_SEC} % 60) || 's' WHEN {_SEC} >= 60 THEN ({_SEC} // 60) || 'm ' || ({_SEC} % 60) || 's' ELSE {_SEC} || 's' END AS duration FROM orders")
def format_duration(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.format_duration(F.col("o_totalprice") / 10).alias("duration"))


_SIZES = [(1, "B"), (2, "KB"), (3, "MB"), (4, "GB")]
_V = "CAST(o_custkey AS DOUBLE) * o_orderkey * o_orderkey"


@query(f"SELECT o_orderkey, CASE {' '.join(f'WHEN {_V} < {1024.0**p!r} THEN printf(\'%.1f {u}\', {_V} / {1024.0 ** (p - 1)!r})' for p, u in _SIZES)} ELSE printf('%.1f TB', {_V} / {1024.0**4!r}) END AS size FROM orders")
def format_file_size(spark, sf_dir):
    value = F.col("o_custkey").cast("double") * F.col("o_orderkey") * F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.format_size(value).alias("size"))
