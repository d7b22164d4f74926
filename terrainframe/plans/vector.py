"""Basin, catchment and geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrainframe.functions import classify, crs
from terrainframe.functions import geometry as g
from terrainframe.functions.means import exact_mean, exact_mean_sql
from terrainframe.operators import joins, outlines, overlay, sampling, sweep
from terrainframe.operators.stencil import gradient_slope
from terrainframe.plans.raster import _all, _DOWN, _EDGE, _GX, _GY, _POURS, _SHED, watershed_boundary, watershed_cells
from terrainframe.plans.registry import query
from terrainframe.sources import bridge

BASINS = bridge.sql("basins", bridge.BASINS, "customer")
POINTS = "points AS (SELECT basin_id AS point_id, (x0 + x1) / 2 AS px, (y0 + y1) / 2 AS py FROM basins)"
LINES = bridge.sql("flowlines", bridge.FLOWLINES, "part")
CATCHMENTS = bridge.sql("catchments", bridge.CATCHMENTS, "part")
W = f"WITH {BASINS} "
RADIUS, SNAP, ORIGIN, STEP = 6.0, 4.0, (-105.0, 40.0), 0.01
ZONES = ["c_custkey AS zone_id", "CAST((c_custkey * 11) % 100 AS DOUBLE) AS x0", "CAST(c_custkey % 90 AS DOUBLE) AS y0", "CAST((c_custkey * 11) % 100 + 3 + c_custkey % 15 AS DOUBLE) AS x1", "CAST(c_custkey % 90 + 2 + c_custkey % 11 AS DOUBLE) AS y1"]

POUR_COLUMNS = ["s_suppkey AS point_id", "CAST((s_suppkey * 13) % 118 AS DOUBLE) + 0.3 AS px", "CAST((s_suppkey * 29) % 97 AS DOUBLE) + 0.7 AS py"]
POUR_POINTS = bridge.sql("pp", POUR_COLUMNS, "supplier")


def basins(spark, sf_dir):
    return bridge.view(spark, sf_dir, "customer", bridge.BASINS)


def points(spark, sf_dir):
    return basins(spark, sf_dir).select(F.col("basin_id").alias("point_id"), ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py"))


@query(W + "SELECT basin_id, states FROM basins WHERE states IN ('CO', 'UT', 'NM', 'WY')")
def filter_states_exact(spark, sf_dir):
    return basins(spark, sf_dir).where(F.col("states").isin("CO", "UT", "NM", "WY")).select("basin_id", "states")


@query(W + "SELECT basin_id, states FROM basins WHERE coalesce(regexp_matches(states, 'CO|WY'), false)")
def filter_states_regex(spark, sf_dir):
    return basins(spark, sf_dir).where(F.coalesce(F.col("states").rlike("CO|WY"), F.lit(False))).select("basin_id", "states")


@query(W + "SELECT basin_id, round(area_km2, 6) AS area_km2 FROM basins WHERE area_km2 BETWEEN 5 AND 500")
def filter_area(spark, sf_dir):
    return basins(spark, sf_dir).where(F.col("area_km2").between(5, 500)).select("basin_id", F.round("area_km2", 6).alias("area_km2"))


@query(W + "SELECT basin_id FROM basins WHERE x0 >= 100 AND y0 >= 50 AND x1 <= 800 AND y1 <= 700")
def filter_bounds(spark, sf_dir):
    return basins(spark, sf_dir).where("x0 >= 100 AND y0 >= 50 AND x1 <= 800 AND y1 <= 700").select("basin_id")


@query(W + "SELECT min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) FILTER (WHERE x0 < 0 OR x1 > 990) AS n_outside FROM basins")
def coordinate_ranges(spark, sf_dir):
    return basins(spark, sf_dir).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count_if((F.col("x0") < 0) | (F.col("x1") > 990)).alias("n_outside"))


@query(W + "SELECT basin_id, CASE WHEN area_km2 >= 0 AND area_km2 <= 20 THEN 'small' WHEN area_km2 > 20 AND area_km2 <= 100 THEN 'medium' WHEN area_km2 > 100 AND area_km2 <= 500 THEN 'large' END AS size_class FROM basins")
def size_class_closed(spark, sf_dir):
    return basins(spark, sf_dir).select("basin_id", classify.size_class_closed(F.col("area_km2")).alias("size_class"))


@query(W + "SELECT basin_id, CASE WHEN area_km2 < 20 THEN 'small' WHEN area_km2 < 100 THEN 'medium' WHEN area_km2 IS NOT NULL THEN 'large' END AS size_class FROM basins")
def size_class_halfopen(spark, sf_dir):
    return basins(spark, sf_dir).select("basin_id", classify.size_class_halfopen(F.col("area_km2")).alias("size_class"))


@query(W + "SELECT basin_id, CASE WHEN slope >= 0 AND slope <= 5 THEN 'flat' WHEN slope > 5 AND slope <= 15 THEN 'moderate' WHEN slope > 15 THEN 'steep' END AS terrain_class FROM basins")
def terrain_class_fixed(spark, sf_dir):
    return basins(spark, sf_dir).select("basin_id", classify.terrain_class(F.col("slope")).alias("terrain_class"))


@query(W + ", q AS (SELECT quantile_cont(slope, 0.33) AS a, quantile_cont(slope, 0.67) AS b FROM basins) SELECT basin_id, CASE WHEN slope <= a THEN 'low' WHEN slope <= b THEN 'medium' WHEN slope IS NOT NULL THEN 'high' END AS tertile FROM basins CROSS JOIN q")
def tertile_class(spark, sf_dir):
    return classify.tertiles(basins(spark, sf_dir), "slope", "tertile").select("basin_id", "tertile")


_QCUT = "q AS (SELECT quantile_cont(stream_density, [0.0, 1.0/3, 2.0/3, 1.0]) AS c FROM basins), cls AS (SELECT basin_id, CAST(CASE WHEN len(list_distinct(c)) < 4 THEN 1 WHEN stream_density <= c[2] THEN 1 WHEN stream_density <= c[3] THEN 2 WHEN stream_density IS NOT NULL THEN 3 END AS INTEGER) AS complexity FROM basins CROSS JOIN q)"


@query(W + f", {_QCUT} SELECT basin_id, complexity FROM cls")
def qcut_complexity(spark, sf_dir):
    return classify.qcut3(basins(spark, sf_dir), "stream_density", "complexity").select("basin_id", "complexity")


_STRATA = f"""{_QCUT}, st AS (SELECT basin_id, coalesce(CASE WHEN area_km2 >= 0 AND area_km2 <= 20 THEN 'small' WHEN area_km2 > 20 AND area_km2 <= 100 THEN 'medium' WHEN area_km2 > 100 AND area_km2 <= 500 THEN 'large' END, 'nan')
    || '_' || coalesce(CASE WHEN slope >= 0 AND slope <= 5 THEN 'flat' WHEN slope > 5 AND slope <= 15 THEN 'moderate' WHEN slope > 15 THEN 'steep' END, 'nan') || '_' || coalesce(CAST(complexity AS VARCHAR), 'nan') AS stratum FROM basins JOIN cls USING (basin_id))"""


def _classified(spark, sf_dir):
    found = classify.qcut3(basins(spark, sf_dir), "stream_density", "complexity")
    return found.withColumns({"size": classify.size_class_closed(F.col("area_km2")), "terrain": classify.terrain_class(F.col("slope"))})


@query(W + f", {_STRATA} SELECT basin_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42-' || CAST(basin_id AS VARCHAR)), basin_id) AS r FROM st) WHERE r <= 3")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(_classified(spark, sf_dir), "basin_id", ["size", "terrain", "complexity"], 3).select("basin_id", "stratum")


@query(W + f", {_STRATA} SELECT stratum, count(*) AS n FROM st GROUP BY 1")
def stratum_counts(spark, sf_dir):
    stratum = F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in ("size", "terrain", "complexity")])
    return _classified(spark, sf_dir).groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n"))


@query(W + "SELECT basin_id, (x1 - x0) * (y1 - y0) AS area, 2 * (x1 - x0) + 2 * (y1 - y0) AS perimeter, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, round(4 * pi() * (x1 - x0) * (y1 - y0) / pow(2 * (x1 - x0) + 2 * (y1 - y0), 2), 9) AS compactness, round(pow(2 * (x1 - x0) + 2 * (y1 - y0), 2) / ((x1 - x0) * (y1 - y0)), 6) AS complexity FROM basins")
def ring_measures(spark, sf_dir):
    c = F.col
    rings = basins(spark, sf_dir).select("basin_id", g.measures(g.box_ring(c("x0"), c("y0"), c("x1"), c("y1"))).alias("m"))
    return rings.select("basin_id", "m.area", c("m.length").alias("perimeter"), F.round("m.x", 6).alias("cx"), F.round("m.y", 6).alias("cy"), F.round(g.compactness(c("m.area"), c("m.length")), 9).alias("compactness"), F.round(g.shape_complexity(c("m.area"), c("m.length")), 6).alias("complexity"))


@query(_all(_DOWN, _POURS, _SHED) + f" SELECT pour_id, round({ORIGIN[0]} + min(col) * {STEP}, 9) AS x0, round({ORIGIN[1]} - (max(row) + 1) * {STEP}, 9) AS y0, round({ORIGIN[0]} + (max(col) + 1) * {STEP}, 9) AS x1, round({ORIGIN[1]} - min(row) * {STEP}, 9) AS y1 FROM shed GROUP BY 1")
def bbox_polygon(spark, sf_dir):
    box = watershed_cells(spark, sf_dir).groupBy("pour_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    low, high = crs.place_of(F.col("r1") + 1, F.col("c0"), *ORIGIN, STEP, "corner"), crs.place_of(F.col("r0"), F.col("c1") + 1, *ORIGIN, STEP, "corner")
    return box.select("pour_id", *[F.round(v, 9).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), (*low, *high), strict=True)])


_HAV = "round(2 * 6371.0 * asin(sqrt(least(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2), 1.0))), 6)"


@query(W + f", p AS (SELECT basin_id, x0 / 10 - 150 AS lon1, y0 / 20 AS lat1, x1 / 9 - 140 AS lon2, y1 / 18 AS lat2 FROM basins) SELECT basin_id, {_HAV} AS km FROM p")
def haversine_pairs(spark, sf_dir):
    c = F.col
    return basins(spark, sf_dir).select("basin_id", F.round(g.haversine_km(c("y0") / 20, c("x0") / 10 - 150, c("y1") / 18, c("x1") / 9 - 140), 6).alias("km"))


_SHIFT = "p AS (SELECT *, x0 + basin_id % 4 AS px0, y0 + basin_id % 3 AS py0, x1 + basin_id % 4 AS px1, y1 + basin_id % 3 AS py1 FROM basins), i AS (SELECT *, greatest(0, least(x1, px1) - greatest(x0, px0)) * greatest(0, least(y1, py1) - greatest(y0, py0)) AS common FROM p)"


def _shifted(spark, sf_dir):
    c = F.col
    return basins(spark, sf_dir).withColumns({k: c(k[1:]) + c("basin_id") % m for k, m in (("px0", 4), ("py0", 3), ("px1", 4), ("py1", 3))})


@query(W + f", {_SHIFT} SELECT basin_id, round(common / (2 * (x1 - x0) * (y1 - y0) - common), 9) AS iou FROM i")
def bbox_iou(spark, sf_dir):
    c = F.col
    found = _shifted(spark, sf_dir).withColumn("common", g.overlap_area([c(k) for k in ("x0", "y0", "x1", "y1")], [c(k) for k in ("px0", "py0", "px1", "py1")]))
    return found.select("basin_id", F.round(c("common") / (2 * (c("x1") - c("x0")) * (c("y1") - c("y0")) - c("common")), 9).alias("iou"))


@query(W + f", {_SHIFT} SELECT basin_id, round((2 * (px1 - px0) + 2 * (py1 - py0)) / (2 * (x1 - x0) + 2 * (y1 - y0)), 9) AS boundary_ratio, round(sqrt(pow((px0 + px1 - x0 - x1) / 2, 2) + pow((py0 + py1 - y0 - y1) / 2, 2)), 9) AS centroid_offset FROM i")
def boundary_ratio_offset(spark, sf_dir):
    c = F.col
    both = _shifted(spark, sf_dir).select("basin_id", g.measures(g.box_ring(c("x0"), c("y0"), c("x1"), c("y1"))).alias("t"), g.measures(g.box_ring(c("px0"), c("py0"), c("px1"), c("py1"))).alias("p"))
    dx, dy = c("p.x") - c("t.x"), c("p.y") - c("t.y")
    return both.select("basin_id", F.round(F.coalesce(F.try_divide(c("p.length"), c("t.length")), F.lit(0.0)), 9).alias("boundary_ratio"), F.round(F.sqrt(dx * dx + dy * dy), 9).alias("centroid_offset"))


@query(_all(_DOWN, _POURS, _SHED) + """, o AS (SELECT pour_id, row, col + pour_id % 3 AS col FROM shed) SELECT pour_id, round(count(CASE WHEN s.row IS NOT NULL AND o.row IS NOT NULL THEN 1 END) / count(*), 9) AS iou
    FROM shed s FULL OUTER JOIN o USING (pour_id, row, col) GROUP BY 1""")
def cellset_iou(spark, sf_dir):
    """IoU of watersheds and themselves moved by some columns, over cells: no geometry needed."""
    shed = watershed_cells(spark, sf_dir)
    marked = shed.withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(shed.select("pour_id", "row", (F.col("col") + F.col("pour_id") % 3).alias("col"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    cells = marked.groupBy("pour_id", "row", "col").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return cells.groupBy("pour_id").agg(F.round(F.sum(F.col("a") * F.col("b")) / F.count("*"), 9).alias("iou"))


_S = "sin(radians(lat))"
_Q = f"(({_S} / (1 - {crs.E2!r} * {_S} * {_S}) - ln((1 - {crs.E1!r} * {_S}) / (1 + {crs.E1!r} * {_S})) / {2 * crs.E1!r}) * {1 - crs.E2!r})"
_LL = "ll AS (SELECT basin_id, x0 / 20 - 120 AS lon, 25 + y0 / 50 AS lat FROM basins)"


@query(W + f", {_LL}, r AS (SELECT basin_id, sqrt({crs.C!r} - {_Q} * {crs.N!r}) * {crs.A / crs.N!r} AS rho, (radians(lon) - {crs.LON0!r}) * {crs.N!r} AS theta FROM ll) SELECT basin_id, round(rho * sin(theta), 3) AS x, round({crs.RHO0!r} - rho * cos(theta), 3) AS y FROM r")
def crs_albers_forward(spark, sf_dir):
    x, y = crs.albers(F.col("x0") / 20 - 120, 25 + F.col("y0") / 50)
    return basins(spark, sf_dir).select("basin_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(W + f", {_LL} SELECT basin_id, round(radians(lon) * {crs.A!r}, 3) AS x, round(ln(tan(radians(lat) / 2 + pi() / 4)) * {crs.A!r}, 3) AS y FROM ll")
def crs_mercator_forward(spark, sf_dir):
    x, y = crs.mercator(F.col("x0") / 20 - 120, 25 + F.col("y0") / 50)
    return basins(spark, sf_dir).select("basin_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(W + f", {_LL} SELECT basin_id, round(lon, 9) AS lon, round(lat, 9) AS lat FROM ll")
def crs_albers_roundtrip(spark, sf_dir):
    x, y = crs.albers(F.col("x0") / 20 - 120, 25 + F.col("y0") / 50)
    there = basins(spark, sf_dir).select("basin_id", x.alias("x"), y.alias("y"))
    lon, lat = crs.albers_inverse(F.col("x"), F.col("y"))
    return there.select("basin_id", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query(W + f", {_LL} SELECT basin_id, round(lon, 9) AS lon, round(lat, 9) AS lat, CAST(32600 + floor((lon + 180) / 6) + 1 AS INTEGER) AS epsg FROM ll")
def crs_utm_roundtrip(spark, sf_dir):
    """To the zone of the place and back; tests hold control points and the meridian's arc."""
    x, y, code = crs.utm(F.col("x0") / 20 - 120, 25 + F.col("y0") / 50)
    there = basins(spark, sf_dir).select("basin_id", x.alias("x"), y.alias("y"), code.alias("epsg"))
    lon, lat = crs.utm_inverse(F.col("x"), F.col("y"), F.col("epsg"))
    return there.select("basin_id", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"), "epsg")


@query(W + ", ll AS (SELECT basin_id, x0 / 3 - 170 AS lon, y0 / 40 + 60 AS lat FROM basins) SELECT basin_id, round(lon, 8) AS lon, round(lat, 8) AS lat FROM ll")
def crs_polar_roundtrip(spark, sf_dir):
    """To the polar stereographic system of the north and back."""
    x, y = crs.polar(F.col("x0") / 3 - 170, F.col("y0") / 40 + 60, 3413)
    there = basins(spark, sf_dir).select("basin_id", x.alias("x"), y.alias("y"))
    lon, lat = crs.polar_inverse(F.col("x"), F.col("y"), 3413)
    return there.select("basin_id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query(f"WITH {bridge.sql('cells', bridge.CELLS, 'orders')} SELECT row, col FROM cells")
def affine_roundtrip(spark, sf_dir):
    x, y = crs.place_of(F.col("row"), F.col("col"), *ORIGIN, STEP)
    there = bridge.view(spark, sf_dir, "orders", bridge.CELLS).select(x.alias("x"), y.alias("y"))
    row, col = crs.pixel_of(F.col("x"), F.col("y"), *ORIGIN, STEP)
    return there.select(row.alias("row"), col.alias("col"))


_SEG = "greatest(0.0, least(1.0, coalesce(((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / nullif((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0), 0), 0.0)))"


@query(W + f", {POINTS}, {LINES}, n AS (SELECT *, x0 + t * (x1 - x0) AS x, y0 + t * (y1 - y0) AS y FROM (SELECT *, {_SEG} AS t FROM points CROSS JOIN flowlines)), d AS (SELECT *, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS d FROM n), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, line_id) AS r FROM d WHERE d <= {SNAP}) WHERE r = 1) SELECT p.point_id, round(coalesce(b.x, p.px), 6) AS x, round(coalesce(b.y, p.py), 6) AS y, coalesce(b.line_id, -1) AS line_id, b.line_id IS NOT NULL AS snapped FROM points p LEFT JOIN b USING (point_id)")
def snap_pour_points(spark, sf_dir):
    found = joins.snap(points(spark, sf_dir), bridge.view(spark, sf_dir, "part", bridge.FLOWLINES), SNAP)
    return found.select("point_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.coalesce("line_id", F.lit(-1)).alias("line_id"), "snapped")


@query(W + f""", {LINES}, m AS (SELECT b.basin_id, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1, f.x0, f.y0, f.x1 - f.x0 AS dx, f.y1 - f.y0 AS dy FROM basins b JOIN flowlines f ON least(f.x0, f.x1) <= b.x1 AND greatest(f.x0, f.x1) >= b.x0 AND least(f.y0, f.y1) <= b.y1 AND greatest(f.y0, f.y1) >= b.y0),
    t AS (SELECT basin_id, sqrt(dx * dx + dy * dy) AS len, CASE WHEN dx = 0 THEN 0 ELSE least((bx0 - x0) / dx, (bx1 - x0) / dx) END AS ax, CASE WHEN dx = 0 THEN 1 ELSE greatest((bx0 - x0) / dx, (bx1 - x0) / dx) END AS zx, CASE WHEN dy = 0 THEN 0 ELSE least((by0 - y0) / dy, (by1 - y0) / dy) END AS ay, CASE WHEN dy = 0 THEN 1 ELSE greatest((by0 - y0) / dy, (by1 - y0) / dy) END AS zy FROM m),
    s AS (SELECT basin_id, sum(greatest(0.0, least(1.0, zx, zy) - greatest(0.0, ax, ay)) * len) AS km FROM t GROUP BY 1)
    SELECT b.basin_id, round(coalesce(km, 0.0), 6) AS stream_km, round(coalesce(km, 0.0) / ((x1 - x0) * (y1 - y0)), 6) AS density FROM basins b LEFT JOIN s USING (basin_id)""")
def stream_density(spark, sf_dir):
    found = joins.stream_density(basins(spark, sf_dir), bridge.view(spark, sf_dir, "part", bridge.FLOWLINES))
    return found.select("basin_id", F.round("stream_km", 6).alias("stream_km"), F.round("density", 6).alias("density"))


_CAND = f"""cand AS (SELECT point_id, catchment_id, px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 AS holds, (x1 - x0) * (y1 - y0) AS area, sqrt(pow((x0 + x1) / 2 - px, 2) + pow((y0 + y1) / 2 - py, 2)) AS centre_distance
    FROM points JOIN catchments ON pow(greatest(0, x0 - px, px - x1), 2) + pow(greatest(0, y0 - py, py - y1), 2) <= {RADIUS * RADIUS})"""


@query(W + f", {POINTS}, {CATCHMENTS}, {_CAND} SELECT point_id, catchment_id, holds, area, round(centre_distance, 6) AS centre_distance FROM cand")
def truth_candidates(spark, sf_dir):
    found = joins.truth_candidates(points(spark, sf_dir), bridge.view(spark, sf_dir, "part", bridge.CATCHMENTS), RADIUS)
    return found.withColumn("centre_distance", F.round("centre_distance", 6))


@query(W + f""", {POINTS}, {CATCHMENTS}, {_CAND}, k AS (SELECT *, count(*) OVER (PARTITION BY point_id) AS n, count(*) FILTER (WHERE holds) OVER (PARTITION BY point_id) AS nh, row_number() OVER (PARTITION BY point_id ORDER BY holds DESC, CASE WHEN holds THEN -area ELSE round(centre_distance, 9) END, catchment_id) AS r FROM cand)
    SELECT point_id, catchment_id, area, CASE WHEN n = 1 THEN 'single_catchment' WHEN nh > 1 THEN 'largest_containing' WHEN nh = 1 THEN 'contains_point' ELSE 'nearest_centroid' END AS method FROM k WHERE r = 1""")
def truth_pick_one(spark, sf_dir):
    return sweep.box_pick(points(spark, sf_dir), bridge.view(spark, sf_dir, "part", bridge.CATCHMENTS), RADIUS, 9)


_ZONES = bridge.sql("zones", ZONES, "customer")
_IN = "z AS (SELECT zone_id, row, col, v FROM vals JOIN zones ON col + 0.5 BETWEEN x0 AND x1 AND row + 0.5 BETWEEN y0 AND y1)"


def _zonal(spark, sf_dir, cells):
    return joins.zonal(cells, bridge.view(spark, sf_dir, "customer", ZONES))


@query(_all(_ZONES, "vals AS (SELECT row, col, elev AS v FROM cells)", _IN, gappy=True) + " SELECT zone_id, count(*) AS n_cells, count(v) AS n_valid FROM z GROUP BY 1")
def raster_mask_counts(spark, sf_dir):
    return _zonal(spark, sf_dir, bridge.grid(spark, sf_dir, True).cells).groupBy("zone_id").agg(F.count("*").alias("n_cells"), F.count("elev").alias("n_valid"))


@query(_all(_ZONES, "vals AS (SELECT row, col, elev AS v FROM cells)", _IN, gappy=True) + " SELECT zone_id, round(CASE WHEN count(v) >= 10 THEN stddev_pop(v) END, 4) AS elev_std FROM z GROUP BY 1")
def zonal_roughness(spark, sf_dir):
    found = _zonal(spark, sf_dir, bridge.grid(spark, sf_dir, True).cells).groupBy("zone_id")
    return found.agg(F.round(F.when(F.count("elev") >= 10, F.stddev_pop("elev")), 4).alias("elev_std"))


@query(_all(_ZONES, f"vals AS (SELECT row, col, sqrt(({_GX}) * ({_GX}) + ({_GY}) * ({_GY})) AS v FROM nb CROSS JOIN size)", _IN) + " SELECT zone_id, round(CASE WHEN count(v) > 10 THEN stddev_pop(v) ELSE 0 END, 4) AS slope_std FROM z GROUP BY 1")
def zonal_slope_std(spark, sf_dir):
    found = _zonal(spark, sf_dir, gradient_slope(bridge.grid(spark, sf_dir))).groupBy("zone_id")
    return found.agg(F.round(F.when(F.count("slope") > 10, F.stddev_pop("slope")).otherwise(0.0), 4).alias("slope_std"))


_QUADS = """q AS (SELECT pour_id, row + dr AS row, col + dc AS col, sum(bit) AS m FROM shed CROSS JOIN (VALUES (0, 0, 8), (0, 1, 4), (1, 0, 2), (1, 1, 1)) o(dr, dc, bit) GROUP BY 1, 2, 3),
    n AS (SELECT pour_id, count(*) FILTER (WHERE m IN (1, 2, 4, 8)) AS q1, count(*) FILTER (WHERE m IN (7, 11, 13, 14)) AS q3, count(*) FILTER (WHERE m IN (6, 9)) AS qd FROM q GROUP BY 1)"""


@query(_all(_DOWN, _POURS, _SHED, _QUADS) + f" SELECT n.pour_id, q1 + q3 + 2 * qd AS n_corners, (q1 - q3 + 2 * qd) // 4 AS outer_less_holes, round(cells * {STEP * STEP}, 9) AS area FROM n JOIN (SELECT pour_id, count(*) AS cells FROM shed GROUP BY 1) USING (pour_id)")
def watershed_polygons(spark, sf_dir):
    """Outlines of all watersheds; corners and parts less holes follow from the cells around each corner, the area from the cells."""
    found = outlines.outlines(watershed_cells(spark, sf_dir), *ORIGIN, STEP)
    return found.select("pour_id", "n_corners", (F.col("n_outer") - F.col("n_holes")).cast("long").alias("outer_less_holes"), F.round("area", 9).alias("area"))


@query(_all(_DOWN, _POURS, _SHED, _QUADS, """c AS (SELECT pour_id, count(*) AS n FROM shed GROUP BY 1), i AS (SELECT a.pour_id, count(*) AS n FROM shed a JOIN shed b ON b.pour_id = a.pour_id AND abs(a.row - b.row) + abs(a.col - b.col) = 1 AND abs(a.row - b.row) <= 1 GROUP BY 1)""")
       + " SELECT c.pour_id, 4 * c.n - coalesce(i.n, 0) AS n_points, round(c.n - (q1 + 2 * qd - q3) / 8, 6) AS area FROM c JOIN n USING (pour_id) LEFT JOIN i USING (pour_id)")
def watershed_contours(spark, sf_dir):
    """Lines halfway between inside and outside: a point for each side that borders on the outside, and a corner takes or gives an eighth of a cell."""
    found = outlines.contours(watershed_cells(spark, sf_dir))
    return found.select("pour_id", "n_points", F.round("area", 6).alias("area"))


@query(_all(_DOWN, _POURS, _SHED, _EDGE, """m AS (SELECT pour_id, avg(col) AS cx, avg(row) AS cy FROM edge GROUP BY 1), o AS (SELECT e.pour_id, CAST(col AS DOUBLE) AS x, CAST(row AS DOUBLE) AS y, row_number() OVER (PARTITION BY e.pour_id ORDER BY round(atan2(row - cy, col - cx), 9), col, row) AS place FROM edge e JOIN m USING (pour_id)),
    s AS (SELECT pour_id, x * coalesce(lead(y) OVER w, first_value(y) OVER w) - coalesce(lead(x) OVER w, first_value(x) OVER w) * y AS cross_ FROM o WINDOW w AS (PARTITION BY pour_id ORDER BY place))""") + " SELECT pour_id, count(*) AS n_points, round(abs(sum(cross_)) / 2, 6) AS area FROM s GROUP BY 1")
def watershed_ring_by_angle(spark, sf_dir):
    """Boundary cells' centres sorted by angle, and the area of the ring they make."""
    edge = watershed_boundary(spark, sf_dir).select("pour_id", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    return outlines.ordered_areas(outlines.by_angle(edge)).select("pour_id", "n_points", F.round("area", 6).alias("area"))


#: A shape in a box of width w and height h as signed boxes: an L with a hole, and a part of its own. (sign, x0, y0, x1, y1) in parts of w and h.
_SIGNED = [(1, 0, 0, 1, 1), (-1, 0.5, 0.5, 1, 1), (-1, 0.125, 0.125, 0.375, 0.375), (1, 1.25, 0, 1.5, 0.25)]
_BOXES = "VALUES " + ", ".join(f"({s}, {float(a)}, {float(b)}, {float(c)}, {float(d)})" for s, a, b, c, d in _SIGNED)


def _shape(x, y, w, h):
    """The same shape as rings: L, hole and part."""
    ring = lambda *ps: F.array(*[F.struct((x + a * w).alias("x"), (y + b * h).alias("y")) for a, b in (*ps, ps[0])])
    square = lambda a, b, c, d: ring((a, b), (c, b), (c, d), (a, d))
    return F.array(ring((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1)), square(0.125, 0.125, 0.375, 0.375), square(1.25, 0, 1.5, 0.25))


@query(W + f""", b AS (SELECT * FROM ({_BOXES}) t(s, a, b, c, d)), p AS (SELECT basin_id, x0, y0, x1 - x0 AS w, y1 - y0 AS h, (basin_id % 4) / 2 AS dx, (basin_id % 3) / 4 AS dy FROM basins),
    pairs AS (SELECT basin_id, u.s * v.s AS sign, greatest(0, least(u.c * w, dx + v.c * w) - greatest(u.a * w, dx + v.a * w)) * greatest(0, least(u.d * h, dy + v.d * h) - greatest(u.b * h, dy + v.b * h)) AS ov FROM p CROSS JOIN b u CROSS JOIN b v),
    size AS (SELECT basin_id, sum(s * (c - a) * w * (d - b) * h) AS area FROM p CROSS JOIN b GROUP BY 1), common AS (SELECT basin_id, sum(sign * ov) AS common FROM pairs GROUP BY 1)
    SELECT basin_id, round(common, 6) AS common, round(common / (2 * area - common), 6) AS iou, 'valid' AS status FROM size JOIN common USING (basin_id)""")
def polygon_iou(spark, sf_dir):
    """Concave shapes with a hole and two parts against themselves, moved."""
    c = F.col
    w, h = c("x1") - c("x0"), c("y1") - c("y0")
    moved = _shape(c("x0") + (c("basin_id") % 4) / 2, c("y0") + (c("basin_id") % 3) / 4, w, h)
    both = basins(spark, sf_dir).select(c("basin_id").alias("shape_id"), moved.alias("predicted"), _shape(c("x0"), c("y0"), w, h).alias("truth"))
    return overlay.iou(both).select(c("shape_id").alias("basin_id"), F.round("common", 6).alias("common"), F.round("iou", 6).alias("iou"), "status")


def _zone_shapes(spark, sf_dir):
    c = F.col
    return bridge.view(spark, sf_dir, "customer", ZONES).select("zone_id", _shape(c("x0"), c("y0"), c("x1") - c("x0"), c("y1") - c("y0")).alias("rings"))


_INSIDE = f"""bx AS (SELECT * FROM ({_BOXES}) t(s, a, b, c, d)), zs AS (SELECT zone_id, s, x0 + a * (x1 - x0) AS a, y0 + b * (y1 - y0) AS b, x0 + c * (x1 - x0) AS c, y0 + d * (y1 - y0) AS d FROM zones CROSS JOIN bx)"""


@query(_all(_ZONES, _INSIDE, "zz AS (SELECT zone_id, row, col, elev FROM zs JOIN cells ON col + 0.5 >= a AND col + 0.5 < c AND row + 0.5 >= b AND row + 0.5 < d GROUP BY 1, 2, 3, 4 HAVING sum(s) > 0)", gappy=True) + f" SELECT zone_id, count(*) AS n_cells, count(elev) AS n_valid, coalesce({exact_mean_sql('elev', 1000)}, -1.0) AS mean FROM zz GROUP BY 1")
def polygon_mask_counts(spark, sf_dir):
    """Cells whose centres lie in concave zones with holes."""
    met = joins.zonal_shapes(bridge.grid(spark, sf_dir, True).cells, _zone_shapes(spark, sf_dir))
    return met.groupBy("zone_id").agg(F.count("*").alias("n_cells"), F.count("elev").alias("n_valid"), F.coalesce(exact_mean("elev", 1000), F.lit(-1.0)).alias("mean"))


@query(_all(_ZONES, _INSIDE, POUR_POINTS, "hit AS (SELECT point_id, zone_id FROM zs JOIN pp ON px >= a AND px < c AND py >= b AND py < d GROUP BY 1, 2 HAVING sum(s) > 0)") + " SELECT point_id, zone_id FROM hit")
def points_in_polygons(spark, sf_dir):
    at = bridge.view(spark, sf_dir, "supplier", POUR_COLUMNS)
    return joins.points_in_shapes(at, _zone_shapes(spark, sf_dir)).select("point_id", "zone_id")
