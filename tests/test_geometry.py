import math

import numpy as np
from pyspark.sql import functions as F

from terrainframe.functions import classify, crs
from terrainframe.functions import geometry as g
from terrainframe.functions import text as tx
from terrainframe.operators import joins, kernels, outlines, scoring, validators
from terrainframe.plans import delineation, pipeline
from terrainframe.operators.stencil import Grid

SQUARE = np.array([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], float)
TIE = np.array([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], float)


def test_kernels():
    assert kernels.crossings(SQUARE) == 0 and kernels.crossings(TIE) == 1
    assert kernels.issue_of(SQUARE) == ("valid", "none") and kernels.issue_of(TIE) == ("self_intersection", "buffer_fix")
    assert kernels.issue_of(np.zeros((0, 2)))[0] == "empty" and kernels.issue_of(SQUARE[:3])[0] == "too_few_points"
    assert kernels.issue_of(np.vstack((SQUARE, [[np.nan, 0]])))[0] == "invalid_coordinates"
    assert kernels.shoelace(kernels.hull(TIE)) == 4
    assert len(kernels.simplify(np.array([(0, 0), (1, 0.001), (2, 0), (2, 2)]), 0.01)) == 3


def test_polygon_iou(spark):
    move = lambda p, d: [{"x": float(x + d), "y": float(y + d)} for x, y in p]
    rows = [(i, move(SQUARE, 0), move(SQUARE, d)) for i, d in enumerate((0, 1, 2, 5))] + [(9, move(TIE, 0), move(SQUARE, 0)), (10, [], move(SQUARE, 0))]
    ring = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame(rows, f"id long, a {ring}, b {ring}").select("id", kernels.polygon_iou(F.col("a"), F.col("b")).alias("i"))
    got = {r.id: (r.i.iou, r.i.status) for r in df.collect()}
    assert got[0] == (1.0, "valid") and abs(got[1][0] - 1 / 7) < 1e-12 and got[2][0] == 0 and got[3][0] == 0
    assert got[9] == (None, "predicted_self_intersection") and got[10] == (None, "predicted_empty")


U = np.array([(0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3), (0, 0)], float)


def test_concave_shapes_with_holes_and_parts():
    box = lambda a, b, c, d: np.array([(a, b), (c, b), (c, d), (a, d), (a, b)], float)
    assert kernels.common_areas([U], [U]) == (7, 7, 7)
    assert kernels.common_areas([U], [box(0, 0, 3, 3)]) == (7, 9, 7)
    assert kernels.common_areas([U], [box(1, 1, 2, 3)]) == (7, 2, 0)
    ring = [box(0, 0, 4, 4), box(1, 1, 3, 3)]
    assert kernels.common_areas(ring, [box(1, 1, 3, 3)]) == (12, 4, 0) and kernels.common_areas(ring, [box(2, 2, 6, 6)])[2] == 3
    parts = [box(0, 0, 1, 1), box(5, 0, 6, 1)]
    assert kernels.common_areas(parts, [box(0.5, 0, 5.5, 1)]) == (2, 5, 1)
    assert kernels.shape_issue(ring) == "valid" and kernels.shape_issue([box(0, 0, 2, 2), box(1, 1, 3, 3)]) == "rings_cross" and kernels.shape_issue([]) == "empty"


def test_common_areas_against_samples():
    """Random star-shaped rings, some with holes, against points thrown at them."""
    rng = np.random.default_rng(6)

    def star(x, y, r):
        t = np.sort(rng.random(rng.integers(5, 30))) * 2 * np.pi
        rr = r * (0.3 + 0.7 * rng.random(len(t)))
        p = np.column_stack((x + rr * np.cos(t), y + rr * np.sin(t)))
        return np.vstack((p, p[:1]))

    def inside(rings, pts):
        n = np.zeros(len(pts), int)
        for r in rings:
            for (x0, y0), (x1, y1) in zip(r[:-1], r[1:], strict=True):
                if y0 != y1:
                    n += ((y0 > pts[:, 1]) != (y1 > pts[:, 1])) & (pts[:, 0] < x0 + (pts[:, 1] - y0) / (y1 - y0) * (x1 - x0))
        return n % 2 == 1

    pts = rng.random((60_000, 2)) * 8 - 4
    for _ in range(6):
        a, b = [star(0, 0, 3), star(0.1, 0, 0.5)], [star(0.5, -0.5, 3), star(-3, -3, 0.9)]
        want = [64 * x.mean() for x in (inside(a, pts), inside(b, pts), inside(a, pts) & inside(b, pts))]
        assert np.abs(np.array(kernels.common_areas(a, b)) - want).max() < 0.6


def test_many_edges_need_little_memory():
    t = np.linspace(0, 2 * np.pi, 20_001)
    ring = np.column_stack((np.cos(t), np.sin(t)))
    ring[-1] = ring[0]
    assert kernels.crossings(ring) == 0
    zig = np.column_stack((np.arange(2000) % 2, np.arange(2000) * 0.5))
    assert kernels.crossings(np.vstack((zig, [[5.0, 0.25]], zig[:1]))) >= 0


def test_outlines_follow_the_cells(spark):
    """Random masks, all traced at once: signed areas are cell counts, rings are closed, bend at each point and never cross."""
    rng = np.random.default_rng(3)
    masks = [rng.random((8, 9)) < p for p in (0.1, 0.4, 0.6, 0.8, 0.95, 1.0)]
    ring = np.ones((30, 30), bool)
    ring[1:-1, 1:-1] = False
    masks.append(ring)
    rows = [(k, int(r), int(c)) for k, m in enumerate(masks) for r, c in np.argwhere(m)]
    df = spark.createDataFrame([*rows, rows[0]], "pour_id long, row long, col long").repartition(3)
    got = {r.pour_id: r for r in outlines.outlines(df, 0.0, 0.0, 1.0).collect()}
    for k, m in enumerate(masks):
        if not m.any():
            continue
        r, total = got[k], 0.0
        for p in r.rings:
            p = kernels.ring_points(p)
            d = np.diff(p, axis=0)
            assert (p[0] == p[-1]).all() and ((d == 0).sum(1) == 1).all() and all((a == 0).argmax() != (b == 0).argmax() for a, b in zip(d, d[1:], strict=False))
            assert kernels.crossings(p) == 0
            total += np.dot(p[:-1, 0], p[1:, 1]) - np.dot(p[1:, 0], p[:-1, 1])
        assert total / 2 == r.area == m.sum() and r.n_outer + r.n_holes == len(r.rings)
        assert kernels.shoelace(kernels.ring_points(r.rings[0])) == max(kernels.shoelace(kernels.ring_points(p)) for p in r.rings)
    assert (got[6].n_outer, got[6].n_holes, got[6].n_corners) == (1, 1, 8)


def test_crs_round_trip_and_known_places(spark):
    df = spark.createDataFrame([(-105.0, 40.0), (-96.0, 23.0), (-70.0, 45.0)], "lon double, lat double")
    x, y = crs.albers(F.col("lon"), F.col("lat"))
    there = df.withColumns({"x": x, "y": y})
    lon, lat = crs.albers_inverse(F.col("x"), F.col("y"))
    rows = there.select("lon", "lat", "x", "y", lon.alias("lon2"), lat.alias("lat2")).collect()
    assert all(abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9 for r in rows)
    assert abs(rows[1].x) < 1e-6 and abs(rows[1].y) < 1e-6
    x, y = crs.mercator(F.lit(180.0), F.lit(0.0))
    assert abs(spark.range(1).select(x).first()[0] - math.pi * 6378137) < 1e-6
    row, col = crs.pixel_of(F.lit(-105.005), F.lit(40.005), -105.0, 40.0, 0.01)
    assert tuple(spark.range(1).select(row, col).first()) == (-1, -1)


def test_zones_and_polar_systems(spark):
    """Published control points, the meridian's arc by quadrature, and round trips below a tenth of a millimetre."""
    c = F.col
    rows = [(-79.387139, 43.642567), (3.0, 45.0), (9.0, -33.3), (179.9999, 10.0), (5.5, 60.0), (20.0, 78.0), (44.4, 33.3), (-0.5, 0.0), (-69.3, -83.9)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    x, y, code = crs.utm(c("lon"), c("lat"))
    there = df.select("lon", "lat", x.alias("x"), y.alias("y"), code.alias("epsg"))
    lon, lat = crs.utm_inverse(c("x"), c("y"), c("epsg"))
    got = {(r.lon, r.lat): r for r in there.select("*", lon.alias("lon2"), lat.alias("lat2")).collect()}
    assert [got[k].epsg for k in rows] == [32617, 32631, 32732, 32660, 32632, 32633, 32638, 32630, 32719]
    assert abs(got[rows[0]].x - 630084) < 1 and abs(got[rows[0]].y - 4833438) < 1
    assert all(abs(r.lon2 - r.lon) < 1e-9 and abs(r.lat2 - r.lat) < 1e-9 for r in got.values())
    e2 = crs.FLAT84 * (2 - crs.FLAT84)
    for place, sign in ((rows[1], 1), (rows[2], -1)):  # on the central meridian
        phi = (np.arange(200_000) + 0.5) * math.radians(abs(place[1])) / 200_000
        arc = (crs.A * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5).mean() * math.radians(abs(place[1]))
        r = got[place]
        assert abs(r.x - 500_000) < 1e-6 and abs(r.y - (0.9996 * arc if sign > 0 else 1e7 - 0.9996 * arc)) < 1e-4
    x, y = crs.polar(F.lit(44.0), F.lit(73.0), 32661)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x - 3320416.75) < 0.01 and abs(r.y - 632668.43) < 0.01
    x, y = crs.polar(F.lit(50.0), F.lit(-75.0), 3031)  # the published point of the system turned by 70 degrees
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x - 1255380.79) < 0.01 and abs(r.y - 1053389.56) < 0.01
    for epsg, (pole, *_) in crs.POLAR.items():
        far = spark.createDataFrame([(float(k * 37 % 360 - 180), pole * (60.0 + k)) for k in range(31)], "lon double, lat double")
        x, y = crs.polar(c("lon"), c("lat"), epsg)
        lon, lat = crs.polar_inverse(c("x"), c("y"), epsg)
        for r in far.select("lon", "lat", x.alias("x"), y.alias("y")).select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
            assert abs(r.lat2 - r.lat) < 1e-9 and (abs(r.lat) == 90 or abs((r.lon2 - r.lon + 180) % 360 - 180) < 1e-9)


def test_contours(spark):
    cells = [(1, 0, 0), (2, 0, 0), (2, 1, 1), (3, 0, 0), (3, 0, 1), (3, 0, 2), (3, 1, 0), (3, 1, 2), (3, 2, 0), (3, 2, 1), (3, 2, 2)]
    got = {r.pour_id: r for r in outlines.contours(spark.createDataFrame(cells, "pour_id long, row long, col long")).collect()}
    assert {(p.x, p.y) for p in got[1].contours[0]} == {(0.5, 0), (0, 0.5), (-0.5, 0), (0, -0.5)} and got[1].area == 0.5 and len(got[1].contours[0]) == 5
    assert (got[2].n_contours, got[2].n_points, got[2].longest, got[2].area) == (2, 8, 4, 1.0)  # apart at a saddle
    assert (got[3].n_contours, got[3].n_points, got[3].longest, got[3].area) == (2, 16, 12, 8.0)
    assert len(got[3].contours[0]) == 13


def test_class_borders(spark):
    df = spark.createDataFrame([(float(x),) for x in (-1, 0, 5, 15, 20, 20.5, 100, 101, 500, 501)] + [(None,)], "v double")
    rows = df.select(classify.size_class_closed(F.col("v")), classify.size_class_halfopen(F.col("v")), classify.terrain_class(F.col("v"))).collect()
    assert [r[0] for r in rows] == [None, "small", "small", "small", "small", "medium", "medium", "large", "large", None, None]
    assert [r[1] for r in rows] == ["small", "small", "small", "small", "medium", "medium", "large", "large", "large", "large", None]
    assert [r[2] for r in rows] == [None, "flat", "flat", "moderate", "steep", "steep", "steep", "steep", "steep", "steep", None]
    same = classify.qcut3(spark.createDataFrame([(1.0,), (1.0,), (1.0,), (2.0,)], "v double"), "v", "k")
    assert {r.k for r in same.collect()} == {1}


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.clean_text(F.lit(" a \n b 3 of 10 c "))) == "a b  c"
    assert one(tx.format_size(F.lit(1024.0))) == "1.0 KB" and one(tx.format_size(F.lit(500.0))) == "500.0 B"
    assert [one(tx.format_duration(F.lit(float(s)))) for s in (59, 61, 3700)] == ["59s", "1m 1s", "1h 1m 40s"]


def test_thresholds_and_regressions(spark):
    df = spark.createDataFrame([(0.96, 150.0, "flat"), (0.86, 800.0, "steep"), (0.80, 1200.0, "moderate"), (None, 1.0, "montane"), (0.9, 500.0, "montane")], "iou double, centroid_m double, terrain string")
    assert [r.overall_pass for r in scoring.assess(df).collect()] == [True, True, False, False, True]
    metric = lambda rows: spark.createDataFrame(rows, "metric string, value double")
    out = {r.metric: (r.regressed, r.direction) for r in validators.regressions(metric([("iou", 0.95), ("runtime", 25.0), ("zero", 0.0)]), metric([("iou", 0.90), ("runtime", 30.0), ("zero", 1.0)]), 0.1).collect()}
    assert out == {"iou": (False, "down"), "runtime": (True, "up")}


def test_pick_one_rules(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 4.0), (2, 1.0, 1.0, 2.0, 2.0), (3, 20.0, 0.0, 24.0, 4.0), (4, 26.0, 0.0, 27.0, 1.0), (5, 50.0, 0.0, 51.0, 1.0)], "catchment_id long, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, 1.5, 1.5), (2, 25.0, 0.5), (3, 52.0, 0.5), (4, 90.0, 90.0)], "point_id long, px double, py double")
    got = {r.point_id: (r.catchment_id, r.method) for r in joins.truth_pick(joins.truth_candidates(points, boxes, 2.0)).collect()}
    assert got == {1: (1, "largest_containing"), 2: (4, "nearest_centroid"), 3: (5, "single_catchment")}


def test_delineation(spark):
    y, x = np.mgrid[0:14, 0:12]
    z = (13 - y) * 10.0 + abs(x - 6)
    z[5, 6] -= 30
    cells = spark.createDataFrame([(int(r), int(c), float(z[r, c])) for r in range(14) for c in range(12)], "row long, col long, elev double")
    pours = spark.createDataFrame([(1, 12, 6)], "pour_id long, row long, col long")
    row = delineation.delineate(Grid(cells, 14, 12), pours, (-105.0, 40.0), 0.01, 1000.0, threshold=3).first()
    assert row.n_cells > 60 and row.n_holes == 0 and row.crossings == 0 and row.score == 1.0 and row.n_stream > 5


def test_pipeline_stages(spark, sf_dir, tmp_path):
    from terrainframe.sources import bridge

    part = lambda c: bridge.view(spark, sf_dir, "part", c)
    stages = pipeline.accuracy_stages(bridge.view(spark, sf_dir, "customer", bridge.BASINS), part(bridge.FLOWLINES), part(bridge.CATCHMENTS))
    first = pipeline.run(spark, stages, str(tmp_path)).collect()
    assert [r.status for r in first] == ["completed"] * 3
    assert [r.status for r in pipeline.run(spark, stages, str(tmp_path)).collect()] == ["skipped"] * 3
    assert spark.read.parquet(f"{tmp_path}/scores").count() == spark.read.parquet(f"{tmp_path}/sample").count()

    def fail(*_):
        raise ValueError("no")

    broken = [pipeline.Stage("a", fail), pipeline.Stage("b", fail, ["a"])]
    assert [r.status for r in pipeline.run(spark, broken, f"{tmp_path}/x", tries=2, pause_s=0).collect()] == ["failed", "blocked"]


def test_rings(spark):
    df = spark.createDataFrame([(0.0, 0.0, 3.0, 4.0)], "a double, b double, c double, d double").select(g.box_ring(*[F.col(k) for k in "abcd"]).alias("r"))
    m = df.select(g.measures(F.col("r")).alias("m"), g.bounds(F.col("r")).alias("b"), g.ring_from_points(F.slice("r", 1, 4)).alias("again")).first()
    assert (m.m.area, m.m.length, m.m.x, m.m.y) == (12.0, 14.0, 1.5, 2.0) and tuple(m.b) == (0.0, 0.0, 3.0, 4.0) and len(m.again) == 5
