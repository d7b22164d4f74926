"""Queries on shapes: valid faces, overlays, relations and measures of polygons. Rings come from the data and cross themselves; SQL counts unit cells."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terrainframe.functions import geometry as g
from terrainframe.operators import overlay, predicates, validity
from terrainframe.plans.registry import query
from terrainframe.plans.vector import _QUADS, BASINS, _shape, basins
from terrainframe.sources import bridge

#: A ring goes from column to row and back over this many numbers of each axis, all below ``SPAN``.
TURNS, SPAN = 5, 8


def _walk(seed: int) -> tuple[list[str], list[str]]:
    """Columns and rows of a right-angled closed ring that crosses itself, as expressions of the customer's key."""
    return [f"(c_custkey * {6 * k + 5 + seed} + {k * k + seed}) % {SPAN}" for k in range(TURNS)], [f"(c_custkey * {10 * k + 7 + seed} + {3 * k + 2 * seed}) % {SPAN}" for k in range(TURNS)]


def _ring(seed: int):
    xs, ys = _walk(seed)
    corners = [p for k in range(TURNS) for p in ((xs[k], ys[k - 1 if k else TURNS - 1]), (xs[k], ys[k]))]
    point = lambda x, y: F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))
    return F.array(F.array(*[point(x, y) for x, y in (*corners, corners[0])]))


def _cells(seed: int, name: str) -> str:
    """name (pour_id, row, col): the unit cells inside, an odd number of upright edges to the right of them."""
    xs, ys = _walk(seed)
    edges = ", ".join(f"{{'x': {xs[k]}, 'low': least({ys[k - 1]}, {ys[k]}), 'high': greatest({ys[k - 1]}, {ys[k]})}}" for k in range(TURNS))
    return f"""{name} AS (SELECT pour_id, row, col FROM (SELECT c_custkey AS pour_id, unnest([{edges}]) AS e FROM customer), (SELECT unnest(range({SPAN})) AS row), (SELECT unnest(range({SPAN})) AS col)
        WHERE e.x > col AND row >= e.low AND row < e.high GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)"""


_COUNTED = "SELECT c_custkey AS shape_id, coalesce(q1 + q3 + 2 * qd, 0) AS n_corners, coalesce((q1 - q3 + 2 * qd) // 4, 0) AS outer_less_holes, coalesce(area, 0.0) AS area FROM customer LEFT JOIN n ON n.pour_id = c_custkey LEFT JOIN (SELECT pour_id, CAST(count(*) AS DOUBLE) AS area FROM shed GROUP BY 1) s ON s.pour_id = c_custkey"


def _counted(found):
    return found.select("shape_id", "n_corners", (F.col("n_outer") - F.col("n_holes")).cast("long").alias("outer_less_holes"), F.round("area", 6).alias("area"))


@query(f"WITH {_cells(0, 'shed')}, {_QUADS} {_COUNTED}")
def make_valid_shapes(spark, sf_dir):
    """Faces of rings that cross, touch and retrace themselves: corners, parts less holes and area follow from the cells inside."""
    shapes = bridge.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("shape_id"), _ring(0).alias("rings"))
    return _counted(overlay.make_valid(shapes))


def _pairs(spark, sf_dir):
    return bridge.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("shape_id"), _ring(0).alias("a"), _ring(3).alias("b"))


_SETS = {"intersection": "SELECT * FROM sa INTERSECT SELECT * FROM sb", "union": "SELECT * FROM sa UNION SELECT * FROM sb", "difference": "SELECT * FROM sa EXCEPT SELECT * FROM sb"}


def _overlay(region: str):
    def found(spark, sf_dir):
        return _counted(overlay.overlay(_pairs(spark, sf_dir), region))

    found.__name__ = f"overlay_{region}"
    found.__doc__ = f"The {region} of two such shapes as polygons."
    return query(f"WITH {_cells(0, 'sa')}, {_cells(3, 'sb')}, shed AS ({_SETS[region]}), {_QUADS} {_COUNTED}")(found)


overlay_intersection, overlay_union, overlay_difference = map(_overlay, _SETS)


@query(f"""WITH {_cells(0, 'sa')}, {_cells(3, 'sb')}, size AS (SELECT c_custkey AS id, (SELECT count(*) FROM sa WHERE pour_id = c_custkey) AS np, (SELECT count(*) FROM sb WHERE pour_id = c_custkey) AS nq FROM customer),
    common AS (SELECT pour_id, count(*) AS n FROM sa JOIN sb USING (pour_id, row, col) GROUP BY 1), c4 AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(i, j)),
    vp AS (SELECT DISTINCT pour_id, row + i AS row, col + j AS col FROM sa CROSS JOIN c4), vq AS (SELECT DISTINCT pour_id, row + i AS row, col + j AS col FROM sb CROSS JOIN c4), met AS (SELECT DISTINCT pour_id FROM vp JOIN vq USING (pour_id, row, col))
    SELECT id AS shape_id, met.pour_id IS NOT NULL AS intersects, coalesce(n = nq, false) AS contains, coalesce(n = np, false) AS within, met.pour_id IS NOT NULL AND n IS NULL AS touches FROM size LEFT JOIN common ON common.pour_id = id LEFT JOIN met ON met.pour_id = id""")
def shape_relations(spark, sf_dir):
    """Closed shapes meet if they share a corner of the grid."""
    return predicates.relate(_pairs(spark, sf_dir))


#: The shape of ``_shape`` as boxes that don't overlap, in parts of its width and height.
_TILES = [(0, 0, 1, 0.125), (0, 0.125, 0.125, 0.375), (0.375, 0.125, 1, 0.375), (0, 0.375, 1, 0.5), (0, 0.5, 0.5, 1), (1.25, 0, 1.5, 0.25)]
_TILED = "tiles AS (SELECT * FROM (VALUES " + ", ".join(str(tuple(map(float, t))) for t in _TILES) + ") t(a, b, c, d))"


def _shapes(df, key: str):
    c = F.col
    return df.select(c(key).alias("zone_id"), _shape(c("x0"), c("y0"), c("x1") - c("x0"), c("y1") - c("y0")).alias("rings"))


@query(f"""WITH {BASINS}, {bridge.sql('flowlines', bridge.FLOWLINES, 'part')}, {_TILED}, z AS (SELECT basin_id, x0 + a * (x1 - x0) AS bx0, y0 + b * (y1 - y0) AS by0, x0 + c * (x1 - x0) AS bx1, y0 + d * (y1 - y0) AS by1 FROM basins CROSS JOIN tiles),
    m AS (SELECT basin_id, bx0, by0, bx1, by1, x0 + 0.01 AS x0, y0 + 0.003 AS y0, f.x1 - f.x0 AS dx, f.y1 - f.y0 AS dy FROM z JOIN flowlines f ON least(f.x0, f.x1) <= bx1 AND greatest(f.x0, f.x1) + 1 >= bx0 AND least(f.y0, f.y1) <= by1 AND greatest(f.y0, f.y1) + 1 >= by0),
    t AS (SELECT basin_id, sqrt(dx * dx + dy * dy) AS len, CASE WHEN dx = 0 THEN CASE WHEN x0 BETWEEN bx0 AND bx1 THEN 0 ELSE 2 END ELSE least((bx0 - x0) / dx, (bx1 - x0) / dx) END AS ax, CASE WHEN dx = 0 THEN 1 ELSE greatest((bx0 - x0) / dx, (bx1 - x0) / dx) END AS zx, CASE WHEN dy = 0 THEN CASE WHEN y0 BETWEEN by0 AND by1 THEN 0 ELSE 2 END ELSE least((by0 - y0) / dy, (by1 - y0) / dy) END AS ay, CASE WHEN dy = 0 THEN 1 ELSE greatest((by0 - y0) / dy, (by1 - y0) / dy) END AS zy FROM m),
    s AS (SELECT basin_id, sum(greatest(0.0, least(1.0, zx, zy) - greatest(0.0, ax, ay)) * len) AS km FROM t GROUP BY 1), size AS (SELECT basin_id, sum((bx1 - bx0) * (by1 - by0)) AS area FROM z GROUP BY 1)
    SELECT basin_id AS zone_id, round(coalesce(km, 0.0), 5) AS stream_km, round(area, 6) AS area, round(coalesce(km, 0.0) / area, 5) AS density FROM size LEFT JOIN s USING (basin_id)""")
def stream_density_shapes(spark, sf_dir):
    """Flowlines, moved off the corners, inside concave basins with a hole and a part of their own."""
    c = F.col
    lines = bridge.view(spark, sf_dir, "part", bridge.FLOWLINES).select("line_id", (c("x0") + 0.01).alias("x0"), (c("y0") + 0.003).alias("y0"), (c("x1") + 0.01).alias("x1"), (c("y1") + 0.003).alias("y1"))
    found = predicates.stream_density(_shapes(basins(spark, sf_dir), "basin_id"), lines)
    return found.select("zone_id", F.round("stream_km", 5).alias("stream_km"), F.round("area", 6).alias("area"), F.round("density", 5).alias("density"))


def _near(spark, sf_dir):
    c = F.col
    at = basins(spark, sf_dir).select(c("basin_id").alias("point_id"), ((c("x0") + c("x1")) / 2 + 0.3).alias("px"), ((c("y0") + c("y1")) / 2 + 0.7).alias("py"))
    return at, _shapes(bridge.view(spark, sf_dir, "part", bridge.CATCHMENTS), "catchment_id")


_NEAR = f"""pts AS (SELECT basin_id AS point_id, (x0 + x1) / 2 + 0.3 AS px, (y0 + y1) / 2 + 0.7 AS py FROM basins), {_TILED}, z AS (SELECT catchment_id, x0 + a * (x1 - x0) AS bx0, y0 + b * (y1 - y0) AS by0, x0 + c * (x1 - x0) AS bx1, y0 + d * (y1 - y0) AS by1 FROM catchments CROSS JOIN tiles),
    size AS (SELECT catchment_id, sum((bx1 - bx0) * (by1 - by0)) AS area, sum((bx1 - bx0) * (by1 - by0) * (bx0 + bx1) / 2) / sum((bx1 - bx0) * (by1 - by0)) AS cx, sum((bx1 - bx0) * (by1 - by0) * (by0 + by1) / 2) / sum((bx1 - bx0) * (by1 - by0)) AS cy FROM z GROUP BY 1),
    met AS (SELECT point_id, catchment_id, px, py, min(pow(greatest(0.0, bx0 - px, px - bx1), 2) + pow(greatest(0.0, by0 - py, py - by1), 2)) AS d2 FROM pts JOIN z ON px BETWEEN bx0 - 6 AND bx1 + 6 AND py BETWEEN by0 - 6 AND by1 + 6 GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {BASINS}, {bridge.sql('catchments', bridge.CATCHMENTS, 'part')}, {_NEAR} SELECT point_id, catchment_id AS zone_id, d2 = 0 AS holds, round(area, 6) AS area, round(sqrt(pow(cx - px, 2) + pow(cy - py, 2)), 5) AS centre_distance FROM met JOIN size USING (catchment_id) WHERE d2 <= 36")
def truth_candidates_shapes(spark, sf_dir):
    """Catchments as concave polygons with a hole and a part of their own, within six units of points."""
    found = predicates.shape_candidates(*_near(spark, sf_dir), 6.0)
    return found.select("point_id", "zone_id", "holds", F.round("area", 6).alias("area"), F.round("centre_distance", 5).alias("centre_distance"))


@query(f"""WITH {BASINS}, {bridge.sql('catchments', bridge.CATCHMENTS, 'part')}, {_NEAR}, cand AS (SELECT point_id, catchment_id, d2 = 0 AS holds, area, round(sqrt(pow(cx - px, 2) + pow(cy - py, 2)), 6) AS far FROM met JOIN size USING (catchment_id) WHERE d2 <= 36),
    k AS (SELECT *, count(*) OVER (PARTITION BY point_id) AS n, count(*) FILTER (WHERE holds) OVER (PARTITION BY point_id) AS nh, row_number() OVER (PARTITION BY point_id ORDER BY holds DESC, CASE WHEN holds THEN -round(area, 6) ELSE far END, catchment_id) AS r FROM cand)
    SELECT point_id, catchment_id, CASE WHEN n = 1 THEN 'single_catchment' WHEN nh > 1 THEN 'largest_containing' WHEN nh = 1 THEN 'contains_point' ELSE 'nearest_centroid' END AS method FROM k WHERE r = 1""")
def truth_pick_shapes(spark, sf_dir):
    """One catchment a point, by the rules of the pick, over polygons."""
    found = predicates.shape_pick(*_near(spark, sf_dir), 6.0, 6)
    return found.select("point_id", F.col("zone_id").alias("catchment_id"), "method")


#: Radius and edges a turn of the buffers, and the area of their corner circle.
REACH, ARCS = 1.5, 16
_CIRCLE = f"{ARCS / 2 * REACH * REACH!r} * sin({2 * math.pi / ARCS!r})"


@query(f"WITH {BASINS} SELECT basin_id AS shape_id, round((x1 - x0) * (y1 - y0) + {2 * REACH} * (x1 - x0 + y1 - y0) + {_CIRCLE}, 6) AS area FROM basins")
def buffered_basins(spark, sf_dir):
    """Boxes with everything nearby: box, sides and a circle in four parts."""
    c = F.col
    rings = F.array(g.box_ring(c("x0"), c("y0"), c("x1"), c("y1")))
    found = overlay.buffered(basins(spark, sf_dir).select(c("basin_id").alias("shape_id"), rings.alias("rings")), None, REACH, ARCS)
    return found.select("shape_id", F.round("area", 6).alias("area"))


@query(f"WITH {bridge.sql('flowlines', bridge.FLOWLINES, 'part')} SELECT line_id AS shape_id, round({2 * REACH} * sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) + {_CIRCLE}, 6) AS area FROM flowlines")
def buffered_lines(spark, sf_dir):
    """Flowlines, some of them points, with everything nearby."""
    lines = bridge.view(spark, sf_dir, "part", bridge.FLOWLINES).withColumnRenamed("line_id", "shape_id")
    return overlay.buffered(None, lines, REACH, ARCS).select("shape_id", F.round("area", 6).alias("area"))


_FAULT = "CASE c_custkey % 9 WHEN 1 THEN 'self_crossing' WHEN 2 THEN 'rings_cross' WHEN 3 THEN 'repeated_edge' WHEN 4 THEN 'hole_outside' WHEN 5 THEN 'hole_nested' WHEN 6 THEN 'not_closed' WHEN 7 THEN 'not_finite' END"
#: Where the fault is, in parts of the box's width and height; null for point faults.
_WHERE = {"x": "CASE c_custkey % 9 WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 WHEN 3 THEN 1.0 WHEN 4 THEN 1.375 WHEN 5 THEN 0.4375 END", "y": "CASE c_custkey % 9 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 WHEN 3 THEN 0.5 WHEN 4 THEN 0.0 WHEN 5 THEN 0.375 END"}


@query(f"WITH {BASINS} SELECT basin_id AS shape_id, {_FAULT} IS NULL AS valid, {_FAULT} AS rule, round(x0 + {_WHERE['x']} * (x1 - x0), 6) AS x, round(y0 + {_WHERE['y']} * (y1 - y0), 6) AS y FROM basins JOIN customer ON c_custkey = basin_id")
def shape_validity(spark, sf_dir):
    """Basins with a hole, each kind of fault put into some of them: the rule and the place it is found at."""
    c, k = F.col, F.col("basin_id") % 9
    x, y, w, h = c("x0"), c("y0"), c("x1") - c("x0"), c("y1") - c("y0")
    ring = lambda *ps: F.array(*[F.struct((x + a * w).alias("x"), (y + b * h).alias("y")) for a, b in ps])
    square = lambda a, b, p, q: ring((a, b), (p, b), (p, q), (a, q), (a, b))
    shell, hole = square(0, 0, 1, 1), square(0.25, 0.25, 0.75, 0.75)
    nan = F.array(F.struct(F.lit(float("nan")).alias("x"), y.alias("y")))
    rings = (
        F.when(k == 1, F.array(ring((0, 0), (1, 1), (1, 0), (0, 1), (0, 0)))).when(k == 2, F.array(shell, square(0.5, 0.5, 0.75, 1.5)))
        .when(k == 3, F.array(ring((0, 0), (1, 0), (1, 0.5), (1.5, 0.5), (1, 0.5), (1, 1), (0, 1), (0, 0)))).when(k == 4, F.array(shell, square(1.25, 0, 1.5, 0.25)))
        .when(k == 5, F.array(shell, hole, square(0.375, 0.375, 0.5, 0.5))).when(k == 6, F.array(F.slice(shell, 1, 4), hole)).when(k == 7, F.array(F.concat(F.slice(shell, 1, 2), nan, F.slice(shell, 3, 3)), hole)).otherwise(F.array(shell, hole))
    )
    found = validity.validity(basins(spark, sf_dir).select(c("basin_id").alias("shape_id"), rings.alias("rings")))
    return found.select("shape_id", "valid", "rule", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_UPRIGHT = ", ".join(f"{{'x': {x}, 'low': least({p}, {q}), 'high': greatest({p}, {q})}}" for x, p, q in ((_walk(0)[0][k], _walk(0)[1][k - 1], _walk(0)[1][k]) for k in range(TURNS)))
_LEVEL = ", ".join(f"{{'y': {y}, 'low': least({p}, {q}), 'high': greatest({p}, {q})}}" for y, p, q in ((_walk(0)[1][k], _walk(0)[0][k], _walk(0)[0][(k + 1) % TURNS]) for k in range(TURNS)))


@query(f"SELECT c_custkey AS shape_id, count(*) FILTER (WHERE v.low < h.y AND h.y < v.high AND h.low < v.x AND v.x < h.high) AS n FROM (SELECT c_custkey, unnest([{_UPRIGHT}]) AS v FROM customer) JOIN (SELECT c_custkey, unnest([{_LEVEL}]) AS h FROM customer) USING (c_custkey) GROUP BY 1")
def shape_crossings(spark, sf_dir):
    """How often the edges of a ring cross inside both."""
    shapes = bridge.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("shape_id"), _ring(0).alias("rings"))
    found = validity.crossings(validity.ring_edges(shapes)).groupBy("shape_id").agg(F.count("*").alias("n"))
    return shapes.select("shape_id").join(found, "shape_id", "left").select("shape_id", F.coalesce("n", F.lit(0)).alias("n"))
