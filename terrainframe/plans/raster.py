"""Raster and flow queries over the driver's orders as an elevation grid."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terrainframe.operators import hydrology, stencil
from terrainframe.plans.registry import query
from terrainframe.sources import bridge

RESOLUTION, STREAM = 10.0, 5
_STEPS = stencil.STEPS


def _base(gappy: bool = False) -> str:
    """cells, size (h), and nb: each cell with its eight neighbours."""
    joins = " ".join(f"LEFT JOIN cells n{k} ON n{k}.row = c.row + ({dr}) AND n{k}.col = c.col + ({dc})" for k, (dr, dc) in _STEPS.items())
    values = ", ".join(f"n{k}.elev AS e{k}" for k in _STEPS)
    return f"""{bridge.sql('cells', bridge.GAPPY if gappy else bridge.CELLS, 'orders')}, size AS (SELECT max(row) + 1 AS h FROM cells),
        nb AS (SELECT c.row, c.col, c.elev AS z, {values}, c.row BETWEEN 1 AND size.h - 2 AND c.col BETWEEN 1 AND 118 AS interior FROM cells c CROSS JOIN size {joins})"""


_TOP = "greatest(" + ", ".join(f"z - e{k}" for k in _STEPS) + ")"
_CODE = "CASE " + " ".join(f"WHEN z - e{k} = top THEN {k}" for k in _STEPS) + " END"
_FLOW = f"""top AS (SELECT *, CASE WHEN interior AND z IS NOT NULL THEN {_TOP} END AS top FROM nb),
    flow AS (SELECT row, col, z AS elev, CAST(CASE WHEN top > 0 THEN {_CODE} ELSE 0 END AS INTEGER) AS code, CASE WHEN top > 0 THEN top END AS drop_ FROM top)"""
_DR = "CASE code " + " ".join(f"WHEN {k} THEN {dr}" for k, (dr, _) in _STEPS.items()) + " END"
_DC = "CASE code " + " ".join(f"WHEN {k} THEN {dc}" for k, (_, dc) in _STEPS.items()) + " END"
_DOWN = f"""down AS (SELECT * FROM (SELECT row, col, row + {_DR} AS to_row, col + {_DC} AS to_col FROM flow WHERE code <> 0) CROSS JOIN size
    WHERE to_row BETWEEN 0 AND h - 1 AND to_col BETWEEN 0 AND 119)"""
_NET = "net AS (SELECT d.row, d.col, d.to_row, d.to_col FROM down d JOIN flow f ON f.row = d.to_row AND f.col = d.to_col WHERE f.code <> 0)"
_POURS = "pours AS (SELECT CAST(c_custkey AS BIGINT) AS pour_id, CAST(1 + (c_custkey * 7) % (h - 2) AS BIGINT) AS row, CAST(1 + (c_custkey * 31) % 118 AS BIGINT) AS col FROM customer CROSS JOIN size)"
_SHED = """shed AS (SELECT pour_id, row, col FROM pours UNION ALL SELECT s.pour_id, d.row, d.col FROM shed s JOIN down d ON d.to_row = s.row AND d.to_col = s.col)"""
_ACC = """walk AS (SELECT row, col, row AS at_row, col AS at_col FROM flow WHERE code <> 0
    UNION ALL SELECT w.row, w.col, n.to_row, n.to_col FROM walk w JOIN net n ON n.row = w.at_row AND n.col = w.at_col),
    acc AS (SELECT c.row, c.col, coalesce(a.n, 1) AS acc FROM cells c LEFT JOIN (SELECT at_row, at_col, count(*) AS n FROM walk GROUP BY 1, 2) a ON a.at_row = c.row AND a.at_col = c.col)"""


def _all(*parts: str, gappy: bool = False) -> str:
    return "WITH RECURSIVE " + ", ".join([_base(gappy), _FLOW, *parts])


_OFFSETS = "offs AS (SELECT * FROM (VALUES " + ", ".join(f"({dr}, {dc})" for dr in (-1, 0, 1) for dc in (-1, 0, 1)) + ") t(dr, dc))"
#: The filled cells of ``raw``: all levels come down from above, round by round, until none moves.
_FILL = f"""{_OFFSETS}, ground AS (SELECT row, col, elev AS z FROM raw WHERE elev IS NOT NULL),
    start AS (SELECT g.row, g.col, g.z, CASE WHEN count(o.z) < 9 THEN g.z ELSE 1e300 END AS w FROM ground g CROSS JOIN offs LEFT JOIN ground o ON o.row = g.row + dr AND o.col = g.col + dc GROUP BY 1, 2, 3),
    f AS (SELECT 0 AS it, row, col, w, true AS moved FROM start UNION ALL SELECT it + 1, row, col, w, bool_or(w < was) OVER () FROM (SELECT it, s.row, s.col, greatest(s.z, min(f.w)) AS w, min(CASE WHEN dr = 0 AND dc = 0 THEN f.w END) AS was
        FROM f CROSS JOIN offs JOIN start s ON s.row = f.row + dr AND s.col = f.col + dc WHERE f.moved GROUP BY it, s.row, s.col, s.z)),
    cells AS (SELECT row, col, w AS elev FROM f WHERE it = (SELECT max(it) FROM f))"""


def _all_filled(*parts: str) -> str:
    """As ``_all``, over the filled cells."""
    plain = bridge.sql("cells", bridge.CELLS, "orders")
    return "WITH RECURSIVE " + ", ".join([_base().replace(plain, f"{bridge.sql('raw', bridge.CELLS, 'orders')}, {_FILL}"), _FLOW, *parts])


def _pours(spark, sf_dir, grid):
    """Every customer is a pour point; several may share a cell."""
    row, col = 1 + (F.col("c_custkey") * 7) % (grid.height - 2), 1 + (F.col("c_custkey") * 31) % 118
    return bridge.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pour_id"), row.cast("long").alias("row"), col.cast("long").alias("col"))


@query(_all(gappy=True).replace("CASE WHEN top > 0 THEN CASE", "CASE WHEN top IS NOT NULL THEN CASE").replace("CASE WHEN top > 0 THEN top END", "top") + " SELECT row, col, code, round(drop_, 6) AS drop_m FROM flow")
def d8_flow_direction(spark, sf_dir):
    flow = stencil.d8(bridge.grid(spark, sf_dir, gappy=True), enforce=False)
    return flow.select("row", "col", "code", F.round("drop", 6).alias("drop_m"))


@query(_all(gappy=True) + " SELECT row, col, code, round(drop_, 6) AS drop_m FROM flow")
def d8_enforced(spark, sf_dir):
    return stencil.d8(bridge.grid(spark, sf_dir, gappy=True)).select("row", "col", "code", F.round("drop", 6).alias("drop_m"))


@query(_all(gappy=True) + f" SELECT f.row, f.col, f.code, CAST(CASE WHEN interior AND z IS NOT NULL THEN {' + '.join(f'CASE WHEN z - e{k} > 0 THEN 1 ELSE 0 END' for k in _STEPS)} ELSE 0 END AS INTEGER) AS n_lower FROM flow f JOIN nb USING (row, col)")
def mfd_direction(spark, sf_dir):
    return stencil.mfd(bridge.grid(spark, sf_dir, gappy=True))


def _facet(i: int, a: int, b: int) -> str:
    base, turn = i * math.pi / 4, 2 * math.pi
    low, high = (base - math.pi / 8) % turn, (base + math.pi / 8) % turn
    flat = f"z - e{a} <= 0 AND z - e{b} <= 0"
    return f"SELECT row, col, {i} AS i, CASE WHEN {flat} THEN 0.0 ELSE greatest(z - e{a}, z - e{b}) END AS slope, CASE WHEN {flat} THEN {base!r} WHEN z - e{a} > z - e{b} THEN {low!r} ELSE {high!r} END AS angle FROM nb WHERE interior AND z IS NOT NULL AND e{a} IS NOT NULL AND e{b} IS NOT NULL"


@query(_all("facets AS (" + " UNION ALL ".join(_facet(i, a, b) for i, (a, b) in enumerate(stencil.FACETS)) + "), best AS (SELECT row, col, arg_min(angle, i) AS angle, max(slope) AS slope FROM (SELECT *, max(slope) OVER (PARTITION BY row, col) AS top FROM facets) WHERE slope = top GROUP BY 1, 2)", gappy=True)
       + " SELECT nb.row, nb.col, round(coalesce(angle, 0.0), 9) AS angle, round(coalesce(slope, 0.0), 6) AS slope FROM nb LEFT JOIN best USING (row, col) WHERE interior AND z IS NOT NULL")
def dinf_direction(spark, sf_dir):
    found = stencil.dinf(bridge.grid(spark, sf_dir, gappy=True))
    return found.select("row", "col", F.round("angle", 9).alias("angle"), F.round("slope", 6).alias("slope"))


@query(_all("g AS (SELECT row, col, (e3 - e7) / 2 AS dx, (e1 - e5) / 2 AS dy FROM nb WHERE interior AND z IS NOT NULL)")
       + " SELECT row, col, round(CASE WHEN dx = 0 AND dy = 0 THEN 0.0 WHEN degrees(atan2(dy, dx)) < 0 THEN degrees(atan2(dy, dx)) + 360 ELSE degrees(atan2(dy, dx)) END, 6) AS angle FROM g WHERE dx IS NOT NULL AND dy IS NOT NULL")
def gradient_angle(spark, sf_dir):
    return stencil.gradient_angle(bridge.grid(spark, sf_dir)).select("row", "col", F.round("angle", 6).alias("angle"))


_GX = "CASE WHEN col = 0 THEN e3 - z WHEN col = 119 THEN z - e7 ELSE (e3 - e7) / 2 END"
_GY = "CASE WHEN row = 0 THEN e5 - z WHEN row = size.h - 1 THEN z - e1 ELSE (e5 - e1) / 2 END"


@query(_all() + f" SELECT row, col, round(sqrt(({_GX}) * ({_GX}) + ({_GY}) * ({_GY})), 5) AS slope FROM nb CROSS JOIN size")
def gradient_slope(spark, sf_dir):
    return stencil.gradient_slope(bridge.grid(spark, sf_dir)).select("row", "col", F.round("slope", 5).alias("slope"))


@query(_all(_DOWN, _NET) + " SELECT row, col, to_row, to_col FROM net")
def flow_edges(spark, sf_dir):
    grid = bridge.grid(spark, sf_dir)
    return hydrology.network(stencil.d8(grid), grid)


@query(_all(_DOWN) + " SELECT row, col, to_row, to_col FROM down")
def downstream_cell(spark, sf_dir):
    grid = bridge.grid(spark, sf_dir)
    return hydrology.downstream(stencil.d8(grid), grid)


@query(_all(_DOWN) + " SELECT to_row AS row, to_col AS col, count(*) AS n FROM down GROUP BY 1, 2")
def upstream_degree(spark, sf_dir):
    grid = bridge.grid(spark, sf_dir)
    return hydrology.upstream_degree(stencil.d8(grid), grid)


@query(_all(gappy=True) + " SELECT f.row, f.col FROM flow f JOIN nb USING (row, col) WHERE interior AND z IS NOT NULL AND code = 0")
def sinks(spark, sf_dir):
    grid = bridge.grid(spark, sf_dir, gappy=True)
    return stencil.d8(grid).where(grid.interior & F.col("elev").isNotNull() & (F.col("code") == 0)).select("row", "col")


@query(_all(_DOWN, _NET, _ACC) + " SELECT row, col, acc FROM acc")
def flow_accumulation(spark, sf_dir):
    grid = bridge.grid(spark, sf_dir)
    return hydrology.accumulate(stencil.d8(grid), grid)


@query(_all(_DOWN, "hop AS (SELECT row, col, to_row, to_col, 1 AS n FROM down UNION ALL SELECT h.row, h.col, d.to_row, d.to_col, n + 1 FROM hop h JOIN down d ON d.row = h.to_row AND d.col = h.to_col)") + " SELECT row, col, CAST(max(n) AS BIGINT) AS hops FROM hop GROUP BY 1, 2")
def hops_to_outlet(spark, sf_dir):
    grid = bridge.grid(spark, sf_dir)
    return hydrology.hops_to_outlet(stencil.d8(grid), grid)


@query(_all(_DOWN, _POURS, _SHED) + " SELECT pour_id, row, col FROM shed")
def watershed_cells(spark, sf_dir):
    grid = bridge.grid(spark, sf_dir)
    return hydrology.watersheds(stencil.d8(grid), grid, _pours(spark, sf_dir, grid))


@query(_all(_DOWN, _NET, _ACC, _POURS, _SHED) + f" SELECT pour_id, row, col, acc FROM shed JOIN acc USING (row, col) WHERE acc >= {STREAM}")
def stream_cells(spark, sf_dir):
    grid = bridge.grid(spark, sf_dir)
    flow = hydrology.written(stencil.d8(grid), "flow")
    shed = hydrology.watersheds(flow, grid, _pours(spark, sf_dir, grid))
    return hydrology.streams(hydrology.accumulate(flow, grid), shed, STREAM).select("pour_id", "row", "col", "acc")


_AROUND = "(VALUES " + ", ".join(f"({dr}, {dc})" for dr, dc in _STEPS.values()) + ") o(dr, dc)"
_EDGE = f"edge AS (SELECT s.pour_id, s.row, s.col FROM shed s CROSS JOIN {_AROUND} LEFT JOIN shed t ON t.pour_id = s.pour_id AND t.row = s.row + dr AND t.col = s.col + dc GROUP BY 1, 2, 3 HAVING count(t.row) < 8)"


@query(_all(_DOWN, _POURS, _SHED, _EDGE) + " SELECT pour_id, row, col FROM edge")
def watershed_boundary(spark, sf_dir):
    return hydrology.boundary(watershed_cells(spark, sf_dir))


@query(_all(_DOWN, _POURS, _SHED) + f" SELECT pour_id, count(*) AS n_cells, count(*) * {RESOLUTION * RESOLUTION} / 1e6 AS area_km2 FROM shed GROUP BY 1")
def watershed_area(spark, sf_dir):
    grid = bridge.grid(spark, sf_dir)
    ones = grid.cells.select("row", "col", F.lit(1).cast("long").alias("n_cells"))
    found = hydrology.watershed_sums(hydrology.written(stencil.d8(grid), "flow"), grid, _pours(spark, sf_dir, grid), ones, ["n_cells"])
    return found.select("pour_id", "n_cells", (F.col("n_cells") * (RESOLUTION * RESOLUTION) / 1e6).alias("area_km2"))


@query(_all(_DOWN, _POURS, _SHED, _EDGE) + f" SELECT pour_id, count(*) AS n_boundary, count(*) * {RESOLUTION} / 1000 AS perimeter_km FROM edge GROUP BY 1")
def watershed_perimeter(spark, sf_dir):
    return hydrology.perimeters(watershed_boundary(spark, sf_dir), RESOLUTION)


@query(_all(_DOWN, _NET, _ACC, _POURS, _SHED) + f" SELECT pour_id, count(*) AS n_cells, count(*) * {RESOLUTION * RESOLUTION} / 1e6 AS area_km2, count(CASE WHEN acc >= {STREAM} THEN 1 END) AS n_stream, max(acc) AS max_acc FROM shed JOIN acc USING (row, col) GROUP BY 1")
def watershed_summary(spark, sf_dir):
    """The flagship: direction, accumulation and trace of all pour points, summed by watershed."""
    grid = bridge.grid(spark, sf_dir)
    flow = hydrology.written(stencil.d8(grid), "flow")
    summed = hydrology.watershed_counts(flow, grid, _pours(spark, sf_dir, grid), hydrology.accumulate(flow, grid), STREAM)
    return summed.select("pour_id", "n_cells", (F.col("n_cells") * (RESOLUTION * RESOLUTION) / 1e6).alias("area_km2"), "n_stream", "max_acc")


@query(f"WITH RECURSIVE {bridge.sql('raw', bridge.GAPPY, 'orders')}, {_FILL} SELECT row, col, elev FROM cells")
def depression_fill(spark, sf_dir):
    return hydrology.fill(bridge.grid(spark, sf_dir, gappy=True))


_LINES = ["s_suppkey AS line_id", "(s_suppkey * 7) % {h} AS r0", "(s_suppkey * 13) % 120 AS c0", "(s_suppkey * 11 + 5) % {h} AS r1", "(s_suppkey * 17 + 3) % 120 AS c1"]
_PIX = """lines AS (SELECT s_suppkey AS line_id, (s_suppkey * 7) % h AS r0, (s_suppkey * 13) % 120 AS c0, (s_suppkey * 11 + 5) % h AS r1, (s_suppkey * 17 + 3) % 120 AS c1 FROM supplier CROSS JOIN size),
    t AS (SELECT line_id, abs(r1 - r0) > abs(c1 - c0) AS steep, r0, c0, r1, c1 FROM lines),
    u AS (SELECT line_id, steep, CASE WHEN steep THEN r0 ELSE c0 END AS x0, CASE WHEN steep THEN c0 ELSE r0 END AS y0, CASE WHEN steep THEN r1 ELSE c1 END AS x1, CASE WHEN steep THEN c1 ELSE r1 END AS y1 FROM t),
    v AS (SELECT line_id, steep, least(x0, x1) AS xa, greatest(x0, x1) AS xb, CASE WHEN x0 > x1 THEN y1 ELSE y0 END AS ya, CASE WHEN x0 > x1 THEN y0 ELSE y1 END AS yb FROM u),
    pix AS (SELECT line_id, steep, xa AS x, xa, xb, ya AS y, (xb - xa) // 2 AS err, xb - xa AS dx, abs(yb - ya) AS dy, CASE WHEN ya < yb THEN 1 ELSE -1 END AS step FROM v
        UNION ALL SELECT line_id, steep, x + 1, xa, xb, CASE WHEN err - dy < 0 THEN y + step ELSE y END, CASE WHEN err - dy < 0 THEN err - dy + dx ELSE err - dy END, dx, dy, step FROM pix WHERE x < xb),
    px AS (SELECT line_id, CAST(CASE WHEN steep THEN x ELSE y END AS BIGINT) AS row, CAST(CASE WHEN steep THEN y ELSE x END AS BIGINT) AS col FROM pix)"""


def _lines(spark, sf_dir, grid):
    return bridge.view(spark, sf_dir, "supplier", [e.format(h=grid.height) for e in _LINES])


@query(_all(_PIX) + " SELECT line_id, row, col FROM px")
def bresenham_pixels(spark, sf_dir):
    return stencil.bresenham(_lines(spark, sf_dir, bridge.grid(spark, sf_dir)))


@query(_all(_PIX, gappy=True) + " SELECT c.row, c.col, round(elev - 5.0 * coalesce(n, 0), 6) AS elev FROM cells c LEFT JOIN (SELECT row, col, count(DISTINCT line_id) AS n FROM px GROUP BY 1, 2) USING (row, col)")
def burn_streams(spark, sf_dir):
    grid = bridge.grid(spark, sf_dir, gappy=True)
    return stencil.burn_lines(grid, _lines(spark, sf_dir, grid)).select("row", "col", F.round("elev", 6).alias("elev"))


_W = [math.exp(-0.5 * (k / 0.5) ** 2) for k in range(-2, 3)]
_TAPS = "(VALUES " + ", ".join(f"({k}, {w / sum(_W)!r}::DOUBLE)" for k, w in zip(range(-2, 3), _W, strict=True)) + ") tap(k, w)"


def _pass(source: str, axis: str, size: str) -> str:
    other = "col" if axis == "row" else "row"
    at = f"CASE WHEN {axis} + k < 0 THEN -1 - ({axis} + k) WHEN {axis} + k >= {size} THEN 2 * {size} - 1 - ({axis} + k) ELSE {axis} + k END"
    return f"SELECT {other}, a AS {axis}, sum(elev * w) / sum(w) AS elev FROM (SELECT {other}, {at} AS a, elev, w FROM {source} CROSS JOIN size CROSS JOIN {_TAPS} WHERE elev IS NOT NULL) GROUP BY 1, 2"


@query(_all(f"p1 AS ({_pass('cells', 'row', 'size.h')}), p2 AS ({_pass('p1', 'col', '120')})") + " SELECT c.row, c.col, round(p2.elev, 4) AS elev FROM cells c LEFT JOIN p2 USING (row, col)")
def gaussian_smooth(spark, sf_dir):
    return stencil.smooth(bridge.grid(spark, sf_dir)).select("row", "col", F.round("elev", 4).alias("elev"))
