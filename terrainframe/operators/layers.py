"""Upkeep of vector layers: coordinate checks, reference systems, issue statistics, nearest vertices, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrainframe.functions import crs
from terrainframe.operators import joins
from terrainframe.tables import dealt

#: Limits of coordinates (fixed values): of longitude, latitude and any projected value.
LON_MOST, LAT_MOST, ANY_MOST = 180.0, 90.0, 1e8


def coordinate_error(x: Column, y: Column, degrees: Column) -> Column:
    """Why a coordinate can't be used, or null: not finite, outside degrees, or too large for any system."""
    bad = x.isNull() | y.isNull() | F.isnan(x) | F.isnan(y) | (F.abs(x) == float("inf")) | (F.abs(y) == float("inf"))
    return (
        F.when(bad, "not_finite").when(degrees & (F.abs(x) > LON_MOST), "longitude_range").when(degrees & (F.abs(y) > LAT_MOST), "latitude_range")
        .when(~degrees & ((F.abs(x) > ANY_MOST) | (F.abs(y) > ANY_MOST)), "extreme")
    )


def cleaned_ring(ring: Column, degrees: Column) -> Column:
    """The ring without points that can't be used, closed again; null if fewer than three are left."""
    good = F.filter(F.slice(ring, 1, F.size(ring) - 1), lambda p: coordinate_error(p.x, p.y, degrees).isNull())
    return F.transform(F.array(good), lambda g: F.when(F.size(g) >= 3, F.concat(g, F.slice(g, 1, 1))))[0]


def assumed_crs(declared: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """(epsg, how): the declared system; else degrees if the box fits them; else metres of the default projection if it fits those; else none.

    A system is only named here; coordinates are never relabelled as another system's.
    """
    degrees = (x0 >= -LON_MOST) & (x1 <= LON_MOST) & (y0 >= -LAT_MOST) & (y1 <= LAT_MOST)
    metres = (F.abs(x0) <= ANY_MOST) & (F.abs(x1) <= ANY_MOST) & (F.abs(y0) <= ANY_MOST) & (F.abs(y1) <= ANY_MOST)
    made = lambda epsg, how: F.struct(epsg.alias("epsg"), F.lit(how).alias("how"))
    return F.when(declared.isNotNull(), made(declared, "declared")).when(degrees, made(F.lit(4326), "degrees")).when(metres, made(F.lit(5070), "metres")).otherwise(made(F.lit(None).cast("int"), "none"))


def projected_ring(ring: Column) -> Column:
    """A ring in degrees as one in metres of the equal-area projection."""

    def moved(p: Column) -> Column:
        x, y = crs.albers(p.x, p.y)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, moved)


#: Shape of the Earth (WGS84, fixed values).
MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
MINOR = MAJOR * (1 - FLATTENING)
ROUNDS = 12


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: int = ROUNDS) -> Column:
    """Metres along the ellipsoid by the inverse formula of Vincenty, with a fixed number of rounds; null for nearly opposite points."""
    u1, u2 = F.atan((1 - FLATTENING) * F.tan(F.radians(lat1))), F.atan((1 - FLATTENING) * F.tan(F.radians(lat2)))
    given = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), F.radians(lon2 - lon1).alias("lon"))

    def angles(g: Column, lam: Column) -> Column:
        a, b = g.c2 * F.sin(lam), g.c1 * g.s2 - g.s1 * g.c2 * F.cos(lam)
        sine, cosine = F.sqrt(a * a + b * b), g.s1 * g.s2 + g.c1 * g.c2 * F.cos(lam)
        alpha = F.coalesce(F.try_divide(g.c1 * g.c2 * F.sin(lam), sine), F.lit(0.0))
        square = 1 - alpha * alpha
        middle = cosine - F.coalesce(F.try_divide(2 * g.s1 * g.s2, square), cosine)
        return F.struct(sine.alias("sine"), cosine.alias("cosine"), F.atan2(sine, cosine).alias("sigma"), alpha.alias("alpha"), square.alias("square"), middle.alias("middle"))

    def step(g: Column, lam: Column) -> Column:
        def one(t: Column) -> Column:
            c = FLATTENING / 16 * t.square * (4 + FLATTENING * (4 - 3 * t.square))
            return g.lon + (1 - c) * FLATTENING * t.alpha * (t.sigma + c * t.sine * (t.middle + c * t.cosine * (2 * t.middle * t.middle - 1)))

        return F.transform(F.array(angles(g, lam)), one)[0]

    def metres(t: Column) -> Column:
        u = t.square * ((MAJOR**2 - MINOR**2) / MINOR**2)
        a = 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768))
        b = u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))
        m = t.middle
        off = b * t.sine * (m + b / 4 * (t.cosine * (2 * m * m - 1) - b / 6 * m * (4 * t.sine * t.sine - 3) * (4 * m * m - 3)))
        return MINOR * a * (t.sigma - off)

    def solved(g: Column) -> Column:
        # the last two rounds agree unless the points are nearly opposite
        pair = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(g.lon.alias("now"), (g.lon + 1).alias("before")), lambda p, _: F.struct(step(g, p.now).alias("now"), p.now.alias("before")))
        return F.transform(F.array(pair), lambda p: F.when(F.abs(p.now - p.before) < 1e-11, F.transform(F.array(angles(g, p.now)), metres)[0]))[0]

    return F.transform(F.array(given), solved)[0]


def issue_stats(diagnosed: DataFrame) -> DataFrame:
    """issue, strategy, n, share_pct of ``(issue, strategy)`` rows."""
    counted = diagnosed.groupBy("issue", "strategy").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(diagnosed.agg(F.count("*").alias("total")))).select("issue", "strategy", "n", (100 * F.col("n") / F.col("total")).alias("share_pct"))


def vertices(lines: DataFrame) -> DataFrame:
    """line_id, x, y: all points of lines ``(line_id, path)`` (an array of points), or the ends of ``(line_id, x0 .. y1)``."""
    c = F.col
    ends = c("path") if "path" in lines.columns else F.array(F.struct(c("x0").alias("x"), c("y0").alias("y")), F.struct(c("x1").alias("x"), c("y1").alias("y")))
    return lines.select("line_id", F.explode(ends).alias("p")).select("line_id", "p.x", "p.y")


def nearest_vertex(points: DataFrame, lines: DataFrame, within: float) -> DataFrame:
    """point_id, line_id, x, y, d: the nearest vertex of a line within reach of ``(point_id, px, py)``; ties by line and place."""
    c = F.col
    boxes = vertices(lines).withColumns({"bx0": c("x"), "by0": c("y"), "bx1": c("x"), "by1": c("y")})
    met = joins.overlapping(joins.around(points, within), boxes)
    d = F.sqrt((c("px") - c("x")) * (c("px") - c("x")) + (c("py") - c("y")) * (c("py") - c("y")))
    best = met.withColumn("d", d).where(c("d") <= within).groupBy("point_id").agg(F.min(F.struct("d", "line_id", "x", "y")).alias("b"))
    return best.select("point_id", "b.line_id", "b.x", "b.y", "b.d")


def worst(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their rank: a report, so the limit is the feature."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def ranked(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def window_of(cells: DataFrame, row0: int, col0: int, height: int, width: int) -> DataFrame:
    """A sub-rectangle of a raster, renumbered from its corner; the filter reaches the Parquet scan."""
    inside = cells.where(F.col("row").between(row0, row0 + height - 1) & F.col("col").between(col0, col0 + width - 1))
    return inside.withColumns({"row": F.col("row") - row0, "col": F.col("col") - col0})


def split_samples(samples: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples ``(id, ...)`` that have a truth, and those that failed, for the error table."""
    samples, ids = dealt(samples, "id"), dealt(truth.select("id"), "id").distinct()
    return samples.join(ids, "id", "left_semi"), samples.join(ids, "id", "left_anti")
