"""Planar geometry as column expressions. A ring is ``array<struct<x: double, y: double>>`` whose last point equals its first."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, WGS84_A = 6371.0, 6378137.0
#: Square kilometres a square degree, as three tools of this field assume: kept apart, not unified.
KM2_TOPOLOGY, KM2_SUMMARY, KM2_CLI = 12391.0, 111.32**2, 111.0**2
KM_TOPOLOGY, KM_SUMMARY = 111.0, 111.32


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1), at(x0, y0))


def let(value: Column, body) -> Column:
    """Bind a value to a lambda variable: it is computed once a row however often ``body`` uses it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def measures(ring: Column) -> Column:
    """(area, length, x, y) of a ring in one walk along its edges; x and y are the area centroid, or the points' mean without area."""

    def walk(r: Column) -> Column:
        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("a2", "cx", "cy", "length", "sx", "sy")])

        def step(t: Column, i: Column) -> Column:
            a, b = F.get(r, i - 1), F.get(r, i)
            cross = a.x * b.y - b.x * a.y
            dx, dy = b.x - a.x, b.y - a.y
            return F.struct(
                (t.a2 + cross).alias("a2"), (t.cx + (a.x + b.x) * cross).alias("cx"), (t.cy + (a.y + b.y) * cross).alias("cy"),
                (t.length + F.sqrt(dx * dx + dy * dy)).alias("length"), (t.sx + b.x).alias("sx"), (t.sy + b.y).alias("sy"),
            )

        def end(t: Column) -> Column:
            n = F.size(r) - 1
            return F.struct((F.abs(t.a2) / 2).alias("area"), t.length.alias("length"), F.coalesce(F.try_divide(t.cx, 3 * t.a2), t.sx / n).alias("x"), F.coalesce(F.try_divide(t.cy, 3 * t.a2), t.sy / n).alias("y"))

        return F.when(F.size(r) > 1, F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), zero, step, end))

    return let(ring, walk)


def area(ring: Column) -> Column:
    return measures(ring)["area"]


def length(ring: Column) -> Column:
    return measures(ring)["length"]


def bounds(ring: Column) -> Column:
    over = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    return F.struct(over(F.array_min, "x").alias("x0"), over(F.array_min, "y").alias("y0"), over(F.array_max, "x").alias("x1"), over(F.array_max, "y").alias("y1"))


def shape_complexity(area_: Column, perimeter: Column) -> Column:
    """P squared over A; infinite without area."""
    return F.when(area_ > 0, perimeter * perimeter / area_).otherwise(F.lit(float("inf")))


def compactness(area_: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, 4 * math.pi * area_ / (perimeter * perimeter)).otherwise(0.0)


def segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """(d, x, y): distance from a point to a segment, and the nearest point on it."""
    dx, dy = x1 - x0, y1 - y0
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - x0) * dx + (py - y0) * dy, dx * dx + dy * dy), F.lit(0.0))))
    x, y = x0 + t * dx, y0 + t * dy
    return F.struct(F.sqrt((px - x) * (px - x) + (py - y) * (py - y)).alias("d"), x.alias("x"), y.alias("y"))


def clipped_length(x0: Column, y0: Column, x1: Column, y1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Length of a segment inside a box: the parameters of the four half planes bound the part that stays."""
    dx, dy = x1 - x0, y1 - y0

    def span(p0: Column, d: Column, low: Column, high: Column) -> tuple[Column, Column]:
        a, b = F.try_divide(low - p0, d), F.try_divide(high - p0, d)
        inside = (p0 >= low) & (p0 <= high)
        return F.when(d == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(a, b)), F.when(d == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(a, b))

    ax, bx = span(x0, dx, bx0, bx1)
    ay, by = span(y0, dy, by0, by1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), bx, by) - F.greatest(F.lit(0.0), ax, ay)) * F.sqrt(dx * dx + dy * dy)


def overlap_area(a: list[Column], b: list[Column]) -> Column:
    """Common area of two boxes (x0, y0, x1, y1)."""
    side = lambda i, j: F.greatest(F.lit(0.0), F.least(a[j], b[j]) - F.greatest(a[i], b[i]))
    return side(0, 2) * side(1, 3)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def ring_from_points(points: Column) -> Column:
    """Points sorted by their angle around the mean and closed: right for star-shaped outlines."""

    def sorted_ring(p: Column, centre: Column) -> Column:
        turned = F.sort_array(F.transform(p, lambda q: F.struct(F.atan2(q.y - centre.y, q.x - centre.x).alias("angle"), q.x.alias("x"), q.y.alias("y"))))
        return let(F.transform(turned, lambda q: F.struct(q.x.alias("x"), q.y.alias("y"))), lambda r: F.concat(r, F.slice(r, 1, 1)))

    mean = lambda p: F.struct(*[(F.aggregate(p, F.lit(0.0), lambda t, q: t + q[k]) / F.size(p)).alias(k) for k in ("x", "y")])  # noqa: B023, E731
    return let(points, lambda p: let(mean(p), lambda centre: sorted_ring(p, centre)))
