"""Predicates and measures of shapes with shapes, lines and points, over the pieces of ``overlay`` and over edges in bands: polygons with parts and holes, not boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrainframe.operators import joins, overlay, sweep
from terrainframe.tables import dealt, written

#: Shapes of at most so many points pass whole; others are spread by their edges.
FEW_POINTS = 256


def relate(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """shape_id, intersects, contains (a holds b), within, touches of ``(shape_id, a, b)``.

    Shapes are closed: they intersect if they share as much as a point, and touch if that is all on their borders. A shape without area intersects nothing.
    """
    return overlay.once_each(pairs.select("shape_id", a, b), [a, b], lambda forms: _relate(forms, a, b))


def _relate(pairs: DataFrame, a: str, b: str) -> DataFrame:
    c = F.col
    sides = overlay.pair_sides(pairs, a, b)
    both = overlay.REGIONS["intersection"](c("la"), c("lb")) | overlay.REGIONS["intersection"](c("ra"), c("rb"))
    only_a, only_b = (c("la") & ~c("lb")) | (c("ra") & ~c("rb")), (c("lb") & ~c("la")) | (c("rb") & ~c("ra"))
    found = sides.groupBy("shape_id").agg(F.max(both).alias("common"), F.max(only_a).alias("only_a"), F.max(only_b).alias("only_b"), F.max(c("a") == 1).alias("has_a"), F.max(c("b") == 1).alias("has_b"))
    ends = F.inline(F.array(*[F.struct(c(x).alias("x"), c(y).alias("y")) for x, y in (overlay.ENDS[:2], overlay.ENDS[2:])]))
    nodes = sides.select("shape_id", "a", "b", ends).groupBy("shape_id", "x", "y").agg(F.max("a").alias("na"), F.max("b").alias("nb"))
    met = nodes.where("na = 1 AND nb = 1").select("shape_id").distinct().withColumn("met", F.lit(True))
    told = pairs.select("shape_id").join(found, "shape_id", "left").join(met, "shape_id", "left")
    no = lambda k: F.coalesce(c(k), F.lit(False))
    whole = no("has_a") & no("has_b")
    return told.select(
        "shape_id", (no("common") | no("met")).alias("intersects"), (whole & no("common") & ~no("only_b")).alias("contains"),
        (whole & no("common") & ~no("only_a")).alias("within"), (no("met") & ~no("common")).alias("touches"),
    )


def shape_measures(zones: DataFrame) -> DataFrame:
    """zone_id, area, cx, cy of ``(zone_id, rings)``, by the even-odd rule."""
    shapes = zones.select(F.col("zone_id").alias("shape_id"), "rings")
    sides = overlay.sided(overlay.noded(overlay.shape_edges(shapes), rays=True))
    return overlay.measures(overlay.boundary(sides)).withColumnRenamed("shape_id", "zone_id")


def line_pieces(lines: DataFrame, zones: DataFrame) -> DataFrame:
    """point_id (a piece's), line_id, px, py (its middle), length: lines ``(line_id, x0, y0, x1, y1)`` cut at all edges of the zones."""
    c = F.col
    edges = overlay.shape_edges(zones.select(F.lit(0).alias("shape_id"), "rings"), owner=1).withColumn("line_id", F.lit(None).cast(lines.schema["line_id"].dataType))
    own = lines.where("x0 <> x1 OR y0 <> y1").select(F.lit(0).alias("shape_id"), F.lit(0).alias("owner"), *[overlay.snapped(c(k)).alias(k) for k in overlay.ENDS], "line_id")
    both = written(own.unionByName(edges).withColumn("e", F.monotonically_increasing_id()), "line-edges")
    cut = both.where("owner = 0").join(overlay.cuts(both, between=True), ["shape_id", "e"], "left").select("line_id", overlay.way().alias("w"))
    parts = F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.get("w", i - 1).alias("p"), F.get("w", i).alias("q")))).alias("s")
    dx, dy = c("s.q.x") - c("s.p.x"), c("s.q.y") - c("s.p.y")
    told = cut.select("line_id", parts).select("line_id", ((c("s.p.x") + c("s.q.x")) / 2).alias("px"), ((c("s.p.y") + c("s.q.y")) / 2).alias("py"), F.sqrt(dx * dx + dy * dy).alias("length"))
    return written(told.where("length > 0").withColumn("point_id", F.monotonically_increasing_id()), "line-pieces")


def lines_in_shapes(lines: DataFrame, zones: DataFrame) -> DataFrame:
    """zone_id, line_id, length: of each line ``(line_id, x0, y0, x1, y1)`` inside each zone ``(zone_id, rings)``, concave ones and holes included."""
    pieces = line_pieces(lines, zones)
    inside = joins.points_in_shapes(pieces.select("point_id", "px", "py"), zones).select("point_id", "zone_id")
    return inside.join(pieces, "point_id").groupBy("zone_id", "line_id").agg(F.sum("length").alias("length"))


def _parted(zones: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Zones of few points with their boxes (bx0 .. by1), and the others, if there are any."""
    n = F.aggregate(F.coalesce("rings", F.array()), F.lit(0).cast("long"), lambda t, r: t + F.greatest(F.coalesce(F.size(r), F.lit(0)), F.lit(0)))
    large = zones.where(n > FEW_POINTS)
    known = lambda p: F.coalesce((F.abs(p.x) < float("inf")) & (F.abs(p.y) < float("inf")), F.lit(False))
    points = F.filter(F.flatten(F.filter("rings", lambda r: r.isNotNull())), known)
    axis = {k: F.transform("_points", lambda p: p[k]) for k in "xy"}  # noqa: B023
    ends = [f(axis[k]).alias(f"b{k}{end}") for end, f in ((0, F.array_min), (1, F.array_max)) for k in "xy"]
    return zones.where(n <= FEW_POINTS).withColumn("_points", points).select(*zones.columns, *ends), None if large.isEmpty() else large


def stream_density(zones: DataFrame, lines: DataFrame) -> DataFrame:
    """zone_id, stream_km, area, density: length of lines inside each zone, and that over its area. A zone without area has no density."""
    c = F.col
    own = lines.where("x0 <> x1 OR y0 <> y1").select(*[overlay.snapped(c(k)).alias(name) for k, name in zip(overlay.ENDS, ("sx", "sy", "ex", "ey"), strict=True)])
    held = own.select("*", F.least("sx", "ex").alias("x0"), F.least("sy", "ey").alias("y0"), F.greatest("sx", "ex").alias("x1"), F.greatest("sy", "ey").alias("y1"))
    zones = written(zones.select("zone_id", "rings"), "zones")  # rings may be a long expression, and are read several times
    few, large = _parted(zones)
    found = sweep.swept(held, few, sweep.Lengths, {"zone_id": zones.schema["zone_id"].dataType.simpleString(), "km": "double"})
    if large is not None:
        found = found.unionByName(lines_in_shapes(lines, large).select("zone_id", c("length").alias("km")))
    inside = found.groupBy("zone_id").agg(F.sum("km").alias("km"))
    told = zones.select("zone_id").join(shape_measures(zones), "zone_id", "left").join(inside, "zone_id", "left")
    km, area = F.coalesce("km", F.lit(0.0)), F.coalesce("area", F.lit(0.0))
    return told.select("zone_id", km.alias("stream_km"), area.alias("area"), F.when(area > 0, km / area).alias("density"))


def _measured(zones: DataFrame) -> DataFrame:
    own = written(zones.select("zone_id", "rings"), "zones")
    return written(dealt(own, "zone_id").join(shape_measures(own), "zone_id"), "measured-zones")


def shape_candidates(points: DataFrame, zones: DataFrame, radius: float) -> DataFrame:
    """point_id, zone_id, holds, area, centre_distance: zones ``(zone_id, rings)`` that a disc around each point ``(point_id, px, py)`` meets."""
    return _candidates(points, _measured(zones), radius)


def _candidates(points: DataFrame, measured: DataFrame, radius: float) -> DataFrame:
    few, large = _parted(measured)
    kinds = sweep.kinds(points, measured) | {"holds": "boolean", "area": "double", "centre_distance": "double"}
    found = sweep.swept(sweep.at(points), sweep.reach(few, radius), lambda held: sweep.Candidates(held, radius), kinds)
    return found if large is None else found.unionByName(_spread_candidates(points, large, radius))


def shape_pick(points: DataFrame, zones: DataFrame, radius: float, digits: int) -> DataFrame:
    """point_id, zone_id, area, method: one of the ``shape_candidates`` a point, by the rules of ``joins.truth_pick``, without a row a candidate; areas and distances are rounded to ``digits``."""
    c = F.col
    few, large = _parted(_measured(zones).withColumn("area", F.round("area", digits)))
    parts = sweep.pick_parts(points, few, radius, digits)
    if large is not None:
        met = _spread_candidates(points, large, radius)
        far = F.when(c("holds"), -c("area")).otherwise(F.round("centre_distance", digits))
        parts = parts.unionByName(met.select("point_id", "zone_id", F.lit(1).cast("long").alias("n"), c("holds").cast("long").alias("n_hold"), "holds", far.alias("far"), "area"))
    return sweep.picked(parts)


def _spread_candidates(points: DataFrame, measured: DataFrame, radius: float) -> DataFrame:
    """``shape_candidates`` for shapes of many points, ``measured``: their edges meet the points one by one."""
    c = F.col
    zones = measured.select("zone_id", "rings")
    inside = joins.points_in_shapes(points, zones).select("point_id", "zone_id", F.lit(0.0).alias("d"))
    borders = overlay.shape_edges(zones.withColumnRenamed("zone_id", "shape_id")).select(c("shape_id").alias("line_id"), *overlay.ENDS)
    near = joins.near_lines(points, borders, radius).select("point_id", c("line_id").alias("zone_id"), c("near.d").alias("d"))
    met = inside.unionByName(near.withColumn("d", F.greatest("d", F.lit(5e-324)))).groupBy("point_id", "zone_id").agg((F.min("d") == 0).alias("holds"))
    told = met.join(points, "point_id").join(measured.drop("rings"), "zone_id")
    gap = F.sqrt((c("cx") - c("px")) * (c("cx") - c("px")) + (c("cy") - c("py")) * (c("cy") - c("py")))
    return told.select("point_id", "zone_id", "holds", "area", gap.alias("centre_distance"))
