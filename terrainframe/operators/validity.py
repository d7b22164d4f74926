"""Faults of polygons with their places, over the pieces of ``overlay``: no shape is examined in one task.

A shape's first ring is its shell, the others are its holes (parts are shapes of their own). Rules, the first that fires names the shape:

- not_finite, too_few_points, not_closed: a ring's points as they are given.
- self_crossing, rings_cross: two edges of one ring, or of two, cross inside both; repeated_edge: a piece is covered more than once.
- hole_outside, hole_nested: a hole lies in no other ring, or in two or more, by its first edge's middle.
- no_area: nothing is left.

The place of a fault is the least (x, y) of those of its kind; point faults have the ring's number instead. Shapes that touch themselves at single points are valid.
Null and empty shapes have the fault empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrainframe.operators import overlay
from terrainframe.tables import written

RULES = ("empty", "not_finite", "too_few_points", "not_closed", "self_crossing", "rings_cross", "repeated_edge", "hole_outside", "hole_nested", "no_area")


def point_faults(shapes: DataFrame) -> DataFrame:
    """shape_id, rule, ring: what single points tell."""
    rings = shapes.select("shape_id", F.posexplode_outer("rings").alias("ring", "r"))
    finite = F.forall("r", lambda p: F.coalesce((F.abs(p.x) < float("inf")) & (F.abs(p.y) < float("inf")), F.lit(False)))
    closed = F.get("r", F.lit(0)) == F.get("r", F.size("r") - 1)
    rule = F.when(F.col("ring").isNull(), "empty").when(F.col("r").isNull() | (F.size("r") == 0), "too_few_points").when(~finite, "not_finite").when(F.size("r") < 4, "too_few_points").when(~closed, "not_closed")
    return rings.select("shape_id", rule.alias("rule"), "ring").where("rule IS NOT NULL")


def ring_edges(shapes: DataFrame) -> DataFrame:
    """shape_id, ring and ends of all edges, each with an id e."""
    rings = shapes.select("shape_id", F.posexplode("rings").alias("ring", "r"))
    named = rings.select(F.struct("shape_id", "ring").alias("shape_id"), F.array("r").alias("rings"))
    edges = overlay.shape_edges(named).select("shape_id.shape_id", F.col("shape_id.ring").alias("ring"), *overlay.ENDS)
    return written(edges.withColumn("e", F.monotonically_increasing_id()), "ring-edges")


def crossings(edges: DataFrame) -> DataFrame:
    """shape_id, rule, x, y: places where two edges cross inside both."""
    c = F.col
    met = overlay.buckets(edges).select("shape_id", "bx", "by", "e", "ring", *overlay.ENDS)
    a, b = met.alias("a"), met.alias("b")
    pairs = a.join(b, (c("a.shape_id") == c("b.shape_id")) & (c("a.bx") == c("b.bx")) & (c("a.by") == c("b.by")) & (c("a.e") < c("b.e")))
    dx, dy, ex, ey = c("a.x1") - c("a.x0"), c("a.y1") - c("a.y0"), c("b.x1") - c("b.x0"), c("b.y1") - c("b.y0")
    wx, wy = c("b.x0") - c("a.x0"), c("b.y0") - c("a.y0")
    cross = dx * ey - dy * ex
    t, u = F.try_divide(wx * ey - wy * ex, cross), F.try_divide(wx * dy - wy * dx, cross)
    inner = lambda v: (v > 1e-12) & (v < 1 - 1e-12)
    rule = F.when(c("a.ring") == c("b.ring"), "self_crossing").otherwise("rings_cross")
    place = [overlay.snapped(c("a.x0") + t * dx).alias("x"), overlay.snapped(c("a.y0") + t * dy).alias("y")]
    return pairs.where(inner(t) & inner(u)).select(c("a.shape_id").alias("shape_id"), rule.alias("rule"), *place)


def nesting(edges: DataFrame) -> DataFrame:
    """shape_id, rule, x, y: holes by the number of rings of their shape that they lie in."""
    c = F.col
    first = edges.groupBy("shape_id", "ring").agg(F.min(F.struct("e", *overlay.ENDS)).alias("m"))
    holes = first.where("ring > 0").select("shape_id", "ring", ((c("m.x0") + c("m.x1")) / 2).alias("px"), ((c("m.y0") + c("m.y1")) / 2).alias("py"))
    holes = written(holes.withColumn("point_id", F.monotonically_increasing_id()), "hole-points")
    low = F.when(c("y0") <= c("y1"), F.array(c("x0"), c("y0"), c("x1"), c("y1"))).otherwise(F.array(c("x1"), c("y1"), c("x0"), c("y0")))
    upright = edges.where("y0 <> y1").select("shape_id", c("ring").alias("other"), low.alias("k")).select("shape_id", "other", *[c("k")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    high = upright.groupBy("shape_id").agg((2 * F.avg(c("y1") - c("y0"))).alias("high"))
    bars = upright.join(high, "shape_id").withColumn("band", F.explode(F.sequence(F.floor(c("y0") / c("high")), F.floor(c("y1") / c("high"))))).drop("high")
    probes = holes.join(high, "shape_id").withColumn("band", F.floor(c("py") / c("high"))).drop("high")
    met = probes.join(bars, ["shape_id", "band"]).where((c("other") != c("ring")) & (c("py") >= c("y0")) & (c("py") < c("y1")) & (c("x0") + (c("py") - c("y0")) / (c("y1") - c("y0")) * (c("x1") - c("x0")) > c("px")))
    inside = met.groupBy("point_id", "other").agg(F.count("*").alias("n")).where("n % 2 = 1").groupBy("point_id").agg(F.count("*").alias("depth"))
    told = holes.join(inside, "point_id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    return told.where("depth <> 1").select("shape_id", F.when(c("depth") == 0, "hole_outside").otherwise("hole_nested").alias("rule"), c("px").alias("x"), c("py").alias("y"))


def faults(shapes: DataFrame) -> DataFrame:
    """shape_id, rule, n, ring, x, y of ``(shape_id, rings)``: each rule that a shape breaks, how often, and where first."""
    edges = ring_edges(shapes)
    pieces = overlay.noded(edges.select("shape_id", F.lit(0).alias("owner"), *overlay.ENDS), all_pieces=True)
    pieces = written(pieces, "validity-pieces")
    twice = pieces.where("n > 1").select("shape_id", F.lit("repeated_edge").alias("rule"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    flat = shapes.select("shape_id").join(pieces.where("a > 0").select("shape_id").distinct(), "shape_id", "left_anti").select("shape_id", F.lit("no_area").alias("rule"))
    none = lambda k: F.lit(None).cast("int" if k == "ring" else "double").alias(k)
    placed = crossings(edges).unionByName(twice).unionByName(nesting(edges)).select("shape_id", "rule", none("ring"), "x", "y")
    every = placed.unionByName(point_faults(shapes).select("shape_id", "rule", "ring", none("x"), none("y"))).unionByName(flat.select("shape_id", "rule", none("ring"), none("x"), none("y")))
    found = every.groupBy("shape_id", "rule").agg(F.count("*").alias("n"), F.min(F.struct("ring", "x", "y")).alias("first"))
    return found.select("shape_id", "rule", "n", "first.ring", "first.x", "first.y")


def validity(shapes: DataFrame) -> DataFrame:
    """shape_id, valid, rule (the first by ``RULES``, or null), x, y."""
    order = F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule"))
    first = faults(shapes).groupBy("shape_id").agg(F.min(F.struct(order.alias("order"), "rule", "x", "y")).alias("f"))
    return shapes.select("shape_id").join(first, "shape_id", "left").select("shape_id", F.col("f").isNull().alias("valid"), "f.rule", "f.x", "f.y")
