"""Planar overlay as joins: noding, faces, valid shapes, intersections and unions. No shape, and no pair of shapes, meets in one task.

A shape is an array of rings and inside by the even-odd rule: parts, holes and rings that cross themselves alike. Two shapes under one ``shape_id`` are owners 0 and 1.

1. ``noded``: edges meet by the square buckets they pass through, are cut where they cross, touch or run along each other, and equal pieces become one with the
   parity of each owner. Coordinates are held to ``DIGITS`` digits, so a place found from two edges is one node.
2. ``sided``: which owners lie left and right of each piece: a ray from its middle counts pieces of its height band, and the piece itself separates.
3. ``boundary``: pieces that have a region on one side only, directed with the region on their left; its area is a sum over them, without tracing.
4. ``traced``: pieces meet end to start, at a node the first one clockwise from where they came, so parts that touch at a point stay apart. Chains, and pointer
   doubling over them, name rings and places, as for cell outlines.

Bucket and band sizes follow each shape's mean piece, so there are about as many rows as pieces, however long single ones are. Shapes of few edges need neither: their
edges are dealt by shape once, and a task nodes many shapes at a time and finds the sides of their pieces (``noding``); both ways use the same arithmetic.

Edge cases: points without finite coordinates are left out, open rings are closed; null, empty and flat shapes (points, lines) have no pieces: no rings, area 0. Edges covered twice cancel.
A crossing is rounded by half a unit of the last digit; pieces shorter than that vanish.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from terrainframe.operators import noding
from terrainframe.operators.noding import SLANT
from terrainframe.operators.outlines import gathered, ring_places
from terrainframe.tables import dealt, shuffle_parts, shuffled, written

DIGITS = 9
#: Shapes of at most so many edges, and of so many pieces, are worked on within a task; the others by buckets and bands. So the pairs looked at grow with the edges alone.
FEW_EDGES, FEW_PIECES = 128, 512
#: Borders of at most so many pieces are traced within a task, others by squares of a hundred mean pieces.
RING_PIECES = 100_000
ENDS = ("x0", "y0", "x1", "y1")
Region = Callable[[Column, Column], Column]
#: Regions of two owners.
REGIONS: dict[str, Region] = {
    "intersection": lambda a, b: a & b, "union": lambda a, b: a | b, "difference": lambda a, b: a & ~b, "symmetric_difference": lambda a, b: a != b,
}


def snapped(value: Column, digits: int = DIGITS) -> Column:
    return F.rint(value * float(10**digits)) / float(10**digits) + 0.0


def shape_edges(shapes: DataFrame, rings: str = "rings", owner: int = 0, digits: int = DIGITS) -> DataFrame:
    """shape_id, owner and ends of the edges of ``(shape_id, rings)``."""
    finite = lambda p: p.isNotNull() & F.coalesce(F.abs(p.x) < float("inf"), F.lit(False)) & F.coalesce(F.abs(p.y) < float("inf"), F.lit(False))
    usable = shapes.select("shape_id", F.explode(rings).alias("r")).where("r IS NOT NULL").select("shape_id", F.filter("r", finite).alias("r")).where(F.size("r") > 2)
    closed = usable.select("shape_id", F.concat("r", F.slice("r", 1, 1)).alias("r"))
    pairs = F.explode(F.transform(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.struct(F.get("r", i - 1).alias("p"), F.get("r", i).alias("q")))).alias("e")
    at = lambda end, axis: snapped(F.col(f"e.{end}.{axis}").cast("double"), digits)
    ends = [at(end, axis).alias(name) for name, end, axis in zip(ENDS, "ppqq", "xyxy", strict=True)]
    return closed.select("shape_id", pairs).select("shape_id", F.lit(owner).alias("owner"), *ends).where("x0 <> x1 OR y0 <> y1")


def buckets(edges: DataFrame) -> DataFrame:
    """A row for each bucket (bx, by) that an edge passes through; a bucket is twice the shape's mean edge wide."""
    c = F.col
    sizes = edges.groupBy("shape_id").agg((2 * F.avg(F.greatest(F.abs(c("x1") - c("x0")), F.abs(c("y1") - c("y0"))))).alias("size"))
    slack = 1e-6 * c("size")
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = edges.join(sizes, "shape_id").withColumn("by", F.explode(F.sequence(F.floor((low - slack) / c("size")), F.floor((high + slack) / c("size")))))
    x_at = lambda y: F.when(c("y0") == c("y1"), c("x0")).otherwise(c("x0") + (y - c("y0")) / (c("y1") - c("y0")) * (c("x1") - c("x0")))
    top = F.greatest(low, F.least(high, (c("by") + 1) * c("size") + slack))
    bottom = F.least(high, F.greatest(low, c("by") * c("size") - slack))
    flat = c("y0") == c("y1")
    a, b = F.when(flat, c("x0")).otherwise(x_at(bottom)), F.when(flat, c("x1")).otherwise(x_at(top))
    return rows.withColumn("bx", F.explode(F.sequence(F.floor((F.least(a, b) - slack) / c("size")), F.floor((F.greatest(a, b) + slack) / c("size"))))).drop("size")


def _off(p: str, q: str, at: tuple[str, str]) -> Column:
    """Distance of the point ``at`` (two columns) to the segment of ``p`` to ``q``."""
    c = F.col
    dx, dy = c(f"{q}.x1") - c(f"{p}.x0"), c(f"{q}.y1") - c(f"{p}.y0")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((c(at[0]) - c(f"{p}.x0")) * dx + (c(at[1]) - c(f"{p}.y0")) * dy) / (dx * dx + dy * dy)))
    ex, ey = c(at[0]) - c(f"{p}.x0") - t * dx, c(at[1]) - c(f"{p}.y0") - t * dy
    return F.sqrt(ex * ex + ey * ey)


def _parted(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of shapes with at most ``most`` of them, and those of the others, if there are any."""
    large = written(rows.groupBy("shape_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("shape_id"), "large-shapes")
    return (rows, None) if large.isEmpty() else (rows.join(large, "shape_id", "left_anti"), rows.join(large, "shape_id", "left_semi"))


def _places(met: DataFrame, keep: list[str], digits: int) -> DataFrame:
    """``keep``, of_a, x, y: the places inside edge a (of_a) or b of each row where they cross, touch or end.

    Boxes are compared first, and all is plain arithmetic that Spark compiles: functions over arrays are interpreted.
    """
    c = F.col
    near = 2.0 * 10**-digits
    low, high = lambda e, k: F.least(c(f"{e}.{k}0"), c(f"{e}.{k}1")), lambda e, k: F.greatest(c(f"{e}.{k}0"), c(f"{e}.{k}1"))
    apart = [(low(p, k) > high(q, k) + near) for k in "xy" for p, q in ("ab", "ba")]
    met = met.where(~reduce(lambda p, q: p | q, apart))
    dx, dy, ex, ey = c("a.x1") - c("a.x0"), c("a.y1") - c("a.y0"), c("b.x1") - c("b.x0"), c("b.y1") - c("b.y0")
    wx, wy = c("b.x0") - c("a.x0"), c("b.y0") - c("a.y0")
    cross = dx * ey - dy * ex
    t, u = F.try_divide(wx * ey - wy * ex, cross), F.try_divide(wx * dy - wy * dx, cross)
    ends = [(p, q, x, y) for p, q in ("ab", "ba") for x, y in (ENDS[:2], ENDS[2:])]
    on = {f"_on{k}": _off(p, p, (f"{q}.{x}", f"{q}.{y}")) <= near for k, (p, q, x, y) in enumerate(ends)}
    told = met.select(*[c(k) for k in keep], "a", "b", t.alias("_t"), u.alias("_u"), *[v.alias(k) for k, v in on.items()])
    place = lambda of_a, when, x, y: F.struct(F.lit(of_a).alias("of_a"), F.when(when, x).alias("x"), F.when(when, y).alias("y"))
    inner = (c("_t") > 0) & (c("_t") < 1) & (c("_u") > 0) & (c("_u") < 1) & ~reduce(lambda p, q: p | q, map(c, on))
    at = snapped(c("a.x0") + c("_t") * dx, digits), snapped(c("a.y0") + c("_t") * dy, digits)
    found = [place(p == "a", c(f"_on{k}"), c(f"{q}.{x}"), c(f"{q}.{y}")) for k, (p, q, x, y) in enumerate(ends)] + [place(of_a, inner, *at) for of_a in (True, False)]
    return told.select(*keep, "a", "b", F.inline(F.array(*found))).where(c("x").isNotNull())


def cuts(edges: DataFrame, digits: int = DIGITS, between: bool = False) -> DataFrame:
    """shape_id, e, cuts: the places inside edges (with their id e) where others cross, touch or end; with ``between`` only those of owner 0 and owner 1 with each other."""
    c = F.col
    fields = F.struct("e", "owner", *ENDS)
    rows = dealt(buckets(edges).select("shape_id", "bx", "by", fields.alias("s")), "shape_id", "bx", "by")
    once = (c("a.owner") == 0) & (c("b.owner") == 1) if between else c("a.e") < c("b.e")
    met = rows.withColumnRenamed("s", "a").join(rows.withColumnRenamed("s", "b"), ["shape_id", "bx", "by"]).where(once)
    each = _places(met, ["shape_id"], digits).select("shape_id", F.when(c("of_a"), c("a.e")).otherwise(c("b.e")).alias("e"), F.struct("x", "y").alias("at"))
    return each.groupBy("shape_id", "e").agg(F.collect_set("at").alias("cuts"))


def _within(rows: DataFrame, work: Callable[[noding.Columns], noding.Columns], names: dict[str, str]) -> DataFrame:
    """``work`` of ``noding`` on shapes of few rows, dealt by shape: shape_id and columns of ``names``, with their types."""
    schema = T.StructType([rows.schema["shape_id"], *T.StructType.fromDDL(", ".join(f"{k} {kind}" for k, kind in names.items()))])
    held = rows.repartition(shuffle_parts(rows), "shape_id").sortWithinPartitions("shape_id")
    return held.mapInArrow(noding.by_shape(work, to_arrow_schema(schema)), schema)


def way() -> Column:
    """An edge's first end, its ``cuts`` in order and its last end."""
    c = F.col
    dx, dy = c("x1") - c("x0"), c("y1") - c("y0")
    ranked = F.transform(F.coalesce("cuts", F.array().cast("array<struct<x:double,y:double>>")), lambda p: F.struct(((p.x - c("x0")) * dx + (p.y - c("y0")) * dy).alias("t"), p.x.alias("x"), p.y.alias("y")))
    inner = F.transform(F.array_sort(ranked), lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))
    end = lambda x, y: F.array(F.struct(c(x).alias("x"), c(y).alias("y")))
    bare = F.coalesce(F.size("cuts"), F.lit(0)) == 0
    return F.when(bare, F.concat(end("x0", "y0"), end("x1", "y1"))).otherwise(F.concat(end("x0", "y0"), inner, end("x1", "y1")))


#: Columns of pieces, and what a ray from a piece tells.
PIECE = {**dict.fromkeys(ENDS, "double"), "a": "int", "b": "int", "n": "long", "net": "long"}
RAY = {"rising": "boolean", "na": "long", "nb": "long", "w": "long"}


def noded(edges: DataFrame, digits: int = DIGITS, all_pieces: bool = False, rays: bool = False) -> DataFrame:
    """shape_id, ends (the lesser first), a, b, n, net: pieces that cross no other, with each owner's parity, the number of edges on them and that of edges along them less that of
    edges against them. Pieces even for both owners are gone, unless ``all_pieces``. With ``rays`` also what ``rayed`` adds, without another exchange for shapes of few edges."""
    small, large = _parted(written(edges, "shape-edges"), FEW_EDGES)
    work = (lambda rows: noding.rays(noding.pieces(rows, digits))) if rays else (lambda rows: noding.pieces(rows, digits))
    found = _within(small.select("shape_id", "owner", *ENDS), work, PIECE | RAY if rays else PIECE)
    if large is not None:
        far = _noded_by_buckets(large, digits)
        found = found.unionByName(_right_by_bands(_heights(far)) if rays else far)
    return found if all_pieces else found.where("a + b > 0")


def _noded_by_buckets(edges: DataFrame, digits: int) -> DataFrame:
    """``noded`` for shapes of many edges."""
    c = F.col
    own = written(edges.withColumn("e", F.monotonically_increasing_id()), "large-edges")
    walk = own.join(cuts(own, digits), ["shape_id", "e"], "left").select("shape_id", "owner", way().alias("w"))
    one = F.array(F.struct(F.get("w", F.lit(0)).alias("p"), F.get("w", F.lit(1)).alias("q")))
    steps = F.when(F.size("w") == 2, one).otherwise(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.get("w", i - 1).alias("p"), F.get("w", i).alias("q"))))
    pieces = walk.select("shape_id", "owner", F.inline(steps)).where("p <> q")
    parity = lambda k: (F.count_if(c("owner") == k) % 2).cast("int")
    low, high = F.least("p", "q"), F.greatest("p", "q")
    named = pieces.select("shape_id", "owner", F.when(c("p") < c("q"), 1).otherwise(-1).alias("way"), low.x.alias("x0"), low.y.alias("y0"), high.x.alias("x1"), high.y.alias("y1"))
    return named.groupBy("shape_id", *ENDS).agg(parity(0).alias("a"), parity(1).alias("b"), F.count("*").alias("n"), F.sum("way").alias("net"))


def _heights(pieces: DataFrame) -> DataFrame:
    own = pieces.withColumns({"h0": F.col("y0") + SLANT * F.col("x0"), "h1": F.col("y1") + SLANT * F.col("x1"), "id": F.monotonically_increasing_id()})
    return written(own, "pieces")


def rayed(pieces: DataFrame) -> DataFrame:
    """``pieces`` with rising, and sums over the other pieces that a slanted ray from just right of its middle meets: na and nb of their parities, w of their net ways upwards."""
    if "rising" in pieces.columns:
        return pieces
    small, large = _parted(written(pieces, "pieces"), FEW_PIECES)
    found = _within(small.select("shape_id", *PIECE), noding.rays, PIECE | RAY)
    return found if large is None else found.unionByName(_right_by_bands(_heights(large.select("shape_id", *PIECE))))


def _right_by_bands(own: DataFrame) -> DataFrame:
    """``rayed`` for shapes of many pieces: they meet by bands of heights."""
    c = F.col
    own = own.join(own.groupBy("shape_id").agg((2 * F.avg(F.abs(c("h1") - c("h0")))).alias("size")).where("size > 0"), "shape_id")
    low, high = F.least("h0", "h1"), F.greatest("h0", "h1")
    bars = own.withColumn("band", F.explode(F.sequence(F.floor(low / c("size")), F.floor(high / c("size"))))).select("shape_id", "band", c("id").alias("other"), *[c(k).alias(f"o{k}") for k in ("x0", "x1", "h0", "h1", "a", "b", "net")])
    mx, mh = (c("x0") + c("x1")) / 2, (c("h0") + c("h1")) / 2
    probes = own.select("shape_id", "id", mx.alias("mx"), mh.alias("mh"), F.floor(mh / c("size")).alias("band"))
    met = probes.join(bars, ["shape_id", "band"]).where((c("id") != c("other")) & (F.least("oh0", "oh1") <= c("mh")) & (c("mh") < F.greatest("oh0", "oh1")))
    right = met.where(c("ox0") + (c("mh") - c("oh0")) / (c("oh1") - c("oh0")) * (c("ox1") - c("ox0")) > c("mx"))
    weights = {"na": c("oa"), "nb": c("ob"), "w": F.when(c("oh1") > c("oh0"), c("onet")).otherwise(-c("onet"))}
    counts = right.groupBy("id").agg(*[F.sum(w).alias(k) for k, w in weights.items()])
    told = own.join(counts, "id", "left").withColumn("rising", c("h1") > c("h0"))
    return told.select("shape_id", *PIECE, "rising", *[F.coalesce(k, F.lit(0)).alias(k) for k in weights])


def sided(pieces: DataFrame) -> DataFrame:
    """``pieces`` with la, lb, ra, rb: whether the owners lie left and right of the way from its first end to its last, by the even-odd rule."""
    c = F.col
    left = lambda k: (c(f"n{k}") + c("rising").cast("long") * c(k)) % 2 == 1  # noqa: E731  a ray from left of a rising piece meets the piece itself
    out = rayed(pieces).select("shape_id", *ENDS, "a", "b", left("a").alias("la"), left("b").alias("lb"))
    return out.withColumns({"ra": c("la") != (c("a") == 1), "rb": c("lb") != (c("b") == 1)})


def wound(pieces: DataFrame) -> DataFrame:
    """``pieces`` (all of them) with la, ra: whether any ring winds around what lies left and right of them; lb and rb are false. So counter-clockwise rings make their union."""
    c = F.col
    upper = c("w") + F.when(c("rising"), c("net")).otherwise(-c("net"))  # on the side the ray comes from through the piece
    la, ra = F.when(c("rising"), upper).otherwise(c("w")) != 0, F.when(c("rising"), c("w")).otherwise(upper) != 0
    return rayed(pieces.where("net <> 0")).select("shape_id", *ENDS, "a", "b", la.alias("la"), F.lit(False).alias("lb"), ra.alias("ra"), F.lit(False).alias("rb"))


def boundary(sides: DataFrame, region: Region = lambda a, b: a) -> DataFrame:
    """shape_id and ends of the pieces that border a region, the region on their left."""
    c = F.col
    kept = sides.withColumns({"_l": region(c("la"), c("lb")), "_r": region(c("ra"), c("rb"))}).where("_l <> _r")
    back = dict(zip(ENDS, (*ENDS[2:], *ENDS[:2]), strict=True))
    return kept.select("shape_id", *[F.when(c("_l"), c(k)).otherwise(c(back[k])).alias(k) for k in ENDS])


def measures(border: DataFrame) -> DataFrame:
    """shape_id, area, cx, cy (the centroid): from the pieces alone."""
    c = F.col
    first = border.groupBy("shape_id").agg(F.min("x0").alias("ox"), F.min("y0").alias("oy"))
    near = border.join(first, "shape_id")  # turns around a near point keep their digits
    x0, y0, x1, y1 = c("x0") - c("ox"), c("y0") - c("oy"), c("x1") - c("ox"), c("y1") - c("oy")
    cross = x0 * y1 - x1 * y0
    sums = near.groupBy("shape_id").agg(F.first("ox").alias("ox"), F.first("oy").alias("oy"), F.sum(cross).alias("a2"), F.sum((x0 + x1) * cross).alias("sx"), F.sum((y0 + y1) * cross).alias("sy"))
    return sums.select("shape_id", (c("a2") / 2).alias("area"), (c("ox") + F.try_divide(c("sx"), 3 * c("a2"))).alias("cx"), (c("oy") + F.try_divide(c("sy"), 3 * c("a2"))).alias("cy"))


def areas(border: DataFrame) -> DataFrame:
    return measures(border).select("shape_id", "area")


def traced(border: DataFrame) -> DataFrame:
    """shape_id, rings (closed, by falling area; holes, clockwise, last), n_outer, n_holes, n_corners, area. Points where the only way goes straight on are left out."""
    c = F.col
    own = written(border.withColumn("edge", F.monotonically_increasing_id()), "border")
    small, large = _parted(own, RING_PIECES)
    steps = _followed(small.repartition(shuffle_parts(own), "shape_id")).sortWithinPartitions("pour_id")
    if large is not None:
        sizes = shuffled(large.groupBy("shape_id").agg((100 * F.avg(F.greatest(F.abs(c("x1") - c("x0")), F.abs(c("y1") - c("y0"))))).alias("size")))
        square = ["pour_id", F.floor(c("x") / c("size")).alias("_x"), F.floor(c("y") / c("size")).alias("_y")]
        far = _followed(large).join(sizes.withColumnRenamed("shape_id", "pour_id"), "pour_id").select("*", *square[1:]).drop("size")
        steps = steps.unionByName(far.repartition(shuffle_parts(own), "pour_id", "_x", "_y").sortWithinPartitions("pour_id", "_x", "_y").drop("_x", "_y"))
    corners = ring_places(steps).where("bend")
    return gathered(corners.select("pour_id", "ring", F.struct("place", "x", "y").alias("p"))).withColumnRenamed("pour_id", "shape_id")


def _followed(own: DataFrame) -> DataFrame:
    """pour_id (the shape's), edge, next, bend, x, y (the edge's end) of directed pieces: the way on at a node."""
    c = F.col
    angle = F.atan2(c("y1") - c("y0"), c("x1") - c("x0"))
    behind = F.atan2(c("y0") - c("y1"), c("x0") - c("x1"))
    none = F.lit(None)
    start = F.struct(c("x0").alias("x"), c("y0").alias("y"), angle.alias("at"), F.struct("edge", angle.alias("at")).alias("out"), none.cast("long").alias("in"))
    end = F.struct(c("x1").alias("x"), c("y1").alias("y"), behind.alias("at"), none.cast("struct<edge:bigint,at:double>").alias("out"), c("edge").alias("in"))
    node = Window.partitionBy("shape_id", "x", "y").orderBy("at")
    before, whole = node.rowsBetween(Window.unboundedPreceding, -1), node.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = F.coalesce(F.last("out", ignorenulls=True).over(before), F.last("out", ignorenulls=True).over(whole))
    met = own.select("shape_id", F.inline(F.array(start, end))).withColumns({"next": follow, "ways": F.count("out").over(whole)}).where(c("in").isNotNull())
    bend = (F.abs(F.sin(c("next.at") - c("at"))) > 1e-9) | (c("ways") > 1)
    return met.select(c("shape_id").alias("pour_id"), c("in").alias("edge"), c("next.edge").alias("next"), bend.alias("bend"), "x", "y")


def _whole(shapes: DataFrame, found: DataFrame) -> DataFrame:
    """Every shape once: those without a result have no rings and area 0."""
    kind = "array<array<struct<x:double,y:double>>>"
    joined = shapes.select("shape_id").join(found, "shape_id", "left")
    return joined.select("shape_id", F.coalesce("rings", F.array().cast(kind)).alias("rings"), *[F.coalesce(k, F.lit(0)).alias(k) for k in ("n_outer", "n_holes", "n_corners")], F.coalesce("area", F.lit(0.0)).alias("area"))


def once_each(shapes: DataFrame, columns: list[str], found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``found`` of ``(shape_id, *columns)``, where it hangs on the columns alone: equal shapes are worked on once, and each row takes its shape's result."""
    forms = written(shapes.groupBy(*columns).agg(F.min("shape_id").alias("shape_id")), "forms")
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"f.{k}")) for k in columns])
    of = shapes.alias("s").join(forms.alias("f"), same).select(F.col("s.shape_id").alias("shape_id"), F.col("f.shape_id").alias("_form"))
    return of.join(shuffled(found(forms).withColumnRenamed("shape_id", "_form")), "_form").drop("_form")


def make_valid(shapes: DataFrame, digits: int = DIGITS) -> DataFrame:
    """The faces of ``(shape_id, rings)`` by the even-odd rule as rings that cross nothing: shape_id, rings, n_outer, n_holes, n_corners, area, outcome.

    outcome: unchanged if no edge was cut, dropped or added; removed if nothing with an area is left; else repaired.
    """
    return once_each(shapes.select("shape_id", "rings"), ["rings"], lambda forms: _make_valid(forms, digits))


def _make_valid(shapes: DataFrame, digits: int) -> DataFrame:
    c = F.col
    edges = shape_edges(shapes, digits=digits)
    pieces = written(noded(edges, digits, all_pieces=True, rays=True), "noded")
    valid = _whole(shapes, traced(boundary(sided(pieces.where("a > 0")))))
    closed = lambda r: (F.size(r) > 3) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1))
    sound = F.forall(c("rings"), lambda r: F.coalesce(closed(r) & F.forall(r, lambda p: (F.abs(p.x) < float("inf")) & (F.abs(p.y) < float("inf"))), F.lit(False)))
    given = shapes.select("shape_id", F.coalesce(sound, F.lit(False)).alias("sound"), F.aggregate(F.coalesce("rings", F.array()), F.lit(0).cast("long"), lambda t, r: t + F.greatest(F.coalesce(F.size(r), F.lit(0)) - 1, F.lit(0))).alias("n_given"))
    counts = pieces.groupBy("shape_id").agg(F.count("*").alias("n_pieces"), F.max("n").alias("n_most"))
    told = valid.join(given, "shape_id").join(counts, "shape_id", "left")
    outcome = F.when(c("area") == 0, "removed").when(c("sound") & (c("n_given") == c("n_pieces")) & (c("n_most") == 1), "unchanged").otherwise("repaired")
    return told.withColumn("outcome", outcome).drop("sound", "n_given", "n_pieces", "n_most")


def capsule_edges(lines: DataFrame, radius: float, arcs: int = 16, owner: int = 0, digits: int = DIGITS) -> DataFrame:
    """shape_id, owner and ends of the edges of a counter-clockwise ring around each line ``(shape_id, x0, y0, x1, y1)``, at ``radius`` with half circles of ``arcs`` / 2 edges at its ends;
    around a point a circle. A row an edge, by compiled arithmetic; lines are dealt first, as few rows become many. Of a line with one finite end only that end's half is left."""
    c, half = F.col, arcs // 2
    finite = lambda *names: reduce(lambda p, q: p & q, [F.coalesce(F.abs(c(k)) < float("inf"), F.lit(False)) for k in names])
    told = lines.select("shape_id", *ENDS).repartition(shuffle_parts(lines)).select("shape_id", *ENDS, F.atan2(c("y1") - c("y0"), c("x1") - c("x0")).alias("turn"), finite("x0", "y0").alias("_from"), finite("x1", "y1").alias("_to"))
    steps = told.select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * half + 1))).alias("k"))
    onward = F.when((c("k") == half) & ~c("_from"), 0).when(c("k") < 2 * half + 1, c("k") + 1).when(c("_to"), 0).otherwise(half + 1)
    known = steps.where(F.when(c("k") <= half, c("_to")).otherwise(c("_from"))).withColumn("onward", onward)

    def place(k: Column) -> tuple[Column, Column]:
        last = k <= half
        angle = c("turn") + F.when(last, -math.pi / 2).otherwise(math.pi / 2) + F.when(last, k).otherwise(k - (half + 1)) * (math.pi / half)
        return tuple(snapped(F.when(last, c(f"{axis}1")).otherwise(c(f"{axis}0")) + radius * way(angle), digits) for axis, way in (("x", F.cos), ("y", F.sin)))

    ends = [v.alias(name) for name, v in zip(ENDS, (*place(c("k")), *place(c("onward"))), strict=True)]
    return known.select("shape_id", F.lit(owner).alias("owner"), *ends).where("x0 <> x1 OR y0 <> y1")


def buffered(shapes: DataFrame | None, lines: DataFrame | None, radius: float, arcs: int = 16, digits: int = DIGITS) -> DataFrame:
    """All within ``radius`` of shapes ``(shape_id, rings)``, lines ``(shape_id, x0, y0, x1, y1)`` (a point's ends are one place) or both, as shapes with round corners of ``arcs`` edges a turn.

    The union of the shape's faces with a capsule around each of its border's pieces and each line: a ring that winds around a place holds it. A radius of 0 gives the faces.
    """
    if radius < 0 or arcs % 4:
        raise ValueError("the radius is 0 at least, the edges of a turn a multiple of 4")
    parts, keys = [], []
    if shapes is not None:
        border = written(boundary(sided(noded(shape_edges(shapes.repartition(shuffle_parts(shapes)), digits=digits), digits, rays=True))), "buffered-border")
        parts.append(border.select("shape_id", F.lit(0).alias("owner"), *ENDS))
        lines = border if lines is None else border.unionByName(lines.select("shape_id", *ENDS))
        keys.append(shapes.select("shape_id"))
    else:
        keys.append(lines.select("shape_id"))
    if radius > 0:
        parts.append(capsule_edges(lines, radius, arcs, digits=digits))
    found = traced(boundary(wound(noded(reduce(DataFrame.unionByName, parts), digits, all_pieces=True, rays=True))))
    return _whole(reduce(DataFrame.unionByName, keys).distinct(), found)


def pair_sides(pairs: DataFrame, a: str = "a", b: str = "b", digits: int = DIGITS) -> DataFrame:
    """The sided pieces of ``(shape_id, a, b)``, two shapes a row; written, as each region reads them."""
    edges = shape_edges(pairs, a, 0, digits).unionByName(shape_edges(pairs, b, 1, digits))
    return written(sided(noded(edges, digits, rays=True)), "pair-sides")


def overlay(pairs: DataFrame, region: str, a: str = "a", b: str = "b", digits: int = DIGITS) -> DataFrame:
    """The region of each pair of shapes ``(shape_id, a, b)`` as a shape: shape_id, rings, n_outer, n_holes, n_corners, area."""
    return once_each(pairs.select("shape_id", a, b), [a, b], lambda forms: _whole(forms, traced(boundary(pair_sides(forms, a, b, digits), REGIONS[region]))))


def iou(pairs: DataFrame, a: str = "predicted", b: str = "truth", digits: int = DIGITS) -> DataFrame:
    """shape_id, area_a, area_b, common, iou, status of shapes made valid by the even-odd rule. A shape without area gives a null iou and why; shapes that only touch give 0."""
    c = F.col
    edges = shape_edges(pairs, a, 0, digits).unionByName(shape_edges(pairs, b, 1, digits))
    shape = Window.partitionBy("shape_id")
    near = sided(noded(edges, digits, rays=True)).withColumns({"ox": F.min("x0").over(shape), "oy": F.min("y0").over(shape)})  # turns around a near point keep their digits
    cross = (c("x0") - c("ox")) * (c("y1") - c("oy")) - (c("x1") - c("ox")) * (c("y0") - c("oy"))
    regions = {"area_a": lambda p, q: p, "area_b": lambda p, q: q, "common": REGIONS["intersection"]}
    left, right = ({k: f(c(f"{side}a"), c(f"{side}b")) for k, f in regions.items()} for side in "lr")
    sums = near.groupBy("shape_id").agg(*[(F.sum(F.when(left[k] & ~right[k], cross).when(right[k] & ~left[k], -cross)) / 2).alias(k) for k in regions])
    zero = lambda k: F.coalesce(c(k), F.lit(0.0))
    out = pairs.select("shape_id").join(shuffled(sums), "shape_id", "left").select("shape_id", *[zero(k).alias(k) for k in regions])
    status = F.when(c("area_a") <= 0, "predicted_no_area").when(c("area_b") <= 0, "truth_no_area").otherwise("valid")
    return out.withColumns({"status": status, "iou": F.when(status == "valid", c("common") / (c("area_a") + c("area_b") - c("common")))})
