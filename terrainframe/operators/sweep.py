"""Spatial joins whose pairs are never rows that travel: within a bucket one side is held and the other passes by, and only what a pair gives goes on.

Boxes meet as in ``joins.overlapping``, by buckets in levels. A bucket of over ``HELD`` held boxes is dealt into parts, and what passes goes to each of them, so a task holds
at most that many boxes and one batch, however many pairs there are. Shapes pass whole, as rings: their edges are worked out in the task, by columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from terrainframe.operators import joins
from terrainframe.operators.noding import spans
from terrainframe.tables import shuffle_parts, shuffled, written

HELD = 65_536
#: Held boxes of a mean bucket and buckets in all that widths aim at: a passing box is a step of its own in each bucket it touches.
MEAN, BUCKETS = 1000, 256
#: Edges by held rows that are looked at together, and rows of a batch that goes on.
LOOKED, ROWS = 500_000, 100_000
KEYS = ["_level", "_bx", "_by", "_kind"]
Columns = dict[str, np.ndarray]


def finite(*names: str):
    """Whether the columns are numbers."""
    found = F.lit(True)
    for k in names:
        found &= F.coalesce(F.abs(F.col(k)) < float("inf"), F.lit(False))
    return found


def swept(held: DataFrame, passing: DataFrame, work: Callable[[Columns], object], names: dict[str, str], order: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``names`` that ``work`` gives: from a bucket's columns of ``held`` (boxes x0 .. y1) it makes what has ``meet(columns, low, high, size)``, called for each row of
    ``passing`` (boxes bx0 .. by1) by rising ``order``, and ``end()``; both yield columns."""
    held, passing = held.where(finite("x0", "y0", "x1", "y1")), passing.where(finite("bx0", "by0", "bx1", "by1"))
    size, top = joins.levels(held, passing, _width(held, passing))
    left = joins._levelled(held, ("x0", "y0", "x1", "y1"), size, top, ([0, 1], [2])).drop("_size")
    right = joins._levelled(passing, ("bx0", "by0", "bx1", "by1"), size, top, ([0, 2], [1])).drop("_size")
    parts = written(left.groupBy(*KEYS).agg(F.ceil(F.count("*") / HELD).cast("int").alias("_parts")), "held-parts")
    part = F.lit(0).alias("_part")
    if not parts.where("_parts > 1").isEmpty():
        left, part = shuffled(left).join(parts, KEYS), F.pmod(F.xxhash64(*held.columns), "_parts").cast("int").alias("_part")
    left = left.select(*KEYS, part, F.lit(0).alias("_side"), F.struct(*held.columns).alias("_held"))
    right = shuffled(right).join(parts, KEYS).select(*KEYS, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(1).alias("_side"), F.struct(*passing.columns).alias("_passing"))
    keys = [*KEYS, "_part"]
    both = left.unionByName(right, allowMissingColumns=True).repartition(shuffle_parts(held), *keys)
    schema = T.StructType.fromDDL(", ".join(f"{k} {kind}" for k, kind in names.items()))
    return both.sortWithinPartitions(*keys, "_side", *[f"_passing.{k}" for k in order]).mapInArrow(_by_bucket(work, to_arrow_schema(schema), size), schema)


def _width(held: DataFrame, passing: DataFrame) -> float:
    """Twice the median side, or wider while buckets hold few."""
    told = held.agg(F.count("*").alias("n"), *[(F.max(k) - F.min(k)).alias(k) for k in ("x0", "y0")]).first()
    area = (told["x0"] or 0.0) * (told["y0"] or 0.0)
    return max(2 * joins.levels(held, passing)[0], math.sqrt(min(MEAN * area / max(1, told["n"]), area / BUCKETS)))


def _by_bucket(work: Callable, schema: pa.Schema, size: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
        at, held, state = None, [], None
        for batch in batches:
            rows = [batch[k].to_numpy() for k in (*KEYS, "_part", "_side")]
            new = np.zeros(len(batch), bool)
            new[0] = True
            for k in rows:
                new[1:] |= k[1:] != k[:-1]
            first = np.flatnonzero(new)
            for begin, end in zip(first.tolist(), np.append(first[1:], len(batch)).tolist(), strict=True):
                key, side = tuple(int(k[begin]) for k in rows[:-1]), rows[-1][begin]
                if key != at:
                    if state is not None:
                        yield from state.end()
                    at, held, state = key, [], None
                part = batch["_passing" if side else "_held"].slice(begin, end - begin)
                if not side:
                    held.append(part)
                elif held:
                    if state is None:
                        state = work(_columns(pa.chunked_array(held).combine_chunks()))
                    yield from state.meet(_columns(part), (key[1], key[2]), size * 2.0 ** key[0])
        if state is not None:
            yield from state.end()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0
        for columns in found(b for b in batches if len(b)):
            some.append(pa.RecordBatch.from_arrays([pa.array(columns[f.name]).cast(f.type) for f in schema], schema=schema))
            n += len(some[-1])
            if n >= ROWS:
                yield from pa.Table.from_batches(some, schema).combine_chunks().to_batches(max_chunksize=ROWS)
                some, n = [], 0
        if some:
            yield from pa.Table.from_batches(some, schema).combine_chunks().to_batches(max_chunksize=ROWS)

    return run


def _columns(rows: pa.StructArray) -> Columns:
    """Columns of rows; rings become ``Edges``."""
    fields = dict(zip([f.name for f in rows.type], rows.flatten(), strict=True))
    return {k: Edges(v) if k == "rings" else v.to_numpy(zero_copy_only=False) for k, v in fields.items()}


class Edges:
    """The edges of each shape of a column of rings: as they are, lower end first (``bars``, of the even-odd rule), and of closed rings of finite points (``borders``)."""

    def __init__(self, rings: pa.ListArray, digits: int = 9):
        lines = rings.flatten()
        points = lines.flatten()
        x, y = (pc.struct_field(points, k).to_numpy(zero_copy_only=False).astype(float) for k in "xy")
        shape = spans(np.nan_to_num(rings.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))[0]
        ring = spans(np.nan_to_num(lines.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))[0]
        step = np.flatnonzero(ring[1:] == ring[:-1])
        px, py, qx, qy = x[step], y[step], x[step + 1], y[step + 1]
        up = (py < qy) | ((py == qy) & (px < qx))
        bars = np.stack([np.where(up, px, qx), np.where(up, py, qy), np.where(up, qx, px), np.where(up, qy, py)])
        rises = bars[1] < bars[3]
        self.bars = self._by_shape(shape[ring[step[rises]]], bars[:, rises], len(rings))
        known = np.isfinite(x) & np.isfinite(y)
        x, y, ring = x[known], y[known], ring[known]
        many = np.bincount(ring, minlength=len(lines))[ring] > 2 if len(ring) else np.zeros(0, bool)
        unit = float(10**digits)
        x, y, ring = np.rint(x[many] * unit) / unit + 0.0, np.rint(y[many] * unit) / unit + 0.0, ring[many]
        after = np.arange(1, len(ring) + 1)
        if len(ring):
            first = np.flatnonzero(np.append(True, ring[1:] != ring[:-1]))
            after[np.append(first[1:], len(ring)) - 1] = first
        border = np.stack([x, y, x[after], y[after]]) if len(ring) else np.zeros((4, 0))
        differ = (border[0] != border[2]) | (border[1] != border[3])
        self.borders = self._by_shape(shape[ring[differ]], border[:, differ], len(rings))

    @staticmethod
    def _by_shape(shape: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return ends, np.append(0, np.cumsum(np.bincount(shape, minlength=n)))

    def of(self, kind: str, i: int) -> np.ndarray:
        ends, at = getattr(self, kind)
        return ends[:, at[i] : at[i + 1], None]


def inside(bars: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Whether points lie inside by the even-odd rule: an odd number of edges to the right."""
    x0, y0, x1, y1 = bars
    met = (py >= y0) & (py < y1)
    right = x0 + (py - y0) / (y1 - y0) * (x1 - x0) > px
    return (met & right).sum(0) % 2 == 1


def reached(borders: np.ndarray, px: np.ndarray, py: np.ndarray, within: float) -> np.ndarray:
    """Whether points lie within a distance of an edge."""
    x0, y0, x1, y1 = borders
    dx, dy = x1 - x0, y1 - y0
    t = np.maximum(0.0, np.minimum(1.0, ((px - x0) * dx + (py - y0) * dy) / (dx * dx + dy * dy)))
    ex, ey = px - (x0 + t * dx), py - (y0 + t * dy)
    return (np.sqrt(ex * ex + ey * ey) <= within).any(0)


def chunks(i: np.ndarray, edges: int) -> Iterator[np.ndarray]:
    step = max(1, LOOKED // max(1, edges))
    for k in range(0, len(i), step):
        yield i[k : k + step]


class Held:
    """Boxes of a bucket by their left ends."""

    def __init__(self, held: Columns):
        order = np.argsort(held["x0"], kind="stable")
        self.held = {k: v[order] for k, v in held.items()}
        self._widest()

    def _widest(self) -> None:
        self.wide = float((self.held["x1"] - self.held["x0"]).max(initial=0.0))

    def touching(self, x0: float, y0: float, x1: float, y1: float, bucket: tuple[int, int], size: float) -> np.ndarray:
        """Held boxes that touch a box, in the one bucket where the pair is taken."""
        h = self.held
        begin, end = np.searchsorted(h["x0"], x0 - self.wide - 1e-9 * size), np.searchsorted(h["x0"], x1, side="right")
        own = slice(begin, end)
        met = (h["x1"][own] >= x0) & (h["y0"][own] <= y1) & (h["y1"][own] >= y0)
        met &= (np.floor(np.maximum(h["x0"][own], x0) / size) == bucket[0]) & (np.floor(np.maximum(h["y0"][own], y0) / size) == bucket[1])
        return begin + np.flatnonzero(met)

    def end(self) -> Iterator[Columns]:
        return iter(())


class Candidates(Held):
    """point_id, zone_id, holds, area, centre_distance of points ``held`` (point_id, px, py) and shapes ``(zone_id, rings, area, cx, cy)`` within a distance."""

    def __init__(self, held: Columns, within: float):
        super().__init__(held)
        self.within = within

    def met(self, zones: Columns, k: int, bucket: tuple[int, int], size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Points by their places, whether the shape holds them, and the distances of its centre."""
        i = self.touching(*[float(zones[e][k]) for e in ("bx0", "by0", "bx1", "by1")], bucket, size)
        px, py = self.held["px"], self.held["py"]
        if "rings" in zones:
            borders, bars = zones["rings"].of("borders", k), zones["rings"].of("bars", k)
            found = [(q[near], holds[near]) for q in chunks(i, borders.shape[1]) for holds in [inside(bars, px[q], py[q])] for near in [holds | reached(borders, px[q], py[q], self.within)]]
            i, holds = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (i, np.zeros(0, bool))
        else:
            dx, dy = (np.maximum(0.0, np.maximum(zones[f"{e}0"][k] - p[i], p[i] - zones[f"{e}1"][k])) for e, p in (("x", px), ("y", py)))
            near = dx * dx + dy * dy <= self.within * self.within
            i, holds = i[near], ((dx == 0) & (dy == 0))[near]
        gx, gy = zones["cx"][k] - px[i], zones["cy"][k] - py[i]
        return i, holds, np.sqrt(gx * gx + gy * gy)

    def meet(self, zones: Columns, bucket: tuple[int, int], size: float) -> Iterator[Columns]:
        for k in range(len(zones["bx0"])):
            i, holds, far = self.met(zones, k, bucket, size)
            if len(i):
                yield {"point_id": self.held["point_id"][i], "zone_id": np.full(len(i), zones["zone_id"][k]), "holds": holds, "area": np.full(len(i), zones["area"][k]), "centre_distance": far}


class Pick(Candidates):
    """What ``joins.picked`` needs of each point's candidates: point_id, n and n_hold (2 stands for more), holds, far, zone_id and area of the best. Shapes come by falling area and rising zone_id.

    So the first shape that holds a point is its best, and with the second one nothing about it is open: it is looked at no more. Distances are rounded as ``digits`` says."""

    def __init__(self, held: Columns, within: float, digits: int):
        super().__init__(held, within)
        n = len(self.held["x0"])
        self.digits = digits
        self.held |= {"n": np.zeros(n, np.int64), "n_hold": np.zeros(n, np.int64), "far": np.full(n, np.inf), "area": np.zeros(n)}
        self.done = 0

    def told(self, i: np.ndarray) -> Columns:
        h = {k: self.held[k][i] for k in ("point_id", "n", "n_hold", "far", "zone_id", "area")}
        return h | {"holds": h["n_hold"] > 0}

    def meet(self, zones: Columns, bucket: tuple[int, int], size: float) -> Iterator[Columns]:
        h = self.held
        h.setdefault("zone_id", np.full(len(h["x0"]), zones["zone_id"][0]))
        for k in range(len(zones["bx0"])):
            if not len(h["x0"]):
                return
            i, holds, far = self.met(zones, k, bucket, size)
            zone, area = zones["zone_id"][k], zones["area"][k]
            if not len(i):
                continue
            far = np.floor(far * 10.0**self.digits + 0.5) / 10.0**self.digits
            h["n"][i] = np.minimum(2, h["n"][i] + 1)
            best = np.where(holds, h["n_hold"][i] == 0, (h["n_hold"][i] == 0) & ((far < h["far"][i]) | ((far == h["far"][i]) & (zone < h["zone_id"][i]))))
            j = i[best]
            h["far"][j], h["zone_id"][j], h["area"][j] = np.where(holds[best], -area, far[best]), zone, area
            held = i[holds]
            self.done += int((h["n_hold"][held] == 1).sum())
            h["n_hold"][held] = np.minimum(2, h["n_hold"][held] + 1)
            if self.done > 64 and 4 * self.done > len(h["x0"]) or self.done == len(h["x0"]):
                yield self.told(np.flatnonzero(h["n_hold"] == 2))
                self.held = h = {c: v[h["n_hold"] < 2] for c, v in h.items()}
                self.done = 0

    def end(self) -> Iterator[Columns]:
        if (self.held["n"] > 0).any():
            yield self.told(np.flatnonzero(self.held["n"] > 0))


#: What ``Pick`` tells.
PARTS = {"n": "long", "n_hold": "long", "holds": "boolean", "far": "double", "area": "double"}


def at(points: DataFrame) -> DataFrame:
    """``(point_id, px, py)`` as boxes without a size."""
    c = F.col
    return points.select("point_id", "px", "py", c("px").alias("x0"), c("py").alias("y0"), c("px").alias("x1"), c("py").alias("y1"))


def reach(boxes: DataFrame, within: float) -> DataFrame:
    """``boxes`` (bx0 .. by1) with everything nearby, and a little more."""
    far = within * (1 + 1e-6)
    return boxes.withColumns({k: F.col(k) + (far if k[2] == "1" else -far) for k in ("bx0", "by0", "bx1", "by1")})


def kinds(points: DataFrame, zones: DataFrame) -> dict[str, str]:
    return {"point_id": points.schema["point_id"].dataType.simpleString(), "zone_id": zones.schema["zone_id"].dataType.simpleString()}


def pick_parts(points: DataFrame, zones: DataFrame, within: float, digits: int) -> DataFrame:
    """``Pick``'s rows of points ``(point_id, px, py)`` and ``zones`` (zone_id, area, cx, cy, boxes bx0 .. by1, and rings or x0 .. y1)."""
    passing = reach(zones.withColumn("rank", -F.col("area")), within)
    return swept(at(points), passing, lambda held: Pick(held, within, digits), kinds(points, zones) | PARTS, ("rank", "zone_id"))


def picked(parts: DataFrame) -> DataFrame:
    """point_id, zone_id, area, method: one zone a point, by the rules of ``joins.truth_pick``."""
    c = F.col
    order = F.struct((~c("holds")).alias("out"), "far", "zone_id", "area")
    found = parts.groupBy("point_id").agg(F.sum("n").alias("n"), F.sum("n_hold").alias("n_hold"), F.min(order).alias("best"))
    method = F.when(c("n") == 1, "single_catchment").when(c("n_hold") > 1, "largest_containing").when(c("n_hold") == 1, "contains_point").otherwise("nearest_centroid")
    return found.select("point_id", "best.zone_id", "best.area", method.alias("method"))


def box_pick(points: DataFrame, catchments: DataFrame, within: float, digits: int) -> DataFrame:
    """point_id, catchment_id, area, method: ``joins.truth_pick`` of ``joins.truth_candidates`` without a row a candidate; distances are rounded to ``digits``."""
    c = F.col
    ends = ("x0", "y0", "x1", "y1")
    zones = catchments.select(c("catchment_id").alias("zone_id"), *ends, *[c(k).alias(f"b{k}") for k in ends], ((c("x1") - c("x0")) * (c("y1") - c("y0"))).alias("area"), ((c("x0") + c("x1")) / 2).alias("cx"), ((c("y0") + c("y1")) / 2).alias("cy"))
    return picked(pick_parts(points, zones, within, digits)).withColumnRenamed("zone_id", "catchment_id")


class Lengths(Held):
    """zone_id, km: length of lines ``held`` (boxes, with ends sx, sy, ex, ey) inside each shape ``(zone_id, rings)``."""

    def meet(self, zones: Columns, bucket: tuple[int, int], size: float) -> Iterator[Columns]:
        ids, kms = [], []
        for k in range(len(zones["bx0"])):
            i = self.touching(*[float(zones[e][k]) for e in ("bx0", "by0", "bx1", "by1")], bucket, size)
            borders, bars = zones["rings"].of("borders", k), zones["rings"].of("bars", k)
            km = sum(self.length(borders, bars, q) for q in chunks(i, borders.shape[1]))
            if km > 0:
                ids.append(zones["zone_id"][k])
                kms.append(km)
        if ids:
            yield {"zone_id": np.array(ids), "km": np.array(kms)}

    def length(self, borders: np.ndarray, bars: np.ndarray, i: np.ndarray) -> float:
        """Lines are cut where edges cross or touch them; a piece counts if its middle lies inside."""
        sx, sy = self.held["sx"][i], self.held["sy"][i]
        dx, dy = self.held["ex"][i] - sx, self.held["ey"][i] - sy
        x0, y0, x1, y1 = borders
        ex, ey, wx, wy = x1 - x0, y1 - y0, x0 - sx, y0 - sy
        cross = dx * ey - dy * ex
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (wx * ey - wy * ex) / cross, (wx * dy - wy * dx) / cross
            cut = (cross != 0) & (t > 0) & (t < 1) & (u > -1e-9) & (u < 1 + 1e-9)
        edge, line = np.nonzero(cut)
        n = np.arange(len(i))
        line, at = np.concatenate([n, line, n]), np.concatenate([np.zeros(len(n)), t[edge, line], np.ones(len(n))])
        order = np.lexsort((at, line))
        line, at = line[order], at[order]
        own = np.flatnonzero(line[1:] == line[:-1])
        line, a, b = line[own], at[own], at[own + 1]
        middle = (a + b) / 2
        held = np.concatenate([inside(bars, (sx[line] + middle * dx[line])[p], (sy[line] + middle * dy[line])[p]) for p in chunks(np.arange(len(line)), bars.shape[1])]) if len(line) else np.zeros(0, bool)
        return float(((b - a) * np.sqrt(dx * dx + dy * dy)[line])[held].sum())
