"""Plans whose cost must follow the input: nothing broadcast by a wrong estimate, no pairs that can't meet, no row a pixel."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from terrainframe.functions.quantiles import exact_quantiles
from terrainframe.operators import hydrology, joins, kernels, layers, masks, noding, outlines, overlay, stencil
from terrainframe.plans import vector


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_are_not_broadcast(spark):
    edges = hydrology.written(spark.createDataFrame([(0, 0, 0, 1)], "row long, col long, to_row long, to_col long"), "test-edges")
    assert "Broadcast" not in plan(edges.join(edges.select(F.col("to_row").alias("row"), F.col("to_col").alias("col")), ["row", "col"]))


def test_cells_of_shapes_are_not_broadcast(spark):
    square = [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)]]
    zones = spark.createDataFrame([(1, square)], "zone_id long, rings array<array<struct<x:double,y:double>>>")
    cells = spark.range(100).select(F.floor(F.col("id") / 10).alias("row"), (F.col("id") % 10).alias("col"), F.lit(1.0).alias("elev"))
    found = joins.zonal_shapes(cells, zones)
    assert "Broadcast" not in plan(found) and found.count() == 81


def test_visitors_of_a_wide_bucket_do_not_meet(spark):
    """Small boxes apart, and one wide box a side that makes a level of one bucket: only it meets all of them there."""
    n = 300
    small = [(i, float(10 * i), 0.0, 10.0 * i + 1, 1.0) for i in range(n)]
    wide = (n, 0.0, 0.0, 10.0 * n, 1.0)
    left = spark.createDataFrame([*small, wide], "a long, x0 double, y0 double, x1 double, y1 double")
    right = spark.createDataFrame([*small, wide], "b long, bx0 double, by0 double, bx1 double, by1 double")
    found = joins.overlapping(left, right)
    assert "Broadcast" not in plan(found) and "_kind" in plan(found)
    assert found.count() == n + 2 * n + 1


def test_zonal_names_cells(spark):
    cells = spark.range(100).select(F.floor(F.col("id") / 10).alias("row"), (F.col("id") % 10).alias("col"), F.lit(1.0).alias("elev"))
    zones = spark.createDataFrame([(1, -1e9, -1e9, 1e9, 1e9), (2, 0.5, 2.5, 1.5, 3.4), (3, 20.0, 0.0, 30.0, 9.0)], "zone_id long, x0 double, y0 double, x1 double, y1 double")
    found = joins.zonal(cells, zones)
    assert "_bx" not in plan(found)
    assert sorted((r.zone_id, r["count"]) for r in found.groupBy("zone_id").count().collect()) == [(1, 100), (2, 2)]
    assert joins.zonal(cells.where("row < 0"), zones).count() == 0


def test_equal_places_and_shapes_are_tested_once(spark):
    square = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]]
    zones = spark.createDataFrame([(i, square) for i in range(20)], "zone_id long, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(i, 1.0, 1.0) for i in range(20)] + [(99, 5.0, 1.0), (100, None, 1.0)], "point_id long, px double, py double")
    found = joins.points_in_shapes(points, zones)
    assert "places-inside" in plan(found)
    assert found.count() == 400 and found.distinct().count() == 400


def test_pick_needs_no_window(spark):
    rows = [(1, 7, False, 4.0, 2.0), (1, 5, True, 1.0, 9.0), (1, 4, True, 3.0, 9.0), (1, 3, True, 3.0, 8.0), (2, 9, False, 1.0, 1.0), (2, 8, False, 5.0, 1.0), (3, 1, True, 2.0, 0.0)]
    found = joins.truth_pick(spark.createDataFrame(rows, "point_id long, catchment_id long, holds boolean, area double, centre_distance double"))
    assert "Window" not in plan(found)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 3, 3.0, "largest_containing"), (2, 8, 5.0, "nearest_centroid"), (3, 1, 2.0, "single_catchment")]


def test_burnt_runs_equal_pixels(spark, monkeypatch):
    monkeypatch.setattr(stencil, "RUN_BLOCK", 7)
    rnd = random.Random(5)
    lines = [(i, *[rnd.randrange(40 if k % 2 == 0 else 25) for k in range(4)]) for i in range(60)]
    lines += [(3, 0, 0, 39, 24), (4, *lines[4][1:]), (70, 5, 5, 5, 5), (71, 0, 3, 39, 3), (72, 8, 0, 8, 24)]
    lines = spark.createDataFrame(lines, "line_id long, r0 long, c0 long, r1 long, c1 long")
    cells = spark.range(1000).select(F.floor(F.col("id") / 25).alias("row"), (F.col("id") % 25).alias("col"), F.when(F.col("id") % 19 != 0, F.col("id") * 1.0).alias("elev"))
    grid = stencil.Grid(cells, 40, 25)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(stencil.burn_lines(grid, lines)) == rows(stencil.burn(grid, stencil.bresenham(lines)))


def test_rings_of_one_length_together():
    rng = np.random.default_rng(4)
    for n in (0, 1, 3, 4, 5, 6, 9, 70):
        points = rng.integers(0, 4, (200, n, 2)).astype(float)
        if n:
            points[::2, -1] = points[::2, 0]
            points[::17, 0, 0] = np.nan
            points[::13] = points[::13, :1]
        assert kernels.issues_each(points) == [kernels.issue_of(p) for p in points]
        assert list(kernels.crossings_each(points)) == [kernels.crossings(p) for p in points]


def test_quantile_rows_of_a_group_are_dealt(spark):
    df = spark.range(1001).select(F.lit("g").alias("k"), F.col("id").cast("double").alias("v"))
    found = exact_quantiles(df, "v", {"m": 0.5}, ["k"])
    assert "salt" in plan(found) and found.first()["m"] == 500.0


def test_samples_are_dealt(spark):
    kept, failed = layers.split_samples(spark.range(100), spark.range(50).union(spark.range(50)))
    assert "REPARTITION_BY_NUM" in plan(kept)
    assert (kept.count(), failed.count()) == (50, 50)


def test_equal_shapes_are_overlaid_once(spark):
    box = lambda x: [[(x, 0.0), (x + 2.0, 0.0), (x + 2.0, 2.0), (x, 2.0), (x, 0.0)]]
    pairs = spark.createDataFrame([(i, box(0.0), box(1.0)) for i in range(9)] + [(9, None, box(0.0))], "shape_id long, a array<array<struct<x:double,y:double>>>, b array<array<struct<x:double,y:double>>>")
    seen = []
    whole = overlay.once_each(pairs, ["a", "b"], lambda forms: seen.append(forms.count()) or forms.select("shape_id"))
    assert seen == [2] and sorted(r.shape_id for r in whole.collect()) == list(range(10))


def test_shapes_of_few_edges_meet_in_their_row(spark, monkeypatch):
    """No bucket or band is made for them, and buckets and bands give the same sides."""
    rng = random.Random(11)
    ring = lambda: [(p := [(float(rng.randrange(6)), float(rng.randrange(6))) for _ in range(7)]) and [*p, p[0]]]
    pairs = spark.createDataFrame([(i, ring(), ring()) for i in range(12)], "shape_id long, a array<array<struct<x:double,y:double>>>, b array<array<struct<x:double,y:double>>>")
    edges = overlay.shape_edges(pairs, "a", 0).unionByName(overlay.shape_edges(pairs, "b", 1)).cache()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    few = overlay.sided(overlay.noded(edges))
    assert "band" not in plan(few) and "bx" not in plan(overlay.noded(edges)) and "Join" not in plan(overlay.noded(edges))
    small = rows(few)
    monkeypatch.setattr(overlay, "FEW_EDGES", 14)
    monkeypatch.setattr(overlay, "FEW_PIECES", 0)
    assert rows(overlay.sided(overlay.noded(edges))) == small and len(small) > 100


def test_outlines_deal_cells_once(spark):
    """From cells to chains one exchange, whose rows are little more than the cells, and no rounds of jumps where rings close within tiles."""
    cells = spark.range(40_000).select((F.col("id") % 1).alias("pour_id"), F.floor(F.col("id") / 200).alias("row"), (F.col("id") % 200).alias("col")).where("(row * 7 + col * 3) % 5 > 1")
    steps = outlines.steps(cells)
    assert plan(steps).count("Exchange") == 1 and "Join" not in plan(steps)
    chained = outlines.chained(steps)
    assert chained.count() == steps.select("edge").distinct().count() and chained.where("chain IS NOT NULL").isEmpty()


def test_rings_hang_on_no_dealing(spark):
    """Sets over tile borders and below zero, met at corners: the rings are those of edges dealt one by one, and of a walk."""
    rng = random.Random(2)
    held = [(p, r, c) for p in (1, 2) for r in range(-6, 9) for c in range(251, 262) if rng.random() < 0.6] + [(3, 0, c) for c in range(600)]
    cells = spark.createDataFrame([*held, *held[:9]], "pour_id long, row long, col long")
    rows = lambda df: sorted(tuple(r) for r in df.select("pour_id", "ring", "edge", "bend").collect())
    order = lambda df: [(r.pour_id, r.ring, r.edges) for r in df.groupBy("pour_id", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "edge"))), lambda q: q.edge).alias("edges")).orderBy("pour_id", "ring").collect()]
    tiled = outlines.rings(cells)
    dealt = outlines.ring_places(outlines.steps(cells).repartition(40, "edge"))
    assert rows(tiled) == rows(dealt) and order(tiled) == order(dealt)
    follow = {(r.pour_id, r.edge): r.next for r in outlines.steps(cells).collect()}
    inside = set(held)
    assert len(follow) == sum((p, r + dr, c + dc) not in inside for p, r, c in inside for dr, dc in ((0, 1), (0, -1), (1, 0), (-1, 0)))
    for p, ring, edges in order(tiled):
        assert ring == edges[0] == min(edges) and all(follow[p, e] == f for e, f in zip(edges, [*edges[1:], edges[0]], strict=True))
    assert sum(len(edges) for _, _, edges in order(tiled)) == len(follow)


def test_filling_gathers_no_ring(spark):
    """A set's rings, and a ring's points, may be millions: none of them become an array."""
    cells = spark.createDataFrame([(1, r, c) for r in range(6) for c in range(6) if (r, c) not in {(1, 1), (2, 2), (4, 4)}] + [(1, 9, 9)], "pour_id long, row long, col long")
    found = masks.filled(cells, 4)
    assert "collect_list" not in plan(found) and found.count() == 36


def test_few_lines_are_dealt_before_they_become_pixels(spark):
    lines = spark.range(40, numPartitions=1).select(F.col("id").alias("line_id"), F.lit(0).cast("long").alias("r0"), F.col("id").alias("c0"), F.lit(50).cast("long").alias("r1"), (39 - F.col("id")).alias("c1"))
    found = stencil.bresenham(lines)
    assert found.rdd.getNumPartitions() == 4 and found.count() == 40 * 51


def test_borders_are_traced_the_same_by_shape_and_by_square(spark, monkeypatch):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 4.0), (3, -2.0, 0.0, 2.0, 0.0), (3, 0.0, -2.0, 0.0, 2.0), (4, 5.0, 5.0, 5.0, 5.0)], "shape_id long, x0 double, y0 double, x1 double, y1 double")
    seen = []
    for most in (100_000, 0):
        monkeypatch.setattr(overlay, "RING_PIECES", most)
        rows = overlay.buffered(None, lines, 0.5).collect()
        seen.append(sorted((r.shape_id, r.n_outer, r.n_holes, r.n_corners, round(r.area, 6), sorted(sorted((p.x, p.y) for p in ring[:-1]) for ring in r.rings)) for r in rows))
    assert seen[0] == seen[1] and [r[:3] for r in seen[0]] == [(1, 1, 0), (3, 1, 0), (4, 1, 0)]


def test_few_edges_are_noded_and_sided_with_one_exchange(spark):
    """Edges are dealt once; no array of a shape's edges, no row a pair of them, and sides need no second exchange."""
    edges = spark.createDataFrame([(1, 0, 0.0, 0.0, 2.0, 2.0), (1, 0, 0.0, 2.0, 2.0, 0.0)], "shape_id long, owner int, x0 double, y0 double, x1 double, y1 double")
    for found in (overlay.sided(overlay.noded(edges, rays=True)), overlay.wound(overlay.noded(edges, all_pieces=True, rays=True))):
        assert plan(found).count("Exchange") == 1 and not any(k in plan(found) for k in ("collect_list", "Generate", "Join"))
        assert found.count() == 4


def test_pieces_hang_on_no_passes(monkeypatch):
    """Shapes in one pass or many, and cut by batches anywhere, give the same pieces; rays meet what a loop over pieces finds."""
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 40, 60)
    ids = np.repeat(np.arange(60), counts)
    ends = np.where(rng.random((4, len(ids))) < 0.8, rng.integers(0, 9, (4, len(ids))), np.rint(rng.random((4, len(ids))) * 9e9) / 1e9)
    ends[2] += (ends[0] == ends[2]) & (ends[1] == ends[3])
    names = pa.array([None if k == 0 else f"s{k}" for k in ids])
    given = pa.table({"shape_id": names, "owner": pa.array(rng.integers(0, 2, len(ids)), pa.int32()), **{k: pa.array(v) for k, v in zip(overlay.ENDS, ends, strict=True)}})
    schema = pa.schema([("shape_id", pa.string()), *[(k, pa.float64()) for k in overlay.ENDS], *[(k, pa.int64()) for k in ("a", "b", "n", "net", "na", "nb", "w")], ("rising", pa.bool_())])
    work = noding.by_shape(lambda rows: noding.rays(noding.pieces(rows, 9)), schema)
    rows = lambda size: pa.Table.from_batches(work(iter(given.to_batches(max_chunksize=size))), schema)
    whole = rows(10_000)
    monkeypatch.setattr(noding, "PAIRS", 50)
    monkeypatch.setattr(noding, "ROWS", 30)
    assert rows(7).equals(whole) and len(whole) > len(ids)
    for k in (1, 17, 59):
        own = whole.filter(pc.equal(whole["shape_id"], f"s{k}")).to_pylist()
        for i, p in enumerate(own):
            h, x, seen = [p[f"y{e}"] + noding.SLANT * p[f"x{e}"] for e in "01"], (p["x0"] + p["x1"]) / 2, []
            for j, q in enumerate(own):
                g, at = [q[f"y{e}"] + noding.SLANT * q[f"x{e}"] for e in "01"], sum(h) / 2
                if i != j and min(g) <= at < max(g) and q["x0"] + (at - g[0]) / (g[1] - g[0]) * (q["x1"] - q["x0"]) > x:
                    seen.append((q["a"], q["b"], q["net"] if q["rising"] else -q["net"]))
            assert (p["na"], p["nb"], p["w"]) == tuple(map(sum, zip(*seen, strict=True))) if seen else (p["na"], p["nb"], p["w"]) == (0, 0, 0)


def test_few_lines_are_dealt_before_they_become_edges(spark):
    """A small file of lines is not one task's work, and no ring becomes an array; the edges are those of the ring, of a point's circle, and of the half around a lone finite end."""
    nan, inf = float("nan"), float("inf")
    lines = [(1, 0.0, 0.0, 3.0, 4.0), (2, 1.0, 1.0, 1.0, 1.0), (3, 0.0, 0.0, inf, 0.0), (4, inf, 2.0, 0.0, 0.0), (5, nan, 0.0, 1.0, 1.0), (6, None, 0.0, 1.0, 1.0)]
    found = overlay.capsule_edges(spark.createDataFrame(lines, "shape_id long, x0 double, y0 double, x1 double, y1 double").coalesce(1), 0.5, 8)
    assert found.rdd.getNumPartitions() == 4 and "transform" not in plan(found)
    got = {k: sorted(tuple(r)[2:] for r in found.where(F.col("shape_id") == k).collect()) for k, *_ in lines}
    for k, *line in lines[:4]:
        x0, y0, x1, y1 = line
        turn = np.arctan2(y1 - y0, x1 - x0)
        ring = [(x + 0.5 * np.cos(turn + start + i * np.pi / 4), y + 0.5 * np.sin(turn + start + i * np.pi / 4)) for x, y, start in ((x1, y1, -np.pi / 2), (x0, y0, np.pi / 2)) for i in range(5) if np.isfinite([x, y]).all()]
        edges = sorted((*p, *q) for p, q in zip(np.round(ring, 9), np.round([*ring[1:], ring[0]], 9), strict=True) if tuple(p) != tuple(q))
        assert len(got[k]) == len(edges) == {1: 10, 2: 8, 3: 5, 4: 5}[k] and np.allclose(got[k], edges, atol=2e-9)
    assert got[5] == got[6] == []


def test_a_flow_is_worked_out_once_for_watersheds(spark, monkeypatch):
    """The walks read written codes; before, each filter on a code had the stencil's arithmetic in it again."""
    cells = spark.range(400).select(F.floor(F.col("id") / 20).alias("row"), (F.col("id") % 20).alias("col"), ((F.col("id") * 37) % 101).cast("double").alias("elev"))
    grid = stencil.Grid(cells, 20, 20)
    pours = cells.select((F.col("row") * 20 + F.col("col")).alias("pour_id"), "row", "col")
    seen, real = [], hydrology.written
    monkeypatch.setattr(hydrology, "written", lambda df, name: seen.append((name, plan(df).count("greatest("))) or real(df, name))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    found = rows(hydrology.watersheds(stencil.d8(grid), grid, pours))
    assert seen[0][0] == "flow" and seen[0][1] > 0 and all(n == 0 for _, n in seen[1:])
    seen.clear()
    assert rows(hydrology.watersheds(real(stencil.d8(grid), "test-flow"), grid, pours)) == found and "flow" not in dict(seen) and len(found) > 400


def test_shuffled_mb_of_watershed_polygons_follow_the_input(spark, tmp_path):
    """A cell costs as many shuffled bytes on three times the tables, and fewer than where every border edge went through rounds of joins."""
    sc, each = spark.sparkContext._jsc.sc(), []

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        executors = sc.statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    for copies in (1, 3):
        made = {}
        for name, key in (("orders", "o_orderkey"), ("customer", "c_custkey")):
            one = spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
            made[name] = one.crossJoin(spark.range(copies).toDF("copy")).withColumn(key, F.col(key) + F.col("copy") * one.count()).drop("copy").coalesce(1).sortWithinPartitions(key)
            made[name].write.parquet(f"{tmp_path}/{copies}/{name}.parquet")
        cells, pours, began = made["orders"].count(), made["customer"].count(), shuffled()
        assert len(vector.watershed_polygons(spark, f"{tmp_path}/{copies}").collect()) == pours
        each.append((shuffled() - began) / cells)
    assert each[1] < 1.1 * each[0] and each[1] < 200, each
