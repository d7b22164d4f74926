import random

import numpy as np
import pytest

from terrainframe.operators import joins, kernels, overlay, predicates, validity

RING = "array<struct<x:double,y:double>>"


def box(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d), (a, b)]


def shapes_of(spark, shapes):
    plain = lambda rings: None if rings is None else [[(float(x), float(y)) for x, y in r] for r in rings]
    return spark.createDataFrame([(k, *map(plain, v)) for k, v in shapes.items()], "shape_id long, " + ", ".join(f"{c} array<{RING}>" for c in (["rings"] if len(next(iter(shapes.values()))) == 1 else ["a", "b"])))


def areas(a, b):
    arrays = lambda rings: [np.array(r, float) for r in rings or [] if len(r) > 2]
    return kernels.common_areas(arrays(a), arrays(b))


def arrays_of(row):
    return [np.array([(p.x, p.y) for p in r]) for r in row.rings]


FIXED = {
    1: ([[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]], "repaired", 2, 0, 2.0),  # a bow-tie's two faces
    2: ([box(0, 0, 4, 4), box(1, 1, 3, 3)], "unchanged", 1, 1, 12.0),
    3: ([[(0, 0), (4, 0), (4, 4), (2, 4), (2, 6), (2, 4), (0, 4), (0, 0)]], "repaired", 1, 0, 16.0),  # a spike without width
    4: ([box(0, 0, 4, 4), box(0, 0, 4, 4)], "removed", 0, 0, 0.0),
    5: ([[(0, 0), (1, 1)]], "removed", 0, 0, 0.0),
    6: (None, "removed", 0, 0, 0.0),
    7: ([], "removed", 0, 0, 0.0),
    8: ([[(0, 0), (float("nan"), 1), (1, 0), (1, 1), (0, 1)]], "repaired", 1, 0, 1.0),
    9: ([[(0, 0), (2, 0), (2, 2), (4, 2), (4, 4), (2, 4), (2, 2), (0, 2), (0, 0)]], "unchanged", 2, 0, 8.0),  # squares that touch at a corner
    10: ([box(0, 0, 4, 4), box(4, 1, 6, 2)], "repaired", 1, 0, 18.0),  # a part against a side: one face
    11: ([box(0, 0, 9, 9), box(2, 2, 7, 7), box(4, 4, 5, 5)], "unchanged", 2, 1, 57.0),  # an island in a lake
    12: ([[(0, 0), (4, 0), (4, 0), (4, 4), (0, 4), (0, 0)]], "repaired", 1, 0, 16.0),  # a repeated point
    13: ([[(0, 0), (3, 0), (1, 0), (2, 0)]], "removed", 0, 0, 0.0),  # a line there and back
    14: ([[(1e6, 4e6), (1e6 + 2, 4e6 + 2), (1e6 + 2, 4e6), (1e6, 4e6 + 2), (1e6, 4e6)]], "repaired", 2, 0, 2.0),
}


def test_valid_shapes(spark):
    out = {r.shape_id: r for r in overlay.make_valid(shapes_of(spark, {k: (v[0],) for k, v in FIXED.items()})).collect()}
    for k, (_, outcome, outer, holes, area) in FIXED.items():
        r = out[k]
        assert (k, r.outcome, r.n_outer, r.n_holes, round(r.area, 9)) == (k, outcome, outer, holes, area)
        assert all(ring[0] == ring[-1] for ring in r.rings)
    assert sorted((p.x, p.y) for p in out[3].rings[0][:-1]) == [(0, 0), (0, 4), (4, 0), (4, 4)]


@pytest.fixture(scope="module")
def random_shapes():
    rng = random.Random(1)
    out = {}
    for k in range(30):
        ring = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(rng.choice([5, 8, 13, 30]))]
        out[k] = [[*ring, ring[0]]]
    for k in range(30, 45):  # many edges through one point and along each other
        ring = [(rng.randrange(7), rng.randrange(7)) for _ in range(rng.choice([5, 9, 14]))]
        out[k] = [[*ring, ring[0]], box(1, 1, 5, 5)]
    return out


def test_valid_shapes_keep_the_even_odd_area(spark, random_shapes):
    for r in overlay.make_valid(shapes_of(spark, {k: (v,) for k, v in random_shapes.items()})).collect():
        given = random_shapes[r.shape_id]
        back = arrays_of(r)
        assert abs(r.area - areas(given, given)[0]) < 1e-6
        assert abs(kernels.common_areas(back, back)[0] - r.area) < 1e-6 and sum(map(kernels.crossings, back)) == 0
    again = overlay.make_valid(overlay.make_valid(shapes_of(spark, {k: (v,) for k, v in random_shapes.items()}))).collect()
    assert {r.outcome for r in again} <= {"unchanged", "removed"}


def test_regions_of_pairs(spark, random_shapes):
    pairs = {a: (random_shapes[a], random_shapes[a + 1]) for a in range(44)}
    df = shapes_of(spark, pairs)
    want = {k: areas(a, b) for k, (a, b) in pairs.items()}
    value = {"intersection": lambda a, b, c: c, "union": lambda a, b, c: a + b - c, "difference": lambda a, b, c: a - c, "symmetric_difference": lambda a, b, c: a + b - 2 * c}
    for region, f in value.items():
        for r in overlay.overlay(df, region).collect():
            back = arrays_of(r)
            assert abs(r.area - f(*want[r.shape_id])) < 1e-6 and all(len(x) > 3 for x in back)
            assert abs((kernels.common_areas(back, back)[0] if back else 0) - r.area) < 1e-6
    for r in overlay.iou(df, "a", "b").collect():
        a, b, common = want[r.shape_id]
        assert r.status == "valid" and abs(r.common - common) < 1e-6 and abs(r.iou - common / (a + b - common)) < 1e-9


def test_pairs_without_a_common_area(spark):
    """Points, lines and nothing give no score and why; shapes that only touch, or lie apart, give 0."""
    square = [box(0, 0, 1, 1)]
    pairs = {
        1: ([[(0.5, 0.5)]], square), 2: (square, [[(0.5, 0.5)]]), 3: ([[(0.2, 0.2), (0.8, 0.8)]], square), 4: ([[(0, 0), (1, 1)]], [[(0, 1), (1, 0)]]),
        5: ([], square), 6: (None, square), 7: (square, [box(1, 0, 2, 1)]), 8: (square, [box(1, 1, 2, 2)]), 9: (square, [box(5, 5, 6, 6)]),
        10: ([box(0, 0, 1, 1), box(2, 2, 3, 3)], [box(0.5, 0.5, 1.5, 1.5)]), 11: ([box(0, 0, 1, 1), box(2, 2, 3, 3)], [box(0.5, 0.5, 1.5, 1.5), box(2.5, 2.5, 3.5, 3.5)]),
        12: ([box(0, 0, 4, 4), box(1, 1, 3, 3)], [box(0.5, 0.5, 1.5, 1.5)]), 13: ([[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]], [box(0, 0, 2, 2)]),
    }
    out = {r.shape_id: (r.status, r.iou) for r in overlay.iou(shapes_of(spark, pairs), "a", "b").collect()}
    assert all(out[k] == ("predicted_no_area", None) for k in (1, 3, 4, 5, 6)) and out[2] == ("truth_no_area", None)
    assert all(out[k] == ("valid", 0.0) for k in (7, 8, 9))
    assert abs(out[10][1] - 0.25 / 2.75) < 1e-12 and abs(out[11][1] - 0.5 / 3.5) < 1e-12 and abs(out[12][1] - 0.75 / 12.25) < 1e-12 and abs(out[13][1] - 0.5) < 1e-12
    related = {r.shape_id: (r.intersects, r.contains, r.within, r.touches) for r in predicates.relate(shapes_of(spark, pairs)).collect()}
    assert related[7] == related[8] == (True, False, False, True) and related[9] == (False,) * 4 and related[13] == (True, False, True, False)
    assert related[5] == related[6] == (False,) * 4 and related[12] == (True, False, False, False)


def test_buffers_against_formulas(spark):
    """Steiner's formula for a convex shape, a hole that closes, lines that cross, a point, and shapes that meet only when buffered."""
    n, r = 64, 0.5
    circle = n / 2 * r * r * np.sin(2 * np.pi / n)
    shapes = {
        1: ([box(0, 0, 4, 3)],), 2: ([box(0, 0, 9, 9), box(4, 4, 4.5, 4.5)],), 3: ([box(0, 0, 9, 9), box(3, 3, 6, 6)],), 4: ([box(0, 0, 1, 1), box(1.5, 0, 2.5, 1)],),
        5: ([[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]],), 6: ([],),
    }
    out = {x.shape_id: x for x in overlay.buffered(shapes_of(spark, shapes), None, r, n).collect()}
    assert abs(out[1].area - (12 + 14 * r + circle)) < 1e-9 and out[1].n_outer == 1 and out[1].n_holes == 0
    assert abs(out[2].area - (81 + 36 * r + circle)) < 1e-9 and out[2].n_holes == 0
    assert abs(out[3].area - (81 + 36 * r + circle - 4)) < 1e-9 and out[3].n_holes == 1
    assert out[4].n_outer == 1 and 2.5 + 7 * r + circle - 0.25 < out[4].area < 2.5 + 7 * r + circle  # but for a notch above and below the gap
    assert out[5].n_outer == 1 and out[6].area == 0
    lines = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 4.0), (2, 1.0, 1.0, 1.0, 1.0), (3, -2.0, 0.0, 2.0, 0.0), (3, 0.0, -2.0, 0.0, 2.0), (4, 0.0, 0.0, 1.0, 0.0), (4, 1.0, 0.0, 2.0, 0.0)], "shape_id long, x0 double, y0 double, x1 double, y1 double")
    out = {x.shape_id: x for x in overlay.buffered(None, lines, r, n).collect()}
    assert abs(out[1].area - (10 * r + circle)) < 1e-6 and abs(out[2].area - circle) < 1e-6
    assert abs(out[3].area - (2 * (8 * r + circle) - 1)) < 1e-6 and out[3].n_outer == 1  # a cross: the middle counts once
    assert abs(out[4].area - (4 * r + circle)) < 1e-6
    rng = np.random.default_rng(7)
    where = rng.uniform(-3, 3, (400_000, 2))
    near = (np.hypot(np.maximum(np.abs(where[:, 0]) - 2, 0), where[:, 1]) <= r) | (np.hypot(where[:, 0], np.maximum(np.abs(where[:, 1]) - 2, 0)) <= r)
    assert abs(out[3].area - 36 * near.mean()) < 0.15
    with pytest.raises(ValueError, match="radius"):
        overlay.buffered(None, lines, -1.0)


def test_faults_and_their_places(spark):
    shell, hole = box(0, 0, 8, 8), box(2, 2, 6, 6)
    shapes = {
        1: ([shell, hole],), 2: ([],), 3: (None,), 4: ([shell, []],), 5: ([[(0, 0), (1, 1), (0, 0)]],), 6: ([[(0, 0), (8, 8), (8, 0), (0, 8), (0, 0)]],), 7: ([shell, box(5, 5, 9, 7)],),
        8: ([shell, box(9, 9, 10, 10)],), 9: ([shell, hole, box(3, 3, 4, 4)],), 10: ([shell, shell],), 11: ([[(0, 0), (4, 0), (4, 4), (0, 4)]],), 12: ([[(0, 0), (4, 0), (float("inf"), 4), (4, 4), (0, 0)]],),
        13: ([[(0, 0), (2, 0), (2, 2), (4, 2), (4, 4), (2, 4), (2, 2), (0, 2), (0, 0)]],), 14: ([shell, [(0, 4), (2, 3), (2, 5), (0, 4)]],), 15: ([[(0, 0), (3, 0), (1, 0), (0, 0)]],),
    }
    df = shapes_of(spark, shapes)
    got = {r.shape_id: (r.rule, r.x, r.y) for r in validity.validity(df).collect()}
    none = (None, None)
    assert got == {
        1: (None, *none), 2: ("empty", *none), 3: ("empty", *none), 4: ("too_few_points", *none), 5: ("too_few_points", *none), 6: ("self_crossing", 4, 4), 7: ("rings_cross", 8, 5),
        8: ("hole_outside", 9.5, 9), 9: ("hole_nested", 3.5, 3), 10: ("repeated_edge", 0, 0), 11: ("not_closed", *none), 12: ("not_finite", *none),
        13: (None, *none), 14: (None, *none), 15: ("repeated_edge", 0, 0),
    }
    every = {(r.shape_id, r.rule): r.n for r in validity.faults(df).collect()}
    assert every[7, "rings_cross"] == 2 and every[10, "repeated_edge"] == 4 and every[10, "no_area"] == 1 and every[15, "no_area"] == 1


def test_empty_table(spark):
    assert overlay.make_valid(shapes_of(spark, {1: ([box(0, 0, 1, 1)],)}).limit(0)).count() == 0


def test_lines_inside_a_concave_shape(spark):
    """A fork of three arms: a line across it is inside three times."""
    comb = [[(0, 0), (7, 0), (7, 5), (6, 5), (6, 1), (4, 1), (4, 5), (3, 5), (3, 1), (1, 1), (1, 5), (0, 5), (0, 0)]]
    zones = spark.createDataFrame([(1, [[(float(x), float(y)) for x, y in r] for r in comb]), (2, [[(float(x), float(y)) for x, y in box(0, 0, 1e6, 1e6)], [(float(x), float(y)) for x, y in box(2, 2, 5, 5)]])], f"zone_id long, rings array<{RING}>")
    lines = spark.createDataFrame([(1, -1.0, 3.5, 8.0, 3.5), (2, 0.25, 0.25, 0.25, 9.0), (3, 2.0, 4.0, 2.5, 4.0), (4, 5.0, 5.0, 5.0, 5.0)], "line_id long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.zone_id, r.line_id): round(r.length, 9) for r in predicates.lines_in_shapes(lines, zones).collect()}
    assert got == {(1, 1): 3.0, (1, 2): 4.75, (2, 1): 5.0, (2, 2): 8.75}
    sizes = {r.zone_id: (r.area, r.cx) for r in predicates.shape_measures(zones).collect()}
    assert sizes[1] == (19.0, 3.5) and abs(sizes[2][0] - (1e12 - 9)) < 1e-3


def test_boxes_of_very_unlike_sizes(spark):
    """A box a million units wide fills a few buckets a level, and no pair is lost or met twice."""
    rng = random.Random(3)
    side = lambda: rng.choice([0.0, 0.5, 3.0, 40.0, 1e6])
    made = lambda n: [(i, x, y, x + side(), y + side()) for i in range(n) for x, y in [(rng.uniform(-200, 200), rng.uniform(-200, 200))]]
    a, b = made(120), made(90)
    left = spark.createDataFrame(a, "a_id long, x0 double, y0 double, x1 double, y1 double")
    right = spark.createDataFrame(b, "b_id long, bx0 double, by0 double, bx1 double, by1 double")
    got = [(r.a_id, r.b_id) for r in joins.overlapping(left, right).collect()]
    want = [(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]]
    assert sorted(got) == sorted(want)
