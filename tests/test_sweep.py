"""Pairs of a spatial join are not rows that travel, and results hang neither on how buckets are dealt nor on how shapes are spread."""

import random

import pytest

from terrainframe.operators import joins, predicates, sweep

SHAPE = "zone_id long, rings array<array<struct<x:double,y:double>>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


@pytest.fixture
def layers(spark):
    rng = random.Random(6)
    zones = [(i, [box(x := float(rng.randrange(40)), y := float(rng.randrange(30)), w := rng.choice([2.0, 5.0, 9.0, 30.0]), h := rng.choice([3.0, 7.0])), box(x + w / 4, y + h / 4, w / 2, h / 2), box(x + w + 1.0, y + 0.0, 1.0, 1.0)]) for i in range(60)]
    zones += [(60, None), (61, []), (62, [None, [(1.0, 1.0), (2.0, 2.0)]]), (63, [[(0.0, 0.0), (4.0, -3.0), (9.0, 0.0), (0.0, 9.0), (0.0, 0.0)]])]
    points = [(i, rng.random() * 50 - 4, rng.random() * 40 - 4) for i in range(150)] + [(150, 500.0, 500.0)]
    lines = [(i, x := rng.random() * 45, y := rng.random() * 35, x + rng.choice([-4.0, 0.0, 3.0, 25.0]), y + rng.choice([-3.0, 0.0, 2.0, 15.0])) for i in range(120)]
    return spark.createDataFrame(points, "point_id long, px double, py double"), spark.createDataFrame(zones, SHAPE), spark.createDataFrame(lines, "line_id long, x0 double, y0 double, x1 double, y1 double")


def rows(df, digits=6):
    return sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_candidates_of_shapes(layers, monkeypatch):
    points, zones, _ = layers
    found = predicates.shape_candidates(points, zones, 3.0)
    assert "Aggregate" not in plan(found) and plan(found).count("MapInArrow") == 1
    whole = rows(found)
    assert len(whole) > 300
    monkeypatch.setattr(sweep, "HELD", 7)
    monkeypatch.setattr(sweep, "LOOKED", 50)
    monkeypatch.setattr(sweep, "ROWS", 20)
    assert rows(predicates.shape_candidates(points, zones, 3.0)) == whole
    monkeypatch.setattr(predicates, "FEW_POINTS", 0)
    assert rows(predicates.shape_candidates(points, zones, 3.0)) == whole


def test_picks_make_no_row_a_candidate(layers, monkeypatch):
    """Each point goes on once a bucket; before, each of its candidates did."""
    points, zones, _ = layers
    candidates = predicates.shape_candidates(points, zones, 3.0).withColumnRenamed("zone_id", "catchment_id")
    want = rows(joins.truth_pick(candidates.selectExpr("point_id", "catchment_id", "holds", "round(area, 6) area", "round(centre_distance, 6) centre_distance")))
    for held in (sweep.HELD, 9):
        monkeypatch.setattr(sweep, "HELD", held)
        assert rows(predicates.shape_pick(points, zones, 3.0, 6)) == want
    boxes = zones.where("zone_id < 60").selectExpr("zone_id AS catchment_id", "rings[0][0].x x0", "rings[0][0].y y0", "rings[0][2].x x1", "rings[0][2].y y1")
    want = rows(joins.truth_pick(joins.truth_candidates(points, boxes, 3.0)))
    assert rows(sweep.box_pick(points, boxes, 3.0, 9)) == want and {r[3] for r in want} == {"single_catchment", "largest_containing", "contains_point", "nearest_centroid"}
    measured = boxes.selectExpr("catchment_id zone_id", "x0", "y0", "x1", "y1", "x0 bx0", "y0 by0", "x1 bx1", "y1 by1", "(x1 - x0) * (y1 - y0) area", "(x0 + x1) / 2 cx", "(y0 + y1) / 2 cy")
    assert sweep.pick_parts(points, measured, 3.0, 9).count() < 2 * 150 < joins.truth_candidates(points, boxes, 3.0).count()
    monkeypatch.setattr(predicates, "FEW_POINTS", 0)
    assert rows(predicates.shape_pick(points, zones, 3.0, 6)) == rows(joins.truth_pick(candidates.selectExpr("point_id", "catchment_id", "holds", "round(area, 6) area", "round(centre_distance, 6) centre_distance")))


def test_lengths_in_shapes_make_no_row_a_pair(layers, monkeypatch):
    _, zones, lines = layers
    found = predicates.stream_density(zones, lines)
    assert "line-pieces" not in plan(found)
    whole = rows(found)
    assert sum(r[1] for r in whole) > 50
    monkeypatch.setattr(sweep, "HELD", 5)
    monkeypatch.setattr(sweep, "LOOKED", 50)
    assert rows(predicates.stream_density(zones, lines)) == whole
    monkeypatch.setattr(predicates, "FEW_POINTS", 0)
    assert rows(predicates.stream_density(zones, lines)) == whole
