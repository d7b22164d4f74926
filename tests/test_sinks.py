import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrainframe.operators import layers, outlines
from terrainframe.sources import sinks


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', 1.5, [1.0, 2.0]), (2, None, None, None)], "id long, name string, v double, ring array<double>")
    sinks.write_csv(df, str(tmp_path / "drop"))
    back = spark.read.option("escape", '"').csv(str(tmp_path / "drop"), header=True, schema="id long, name string, v double")
    assert sorted(map(tuple, back.collect())) == [(1, 'a "b", c', 1.5), (2, None, None)]
    sinks.write_csv(df, str(tmp_path / "text"), "text")
    rows = spark.read.option("escape", '"').csv(str(tmp_path / "text"), header=True).orderBy("id").collect()
    assert json.loads(rows[0].ring) == [1.0, 2.0] and rows[1].ring is None
    with pytest.raises(ValueError):
        sinks.write_csv(df, str(tmp_path / "x"), "no")


def test_records_and_failed_samples(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, name string")
    sinks.write_records(df, str(tmp_path / "r"), {"run": F.lit("a")})
    rows = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "r")).collect()), key=lambda x: x["result"]["id"])
    assert rows == [{"metadata": {"run": "a"}, "result": {"id": 1, "name": None}}, {"metadata": {"run": "a"}, "result": {"id": 2, "name": "x"}}]
    errors = spark.createDataFrame([("2", "b", "m"), ("2", "a", "n"), ("2", "a", "n"), ("9", "a", "n")], "id string, error_type string, message string")
    got = sinks.failed(df, errors).collect()
    assert [(r.id, [tuple(e) for e in r.errors]) for r in got] == [(2, [("a", "n"), ("b", "m")])]
    assert sinks.summary("By name", df.orderBy("id")) == "By name\n=======\nid  name\n1\n2   x\n"


def test_features_keep_parts_and_holes(spark, tmp_path):
    mask = np.zeros((9, 9), bool)
    mask[0:5, 0:5] = True
    mask[1:3, 1:3] = False
    mask[6:9, 6:9] = True
    mask[7, 7] = False
    cells = spark.createDataFrame([(1, int(r), int(c)) for r, c in np.argwhere(mask)], "pour_id long, row long, col long")
    sinks.write_features(outlines.outlines(cells, 0.0, 0.0, 1.0), str(tmp_path / "f"), "rings", ["pour_id"])
    f = json.loads(spark.read.text(str(tmp_path / "f")).first().value)
    shoelace = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False)) / 2
    assert sorted([round(shoelace(r)) for r in poly] for poly in f["geometry"]["coordinates"]) == [[9, -1], [25, -4]] and f["properties"] == {"pour_id": 1}


def test_points_and_distances(spark):
    rows = sinks.points_from(spark.createDataFrame([(-105.0, 40.0), (None, 1.0)], "lon double, lat double"), "lon", "lat").collect()
    assert (rows[0].geometry.x, rows[0].geometry.y) == (-105.0, 40.0) and rows[1].geometry is None
    one = lambda c: spark.range(1).select(c).first()[0]
    d = lambda *x: one(layers.geodesic_m(*map(F.lit, x)))
    assert abs(d(0.0, 0.0, 0.0, 1.0) - math.pi / 180 * 6378137) < 1e-3 and d(10.0, 20.0, 10.0, 20.0) == 0
    assert abs(d(-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777) - 54972.271) < 1e-2  # a published pair
    assert d(0.0, 0.0, 0.5, 179.7) is None


def test_projected_areas(spark):
    """An equal-area projection keeps the area of a box in degrees but for its straight sides."""
    from terrainframe.functions import crs
    from terrainframe.functions import geometry as g

    side = 0.01
    ring = g.box_ring(F.lit(-105.0), F.lit(40.0), F.lit(-105.0 + side), F.lit(40.0 + side))
    got = spark.range(1).select(g.area(layers.projected_ring(ring))).first()[0]
    e = math.sqrt(crs.E2)
    q = lambda lat: (1 - e * e) * (math.sin(lat) / (1 - (e * math.sin(lat)) ** 2) - math.log((1 - e * math.sin(lat)) / (1 + e * math.sin(lat))) / (2 * e))
    want = 6378137.0**2 * math.radians(side) * (q(math.radians(40.0 + side)) - q(math.radians(40.0))) / 2
    assert abs(got - want) < 1e-6 * want
