import json
import sqlite3
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from terrainframe.sources import rasters, vectors


def tiff(z, nodata, deflate):
    strips = [z[r : r + 2].astype("<f4").tobytes() for r in range(0, len(z), 2)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    at = [8 + sum(map(len, strips[:i])) for i in range(len(strips))]
    text = f"{nodata}\0".encode()
    entries = [(256, 3, [z.shape[1]]), (257, 3, [z.shape[0]]), (258, 3, [32]), (259, 3, [8 if deflate else 1]), (273, 4, at), (278, 3, [2]), (279, 4, [len(s) for s in strips]), (339, 3, [3]), (33550, 12, [0.01, 0.01, 0.0]), (33922, 12, [0.0, 0.0, 0.0, -105.0, 40.0, 0.0]), (42113, 2, text)]
    body, extra = b"".join(strips), b""
    ifd = 8 + len(body)
    base = ifd + 2 + 12 * len(entries) + 4
    out = struct.pack("<H", len(entries))
    for tag, kind, v in entries:
        raw = v if kind == 2 else struct.pack(f"<{len(v)}{ {3: 'H', 4: 'I', 12: 'd'}[kind] }", *v)
        if len(raw) <= 4:
            out += struct.pack("<HHI", tag, kind, len(v)) + raw.ljust(4, b"\0")
        else:
            out += struct.pack("<HHII", tag, kind, len(v), base + len(extra))
            extra += raw
    return b"II*\0" + struct.pack("<I", ifd) + body + out + b"\0\0\0\0" + extra


def test_geotiff(spark, tmp_path):
    z = np.arange(35, dtype=float).reshape(5, 7)
    z[2, 3] = -9999
    for name, packed in (("a.tif", False), ("b.tiff", True)):
        (tmp_path / name).write_bytes(tiff(z, -9999, packed))
    cells = rasters.geotiff_cells(spark, str(tmp_path))
    for name in ("a.tif", "b.tiff"):
        got = {(r.row, r.col): r.elev for r in cells.where(F.col("dem_id") == name).collect()}
        assert len(got) == 35 and got[2, 3] is None and got[4, 6] == 34
    head = rasters.geotiff_headers(spark, str(tmp_path)).first()
    assert (head.height, head.width, head.origin_x, head.origin_y, head.step_x) == (5, 7, -105.0, 40.0, 0.01)


def test_geojson_round_trip(spark, tmp_path):
    ring = [[0.0, 0.0], [2.0, 0.0], [2.0, 1.0], [0.0, 0.0]]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": t, "coordinates": c}, "properties": {"k": "v"}} for t, c in (("Point", [1, 2]), ("LineString", ring), ("Polygon", [ring]), ("MultiPolygon", [[ring], [ring]]))]}
    (tmp_path / "in.geojson").write_text(json.dumps(doc))
    rows = vectors.read_geojson(spark, str(tmp_path / "in.geojson")).collect()
    assert [(r.type, len(r.paths)) for r in rows] == [("Point", 1), ("LineString", 1), ("Polygon", 1), ("MultiPolygon", 2)] and rows[0].properties == {"k": "v"}
    df = spark.createDataFrame([(7, rows[2].paths[0]), (8, None)], "id long, ring array<struct<x:double,y:double>>")
    vectors.write_geojson(df, str(tmp_path / "out"), "ring", ["id"])
    back = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(b["type"] for b in back) == ["Feature", "FeatureCollection"]
    assert next(b for b in back if b["type"] == "Feature")["geometry"]["coordinates"] == [ring]


def test_shapefile(spark, tmp_path):
    def polygon(points):
        flat = np.array(points, "<f8")
        body = struct.pack("<i4d2ii", 5, *flat.min(0), *flat.max(0), 1, len(points), 0) + flat.tobytes()
        return struct.pack(">2I", 1, len(body) // 2) + body

    box = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)]
    (tmp_path / "x.shp").write_bytes(b"\0" * 100 + polygon(box) + polygon([(a + 5, b) for a, b in box]))
    field = b"HUC12".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6, 0]) + b"\0" * 14
    (tmp_path / "x.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 0, 0, 0, 2, 65, 7) + field + b"\r" + b" 1201  " + b" 1202  ")
    rows = vectors.read_shapefile(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.type, r.properties["HUC12"], len(r.paths[0]), r.paths[0][0].x) for r in rows] == [("Polygon", "1201", 4, 0.0), ("Polygon", "1202", 4, 5.0)]


def test_geopackage(spark, tmp_path):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    db = sqlite3.connect(tmp_path / "t.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("CREATE TABLE truth (ID TEXT, geom BLOB)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('truth', 'geom')")
    db.execute("INSERT INTO truth VALUES ('a', ?)", (b"GP\0\x01" + struct.pack("<i", 4326) + vectors.polygon_wkb([ring, ring]),))
    db.commit()
    db.close()
    row = vectors.read_geopackage(spark, str(tmp_path)).first()
    assert row.type == "Polygon" and len(row.paths) == 2 and row.properties == {"ID": "a"}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,Area_km2\n1,2.5\n")
    assert vectors.read_csv(spark, str(tmp_path / "a.csv"), "ID string, Area_km2 double").first() == ("1", 2.5)


def test_geojson_of_all_kinds(spark, tmp_path):
    shapes = [
        {"type": "Point", "coordinates": [1, 2]}, {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}, {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]},
        {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [7, 8]}, {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}]}, None,
    ]
    whole = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g, "properties": {"k": str(i)}} for i, g in enumerate(shapes)]}
    (tmp_path / "a.geojson").write_text(json.dumps(whole))
    rows = vectors.read_geojson(spark, str(tmp_path / "a.geojson")).collect()
    assert sorted((r.properties["k"], r.type, len(r.paths or [])) for r in rows if r.type) == [("0", "Point", 1), ("1", "MultiPoint", 2), ("2", "MultiPolygon", 2), ("3", "LineString", 1), ("3", "Point", 1)]
    assert [r.paths for r in rows if r.properties["k"] == "4"] == [None]
    (tmp_path / "b.geojsonl").write_text("\n".join(json.dumps(f) for f in whole["features"][:2]))
    lines = vectors.read_geojson(spark, str(tmp_path / "b.geojsonl")).collect()
    assert sorted(r.type for r in lines) == ["MultiPoint", "Point"]


def test_schema_rules(spark):
    from terrainframe.operators import validators

    df = spark.createDataFrame([(1, "a", 2.0)], "ID long, name string, area double")
    got = [(r.column_name, r.rule) for r in validators.schema_rules(df, {"ID": ["int", "bigint"], "area": ["string"], "geom": []}).orderBy("column_name").collect()]
    assert got == [("area", "type"), ("geom", "missing")]
    assert validators.schema_rules(df, {"ID": []}).count() == 0
