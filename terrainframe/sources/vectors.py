"""Vector layers: GeoJSON, Shapefile, GeoPackage and WKB. Geometry is ``array<array<struct<x, y>>>``: the rings or paths of a feature."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrainframe.sources.rasters import _files

PATHS = "array<array<struct<x:double,y:double>>>"
FEATURE = f"id long, type string, paths {PATHS}, properties map<string,string>"


def _points(flat: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in flat]


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON documents, one document a file, or one Feature a line where the path ends in ``l``: id there, type, paths, properties.

    A document is a FeatureCollection or one Feature. Members of a GeometryCollection are features of the same properties.
    """
    raw = spark.read.text(path, wholetext=not path.endswith("l"))
    geometry = "struct<type:string,coordinates:string"
    shape = f"{geometry},geometries:array<{geometry}>>>"
    feature = f"type:string,geometry:{shape},properties:map<string,string>"
    given = F.from_json("value", f"struct<{feature},features:array<struct<{feature}>>>")
    one = F.array(F.struct(F.col("g.type").alias("type"), F.col("g.geometry").alias("geometry"), F.col("g.properties").alias("properties")))
    features = raw.select(given.alias("g")).select(F.posexplode(F.when(F.col("g.type") == "Feature", one).otherwise(F.col("g.features"))).alias("id", "f"))
    members = F.when(F.col("f.geometry.type") == "GeometryCollection", F.col("f.geometry.geometries")).otherwise(F.array(F.struct(F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"))))
    each = features.select("id", F.col("f.properties").alias("properties"), F.explode_outer(members).alias("m"))
    kind, text = F.col("m.type"), F.col("m.coordinates")
    parse = lambda form: F.from_json(text, form)
    at = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    path_of = lambda line: F.transform(line, at)
    paths = (
        F.when(kind == "Point", F.array(F.array(at(parse("array<double>")))))
        .when(kind == "MultiPoint", F.transform(parse("array<array<double>>"), lambda p: F.array(at(p))))
        .when(kind == "LineString", F.array(path_of(parse("array<array<double>>"))))
        .when(kind.isin("Polygon", "MultiLineString"), F.transform(parse("array<array<array<double>>>"), path_of))
        .when(kind == "MultiPolygon", F.flatten(F.transform(parse("array<array<array<array<double>>>>"), lambda poly: F.transform(poly, path_of))))
    )
    return each.select(F.col("id").cast("long").alias("id"), kind.alias("type"), paths.alias("paths"), "properties")


def to_geojson(ring: Column, properties: dict[str, Column]) -> Column:
    """One polygon Feature as text; an empty FeatureCollection for a missing ring."""
    pairs = F.transform(ring, lambda p: F.array(p.x, p.y))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(pairs).alias("coordinates")).alias("geometry"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties")))
    return F.when(ring.isNull() | (F.size(ring) == 0), F.lit('{"type":"FeatureCollection","features":[]}')).otherwise(feature)


def write_geojson(df: DataFrame, path: str, ring: str, properties: list[str]) -> None:
    df.select(to_geojson(F.col(ring), {p: F.col(p) for p in properties}).alias("value")).write.text(path)


def shapes(data: bytes) -> Iterator[tuple[str, list[list[dict]]]]:
    """Records of a .shp file: points, lines and polygons, by parts."""
    at = 100
    while at + 8 <= len(data):
        size = struct.unpack_from(">I", data, at + 4)[0] * 2
        kind = struct.unpack_from("<i", data, at + 8)[0] % 10
        if kind == 1:
            yield "Point", [_points(np.frombuffer(data, "<f8", 2, at + 12).reshape(1, 2))]
        elif kind in (3, 5):
            parts, points = struct.unpack_from("<2i", data, at + 44)
            starts = struct.unpack_from(f"<{parts}i", data, at + 52)
            flat = np.frombuffer(data, "<f8", 2 * points, at + 52 + 4 * parts).reshape(-1, 2)
            yield ("LineString" if kind == 3 else "Polygon"), [_points(flat[a:b]) for a, b in zip(starts, [*starts[1:], points], strict=True)]
        else:
            yield "Null", []
        at += 8 + size


def table_rows(data: bytes) -> Iterator[dict[str, str]]:
    """Rows of a .dbf file as text."""
    count, head, size = struct.unpack_from("<IHH", data, 4)
    fields = []
    for at in range(32, head - 1, 32):
        if data[at] == 0x0D:
            break
        fields.append((data[at : at + 11].split(b"\x00")[0].decode(), data[at + 16]))
    for i in range(count):
        at, row = head + i * size + 1, {}
        for name, width in fields:
            row[name] = data[at : at + width].decode("utf-8", "replace").strip()
            at += width
        yield row


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Features of the .shp files under a path with the attributes of the .dbf beside each; one task a layer."""
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    shp, dbf = (_files(spark, path, f"*.{x}").select(stem.alias("layer"), F.col("content").alias(x)) for x in ("shp", "dbf"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f in frame.itertuples():
                rows = list(table_rows(f.dbf)) if f.dbf is not None else []
                out = [(i, kind, paths, rows[i] if i < len(rows) else {}) for i, (kind, paths) in enumerate(shapes(f.shp))]
                yield pd.DataFrame(out, columns=["id", "type", "paths", "properties"])

    return shp.join(dbf, "layer", "left").mapInPandas(read, FEATURE)


def from_wkb(data: bytes, at: int = 0) -> tuple[str, list[list[dict]], int]:
    """(type, paths, end) of well-known binary: points, lines, polygons and their collections; heights are skipped."""
    order = "<" if data[at] else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    wide = 2 + bool(code & 0x80000000) + (code % 1_000_000 // 1000 in (1, 3)) if code >= 1000 else 2
    kind, at = (code & 0xFFFF) % 1000, at + 5
    number = lambda p: struct.unpack_from(order + "I", data, p)[0]

    def run(p: int, n: int) -> tuple[list[dict], int]:
        return _points(np.frombuffer(data, order + "f8", wide * n, p).reshape(n, wide)[:, :2]), p + 8 * wide * n

    if kind == 1:
        pts, at = run(at, 1)
        return "Point", [pts], at
    if kind == 2:
        pts, end = run(at + 4, number(at))
        return "LineString", [pts], end
    if kind == 3:
        rings, n, at = [], number(at), at + 4
        for _ in range(n):
            pts, at = run(at + 4, number(at))
            rings.append(pts)
        return "Polygon", rings, at
    paths, n, at = [], number(at), at + 4
    for _ in range(n):
        _, part, at = from_wkb(data, at)
        paths += part
    return {4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}.get(kind, "Collection"), paths, at


def polygon_wkb(rings: list[list[tuple[float, float]]]) -> bytes:
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + np.array(r, "<f8").tobytes() for r in rings)


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """Features of GeoPackage files; one task a file. ``layer`` names the table, else the first."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f in frame.itertuples():
                db = sqlite3.connect(":memory:")
                db.deserialize(f.content)
                name, geom = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns WHERE table_name = coalesce(?, table_name)", (layer,)).fetchone()
                rows = db.execute(f'SELECT * FROM "{name}"')
                names, out = [d[0] for d in rows.description], []
                for i, row in enumerate(rows):
                    blob = row[names.index(geom)]
                    skip = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7]
                    kind, paths, _ = from_wkb(blob, skip)
                    out.append((i, kind, paths, {k: str(v) for k, v in zip(names, row, strict=True) if k != geom and v is not None}))
                yield pd.DataFrame(out, columns=["id", "type", "paths", "properties"])

    return _files(spark, path, "*.gpkg").mapInPandas(read, FEATURE)
