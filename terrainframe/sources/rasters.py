"""GeoTIFF scans: one task a file, so large rasters come as many files. Baseline TIFF: one band, strips or tiles, raw or deflate."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: TIFF tags and field types that a baseline single-band reader needs (fixed values of the format).
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, ROWS_PER_STRIP, STRIP_COUNTS, PREDICTOR = 256, 257, 258, 259, 273, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT, PIXEL_SCALE, TIE_POINT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
CELLS = "dem_id string, row long, col long, elev double"


def tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    magic, at = struct.unpack(order + "HI", data[2:8])
    if magic != 42:
        raise ValueError("not a baseline TIFF")
    out = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        code = TYPES.get(kind)
        if code is None:
            continue
        form = f"{order}{n * len(code)}{code[0]}"
        size = struct.calcsize(form)
        where = at + 10 + 12 * i
        out[tag] = struct.unpack_from(form, data, where if size <= 4 else struct.unpack_from(order + "I", data, where)[0])
    return order, out


def read_tiff(data: bytes) -> tuple[np.ndarray, dict]:
    """Elevations with no data as NaN, and (origin_x, origin_y, step_x, step_y)."""
    order, t = tags(data)
    one = lambda tag, other=None: t[tag][0] if tag in t else other
    width, height, packed = one(WIDTH), one(HEIGHT), one(COMPRESSION, 1)
    if packed not in (1, 8, 32946) or one(PREDICTOR, 1) != 1:
        raise ValueError(f"TIFF compression {packed} is not supported")
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(FORMAT, 1)] }{one(BITS) // 8}")
    tiled = TILE_OFFSETS in t
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    out = np.full((height, width), np.nan)
    across = -(-width // w)
    for i, (at, n) in enumerate(zip(t[TILE_OFFSETS if tiled else STRIP_OFFSETS], t[TILE_COUNTS if tiled else STRIP_COUNTS], strict=True)):
        part = data[at : at + n] if packed == 1 else zlib.decompress(data[at : at + n])
        r, c = i // across * h, i % across * w
        block = np.frombuffer(part, kind)
        block = block[: len(block) // w * w].reshape(-1, w)[: height - r, : width - c]
        out[r : r + len(block), c : c + block.shape[1]] = block
    if NODATA in t:
        out[out == float(b"".join(t[NODATA]).rstrip(b"\x00").decode())] = np.nan
    scale, tie = t.get(PIXEL_SCALE, (1.0, 1.0, 0.0)), t.get(TIE_POINT, (0.0,) * 6)
    return out, {"origin_x": tie[3] - tie[0] * scale[0], "origin_y": tie[4] + tie[1] * scale[1], "step_x": scale[0], "step_y": scale[1]}


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def geotiff_cells(spark: SparkSession, path: str) -> DataFrame:
    """dem_id (file name), row, col, elev of every pixel; no data is null."""

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f in frame.itertuples():
                z, _ = read_tiff(f.content)
                for r in range(0, len(z), 512):
                    part = z[r : r + 512]
                    rows, cols = np.indices(part.shape)
                    yield pd.DataFrame({"dem_id": f.path.rpartition("/")[2], "row": rows.ravel() + r, "col": cols.ravel(), "elev": part.ravel()})

    return _files(spark, path, "*.tif*").mapInPandas(cells, CELLS).withColumn("elev", F.nanvl("elev", F.lit(None).cast("double")))


def geotiff_headers(spark: SparkSession, path: str) -> DataFrame:
    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f in frame.itertuples():
                z, place = read_tiff(f.content)
                yield pd.DataFrame([{"dem_id": f.path.rpartition("/")[2], "height": z.shape[0], "width": z.shape[1], **place}])

    return _files(spark, path, "*.tif*").mapInPandas(heads, "dem_id string, height long, width long, origin_x double, origin_y double, step_x double, step_y double")
