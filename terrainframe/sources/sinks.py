"""Sinks: tables as CSV, nested results as JSON lines, failed samples with their errors, GeoJSON shapes with parts and holes, text summaries.

All write one file a task; nothing passes through the driver but the lines of a summary, whose number the caller's grouping bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NESTED = ("array", "struct", "map")


def write_csv(df: DataFrame, path: str, geometry: str = "drop") -> None:
    """Plain columns as they are, with a header. Nested ones are dropped, or written as JSON text with ``geometry="text"``."""
    if geometry not in ("drop", "text"):
        raise ValueError("geometry is 'drop' or 'text'")
    nested = {c for c, kind in df.dtypes if kind.startswith(_NESTED)}
    kept = [c for c in df.columns if geometry == "text" or c not in nested]
    df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if c in nested else F.col(f"`{c}`") for c in kept]).write.option("header", True).option("escape", '"').csv(path)


def write_records(df: DataFrame, path: str, metadata: dict[str, Column] | None = None) -> None:
    """One JSON object a line, nulls kept; with ``metadata`` each holds it and the row under "result"."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    whole = row if metadata is None else F.struct(F.struct(*[v.alias(k) for k, v in metadata.items()]).alias("metadata"), row.alias("result"))
    df.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def failed(samples: DataFrame, errors: DataFrame, key: str = "id") -> DataFrame:
    """The samples that have errors ``(key, error_type, message)``, each with all of them in order; keys are compared as text."""
    told = errors.groupBy(F.col(key).cast("string").alias("_key")).agg(F.array_sort(F.collect_set(F.struct("error_type", "message"))).alias("errors"))
    return samples.withColumn("_key", F.col(key).cast("string")).join(told, "_key").drop("_key")


def shape_feature(rings: Column, properties: dict[str, Column]) -> Column:
    """A Feature as text: outer rings (counter-clockwise) are polygons, each with the holes that begin inside it; no rings, no geometry."""

    def signed(r: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda t, i: t + F.get(r, i - 1).x * F.get(r, i).y - F.get(r, i).x * F.get(r, i - 1).y)

    def holds(outer: Column, p: Column) -> Column:
        crosses = lambda i: ((F.get(outer, i - 1).y > p.y) != (F.get(outer, i).y > p.y)) & (
            p.x < F.get(outer, i - 1).x + F.try_divide((p.y - F.get(outer, i - 1).y) * (F.get(outer, i).x - F.get(outer, i - 1).x), F.get(outer, i).y - F.get(outer, i - 1).y)
        )
        return F.size(F.filter(F.sequence(F.lit(1), F.size(outer) - 1), crosses)) % 2 == 1

    middle = lambda r: F.struct(((r[0].x + r[1].x) / 2).alias("x"), ((r[0].y + r[1].y) / 2).alias("y"))
    pairs = lambda r: F.transform(r, lambda p: F.array(p.x, p.y))
    outer, inner = F.filter(rings, lambda r: signed(r) > 0), F.filter(rings, lambda r: signed(r) < 0)
    polygons = F.transform(outer, lambda o: F.concat(F.array(pairs(o)), F.transform(F.filter(inner, lambda h: holds(o, middle(h))), pairs)))
    geometry = F.when(F.size(rings) > 0, F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates")))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties")), {"ignoreNullFields": "false"})


def write_features(df: DataFrame, path: str, rings: str, properties: list[str]) -> None:
    """GeoJSON text sequences: one Feature a line."""
    df.select(shape_feature(F.col(rings), {p: F.col(f"`{p}`") for p in properties}).alias("value")).write.text(path)


def summary(title: str, grouped: DataFrame, most: int = 1000) -> str:
    """The first ``most`` rows of a grouped table as aligned text lines; a last line says so if there are more."""
    taken = grouped.limit(most + 1).collect()
    more, taken = len(taken) > most, taken[:most]
    rows = [[*map(str, grouped.columns)], *[["" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r] for r in taken]]
    wide = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))]
    return "\n".join([title, "=" * len(title), *("  ".join(x.ljust(w) for x, w in zip(r, wide, strict=True)).rstrip() for r in rows), *["..."] * more]) + "\n"


def points_from(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """``df`` with ``geometry``, a point of its longitude and latitude; null where one is missing."""
    x, y = F.col(f"`{lon}`").cast("double"), F.col(f"`{lat}`").cast("double")
    return df.withColumn("geometry", F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y"))))
