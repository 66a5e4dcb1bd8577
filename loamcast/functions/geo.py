"""GeoJSON to WKB, and the bounds and type codes that prune geometry columns."""

from __future__ import annotations

import json
import math
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

_CODES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 7}
_AXES = ("xmin", "xmax", "ymin", "ymax", "zmin", "zmax", "mmin", "mmax")
_EXTENT = T.StructType([*(T.StructField(a, T.DoubleType()) for a in _AXES), T.StructField("codes", T.ArrayType(T.IntegerType()))])
_PART = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}


def _positions(g: dict):
    if g["type"] == "GeometryCollection":
        for x in g.get("geometries", []):
            yield from _positions(x)
        return
    todo = [g.get("coordinates", [])]
    while todo:
        c = todo.pop()
        if c and not isinstance(c[0], list):
            yield c
        else:
            todo.extend(reversed(c))


def dimensions(g: dict) -> int:
    """2, 3 or 4 coordinates a position; two where there are none."""
    return max((len(p) for p in _positions(g)), default=2)


def type_code(g: dict) -> int:
    """ISO code of a geometry's type: plus 1000 with z, plus 3000 with z and m."""
    if g.get("type") not in _CODES:
        raise ValueError(f"unknown geometry type: {g.get('type')}")
    return _CODES[g["type"]] + {2: 0, 3: 1000, 4: 3000}[min(dimensions(g), 4)]


def wkb(g: dict) -> bytes:
    """Little-endian ISO WKB of a GeoJSON geometry; parts of collections are typed one by one."""
    kind, n = g.get("type"), None
    head = struct.pack("<BI", 1, type_code(g))
    n = min(dimensions(g), 4)
    point = lambda p: struct.pack(f"<{n}d", *[*map(float, p), *[math.nan] * n][:n])
    line = lambda ps: struct.pack("<I", len(ps)) + b"".join(map(point, ps))
    if kind == "GeometryCollection":
        parts = g.get("geometries", [])
        return head + struct.pack("<I", len(parts)) + b"".join(map(wkb, parts))
    c = g.get("coordinates", [])
    if kind == "Point":
        return head + point(c)
    if kind == "LineString":
        return head + line(c)
    if kind == "Polygon":
        return head + struct.pack("<I", len(c)) + b"".join(map(line, c))
    return head + struct.pack("<I", len(c)) + b"".join(wkb({"type": _PART[kind], "coordinates": x}) for x in c)


@pandas_udf(T.BinaryType())
def geojson_wkb(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else wkb(json.loads(t)))


@pandas_udf(_EXTENT)
def geojson_extent(text: pd.Series) -> pd.DataFrame:
    """Bounds per axis (non-finite coordinates are passed over) and type codes of one geometry."""
    rows = []
    for t in text:
        ends, codes = [[None, None] for _ in range(4)], []
        if t is not None:
            g = json.loads(t)
            codes = [type_code(g)]
            for p in _positions(g):
                for axis, v in zip(ends, p, strict=False):
                    if isinstance(v, int | float) and math.isfinite(v):
                        axis[0] = v if axis[0] is None else min(axis[0], v)
                        axis[1] = v if axis[1] is None else max(axis[1], v)
        rows.append([*(None if v is None else float(v) for axis in ends for v in axis), codes])
    return pd.DataFrame(rows, columns=[*_AXES, "codes"])


def geometry_stats(df: DataFrame, geojson: Column, by: list[str]) -> DataFrame:
    """Bounding box and sorted type codes of each group of geometries; no box without x and y."""
    x = df.select(*by, geojson_extent(geojson).alias("g")).select(*by, "g.*")
    aggs = [(F.min if a.endswith("min") else F.max)(a).alias(a) for a in _AXES]
    codes = F.array_sort(F.array_distinct(F.flatten(F.collect_set("codes")))).alias("codes")
    boxed = F.col("xmin").isNotNull() & F.col("ymin").isNotNull()
    return x.groupBy(*by).agg(*aggs, codes).select(*by, *(F.when(boxed, F.col(a)).alias(a) for a in _AXES), "codes")
