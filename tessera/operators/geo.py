"""Points, distances and containment as columns. Points are [longitude, latitude] arrays, GeoJSON documents, or documents with two numbers."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_METRES = 6378100.0


def coordinates(column: Column, kind: T.DataType) -> tuple[Column, Column]:
    """The longitude and latitude of a point column."""
    if isinstance(kind, T.StructType):
        if "coordinates" in kind.names:
            return coordinates(column.getField("coordinates"), kind["coordinates"].dataType)
        return column.getField(kind.names[0]).cast("double"), column.getField(kind.names[1]).cast("double")
    return F.get(column, 0).cast("double"), F.get(column, 1).cast("double")


def sphere_distance(x: Column, y: Column, lon: float, lat: float) -> Column:
    """Radians between points of a sphere, by the haversine formula."""
    a, b = F.radians(y), math.radians(lat)
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * math.cos(b) * F.pow(F.sin((F.radians(x) - math.radians(lon)) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def plane_distance(x: Column, y: Column, at_x: float, at_y: float) -> Column:
    return F.sqrt(F.pow(x - at_x, 2) + F.pow(y - at_y, 2))


def in_ring(x: Column, y: Column, ring: Sequence[Sequence[float]]) -> Column:
    """Whether a ray to the right crosses the ring's edges an odd number of times, or the point lies on an edge."""
    edges = [(p, q) for p, q in zip(ring, [*ring[1:], ring[0]], strict=True) if tuple(p) != tuple(q)]
    crossings, on_edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in edges:
        if y1 != y2:
            crossings = crossings + F.when(((y < y1) != (y < y2)) & (x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)), 1).otherwise(0)
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        on_edge = on_edge | ((cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
    return on_edge | (crossings % 2 == 1)


def in_polygon(x: Column, y: Column, rings: Sequence[Sequence[Sequence[float]]]) -> Column:
    """Inside the first ring and outside the others, its holes."""
    out = in_ring(x, y, rings[0])
    for hole in rings[1:]:
        out = out & ~in_ring(x, y, hole)
    return out


def within(column: Column, kind: T.DataType, shape: dict) -> Column:
    x, y = coordinates(column, kind)
    if "$box" in shape:
        (x1, y1), (x2, y2) = shape["$box"]
        return x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2))
    if "$center" in shape:
        (cx, cy), radius = shape["$center"]
        return plane_distance(x, y, cx, cy) <= radius
    if "$centerSphere" in shape:
        (cx, cy), radius = shape["$centerSphere"]
        return sphere_distance(x, y, cx, cy) <= radius
    if "$polygon" in shape:
        return in_ring(x, y, shape["$polygon"])
    geometry = shape["$geometry"]
    if geometry["type"] == "Polygon":
        return in_polygon(x, y, geometry["coordinates"])
    if geometry["type"] == "MultiPolygon":
        return functools.reduce(lambda a, b: a | b, [in_polygon(x, y, p) for p in geometry["coordinates"]])
    raise ValueError(f"no containment in {geometry['type']}")


def intersects(column: Column, kind: T.DataType, shape: dict) -> Column:
    """Points meet a point, line or polygon that they lie in."""
    geometry = shape["$geometry"]
    x, y = coordinates(column, kind)
    if geometry["type"] == "Point":
        return (x == float(geometry["coordinates"][0])) & (y == float(geometry["coordinates"][1]))
    if geometry["type"] == "LineString":
        line = geometry["coordinates"]
        out = F.lit(False)
        for (x1, y1), (x2, y2) in zip(line, line[1:], strict=False):
            cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
            out = out | ((F.abs(cross) < 1e-12) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        return out
    return within(column, kind, shape)


def near(column: Column, kind: T.DataType, spec: dict | Sequence, sphere: bool, least: float | None = None, most: float | None = None) -> tuple[Column, Column]:
    """The filter of a distance and the distance to order by: metres to a GeoJSON point, else radians or units."""
    x, y = coordinates(column, kind)
    if isinstance(spec, dict) and "$geometry" in spec:
        lon, lat = spec["$geometry"]["coordinates"]
        least, most = spec.get("$minDistance", least), spec.get("$maxDistance", most)
        distance = sphere_distance(x, y, lon, lat) * EARTH_METRES
    else:
        lon, lat = spec
        distance = sphere_distance(x, y, lon, lat) if sphere else plane_distance(x, y, lon, lat)
    keep = distance.isNotNull()
    keep = keep & (distance >= least) if least is not None else keep
    return (keep & (distance <= most) if most is not None else keep), distance
