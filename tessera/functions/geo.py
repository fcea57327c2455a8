"""Geometry as arrays of points; all expressions stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    p = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return F.array(p(west, south), p(east, south), p(east, north), p(west, north), p(west, south))


def in_ring(r: Column, lon: Column, lat: Column) -> Column:
    """Crossing parity, or a point on an edge."""
    edges = F.arrays_zip(F.slice(r, 1, F.size(r) - 1).alias("a"), F.slice(r, 2, F.size(r) - 1).alias("b"))

    def crosses(e):
        a, b = e["a"], e["b"]
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"])

    parity = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(F.coalesce(crosses(e), F.lit(False)), 1).otherwise(0)) % 2 == 1
    return parity | on_ring(r, lon, lat)


def on_ring(r: Column, lon: Column, lat: Column) -> Column:
    """Whether a point lies on an edge."""
    edges = F.arrays_zip(F.slice(r, 1, F.size(r) - 1).alias("a"), F.slice(r, 2, F.size(r) - 1).alias("b"))

    def on(e):
        a, b = e["a"], e["b"]
        cross = (b["lon"] - a["lon"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lon - a["lon"])
        return (cross == 0) & lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))

    return F.exists(edges, on)


def ring_area(r: Column) -> Column:
    edges = F.arrays_zip(F.slice(r, 1, F.size(r) - 1).alias("a"), F.slice(r, 2, F.size(r) - 1).alias("b"))
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda s, e: s + e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"])) / 2


def largest_polygon(multipolygon: Column) -> Column:
    """Of polygons (arrays of rings) the one whose outer ring has the largest area, the first of equal ones."""
    def area(p):
        return F.coalesce(ring_area(F.get(p, F.lit(0))), F.lit(0.0))

    rest = F.slice(multipolygon, 2, F.size(multipolygon))
    return F.when(F.size(multipolygon) > 0, F.aggregate(rest, F.get(multipolygon, F.lit(0)), lambda best, p: F.when(area(p) > area(best), p).otherwise(best)))


def in_multipolygon(multipolygon: Column, lon: Column, lat: Column) -> Column:
    """Inside the outer ring of some polygon and in none of its holes; edges count as inside."""
    def inside(p):
        holes = F.slice(p, 2, F.size(p))
        return in_ring(F.get(p, F.lit(0)), lon, lat) & ~F.exists(holes, lambda h: in_ring(h, lon, lat) & ~on_ring(h, lon, lat))

    return F.exists(multipolygon, inside)


def mercator_path(r: Column, size: int = 320, pad: int = 24) -> Column:
    """SVG path of a ring in Mercator's projection, fitted and centred in a square; straight edges, 3 decimals."""
    radians = math.pi / 180
    xy = F.transform(r, lambda p: F.struct((p["lon"] * radians).alias("x"), (-F.log(F.tan(math.pi / 4 + p["lat"] * radians / 2))).alias("y")))

    def fitted(q):
        xs, ys = F.transform(q, lambda p: p["x"]), F.transform(q, lambda p: p["y"])
        room = float(size - 2 * pad)
        k = F.least(room / (F.array_max(xs) - F.array_min(xs)), room / (F.array_max(ys) - F.array_min(ys)))
        left = pad + (room - k * (F.array_max(xs) + F.array_min(xs))) / 2
        top = pad + (room - k * (F.array_max(ys) + F.array_min(ys))) / 2
        steps = F.transform(F.slice(q, 1, F.size(q) - 1), lambda p: F.format_string("%.3f,%.3f", k * p["x"] + left, k * p["y"] + top))
        return F.concat(F.lit("M"), F.array_join(steps, "L"), F.lit("Z"))

    return F.get(F.transform(F.array(xy), fitted), F.lit(0))


def label_point(r: Column) -> Column:
    lon, lat = F.transform(r, lambda p: p["lon"]), F.transform(r, lambda p: p["lat"])
    return F.struct(((F.array_min(lon) + F.array_max(lon)) / 2).alias("lon"), ((F.array_min(lat) + F.array_max(lat)) / 2).alias("lat"))
