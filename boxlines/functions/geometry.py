"""Column functions on boxes, points and polylines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(x: Column) -> Column:
    """Cuts the fraction off, towards zero."""
    return x.cast("long")


def box_overlap(x1: Column, y1: Column, w1: Column, h1: Column, x2: Column, y2: Column, w2: Column, h2: Column) -> Column:
    """Area that two boxes share."""
    zero = F.lit(0.0)
    across = F.greatest(zero, F.least(x1 + w1, x2 + w2) - F.greatest(x1, x2))
    return across * F.greatest(zero, F.least(y1 + h1, y2 + h2) - F.greatest(y1, y2))


def point_box_distance(px: Column, py: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """0 inside the box, else the distance to its edge."""
    dx = F.greatest(x - px, F.lit(0.0), px - (x + w))
    dy = F.greatest(y - py, F.lit(0.0), py - (y + h))
    return F.sqrt(dx * dx + dy * dy)


def point_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def polygon_area(points: Column) -> Column:
    """Shoelace area of array<struct<x, y>>, the last point joined to the first."""
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    twice = F.aggregate(F.zip_with(points, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, x: s + x)
    return F.abs(twice) / 2


def rings_in_box(rings: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Area that rings (what is inside lies left of them) share with a box. Along each edge, within the box's
    heights, the mean of how far x reaches into the box is taken times the height gone."""
    zero, wide = F.lit(0.0), x2 - x1
    reach = lambda x: F.greatest(zero, F.least(x - x1, wide))
    summed = lambda x: reach(x) * reach(x) / 2 + wide * F.greatest(zero, x - x2)  # the integral of reach
    held = lambda y: F.greatest(y1, F.least(y, y2))

    def edge(a: Column, b: Column) -> Column:
        rise = b["y"] - a["y"]
        at = lambda y: F.when(rise == 0, a["x"]).otherwise(a["x"] + (held(y) - a["y"]) / F.when(rise != 0, rise) * (b["x"] - a["x"]))
        return F.struct(at(a["y"]).alias("x"), at(b["y"]).alias("u"), (held(b["y"]) - held(a["y"])).alias("up"))

    def part(e: Column) -> Column:
        flat = F.abs(e["u"] - e["x"]) < 1e-6
        mean = F.when(flat, reach((e["x"] + e["u"]) / 2)).otherwise((summed(e["u"]) - summed(e["x"])) / F.when(~flat, e["u"] - e["x"]))
        return mean * e["up"]

    after = lambda ring: F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edges = F.flatten(F.transform(rings, lambda ring: F.zip_with(ring, after(ring), edge)))
    return F.aggregate(edges, zero, lambda total, e: total + part(e))


def _steps(path: Column) -> Column:
    n = F.size(path)
    return F.zip_with(F.slice(path, 1, n - 1), F.slice(path, 2, n), lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), b["x"].alias("u"), b["y"].alias("v"), F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])).alias("d")))


def path_length(path: Column) -> Column:
    """Number of points of a path."""
    return F.size(path).cast("long")


def path_midpoint(path: Column) -> Column:
    """The point (x, y) at half the length of a polyline, array<struct<x, y>>; of one point, that point. Its steps and
    half its length are held in an array of one, so that they are worked out once and not anew for each step."""
    half = lambda steps: F.aggregate(steps, F.lit(0.0), lambda s, e: s + e["d"]) / 2
    start = F.struct(F.lit(0.0).alias("gone"), F.get(path, F.lit(0))["x"].cast("double").alias("x"), F.get(path, F.lit(0))["y"].cast("double").alias("y"), F.lit(False).alias("done"))

    def step(half: Column, a: Column, e: Column) -> Column:
        here = ~a["done"] & (a["gone"] + e["d"] >= half) & (e["d"] > 0)
        t = (half - a["gone"]) / F.when(e["d"] > 0, e["d"]).otherwise(1.0)
        x = F.when(here, e["x"] + t * (e["u"] - e["x"])).otherwise(a["x"])
        y = F.when(here, e["y"] + t * (e["v"] - e["y"])).otherwise(a["y"])
        return F.struct((a["gone"] + e["d"]).alias("gone"), x.alias("x"), y.alias("y"), (a["done"] | here).alias("done"))

    measured = F.transform(F.array(_steps(path)), lambda steps: F.struct(steps.alias("steps"), half(steps).alias("half")))
    return F.get(F.transform(measured, lambda m: F.aggregate(m["steps"], start, lambda a, e: step(m["half"], a, e), lambda a: F.struct(a["x"], a["y"]))), F.lit(0))
