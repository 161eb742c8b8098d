"""Line ends: removing doubles, attaching to classes, and end shapes.

Distances are in pixels; limits are scaled by the diagram's scale and rounded to three places. Tables:
endpoints (diagram_id, endpoint_id, x, y), class boxes (diagram_id, class_index, x, y, w, h), scales
(diagram_id, scale). Diagrams without class boxes or scale have no attached endpoints."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import point_box_distance, point_distance
from .grid import box_pairs, nearest_points
from .grouped import per_group
from .stages import written

EMPTY = "Empty End"


def nearest_class(endpoints: DataFrame, boxes: DataFrame) -> DataFrame:
    """(diagram_id, endpoint_id, class_index, class_distance), the first index on ties."""
    b = boxes.select("diagram_id", "class_index", *(F.col(c).alias(f"b{c}") for c in "xywh"))
    d = point_box_distance(*(F.col(c) for c in ("x", "y", "bx", "by", "bw", "bh")))
    near = endpoints.join(b, "diagram_id").select("diagram_id", "endpoint_id", F.struct(d.alias("d"), F.col("class_index").alias("i")).alias("s"))
    return near.groupBy("diagram_id", "endpoint_id").agg(F.min("s").alias("s")).select("diagram_id", "endpoint_id", F.col("s.i").alias("class_index"), F.col("s.d").alias("class_distance"))


def nearest_endpoint(endpoints: DataFrame) -> DataFrame:
    """(diagram_id, endpoint_id, other_id, other_distance), the first id on ties; a lone endpoint has none."""
    return nearest_points(endpoints, "endpoint_id")


def _box_distance(x: np.ndarray, y: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Least point_box_distance of each point to the boxes (x, y, w, h), a million pairs at a time."""
    least, some = np.zeros(len(x)), max(1, (1 << 20) // len(boxes))
    bx, by, bw, bh = boxes.T
    for i in range(0, len(x), some):
        px, py = x[i : i + some, None], y[i : i + some, None]
        dx, dy = np.maximum(np.maximum(bx - px, 0.0), px - (bx + bw)), np.maximum(np.maximum(by - py, 0.0), py - (by + bh))
        least[i : i + some] = np.sqrt(dx * dx + dy * dy).min(axis=1)
    return least


def _thinned(x: np.ndarray, y: np.ndarray, near: np.ndarray, limit: float) -> np.ndarray:
    """Which of the points, in order, stay; those that may be too near each other are looked up first."""
    alive, some = np.ones(len(x), dtype=bool), max(1, (1 << 20) // max(1, len(x)))
    for k in range(0, len(x), some):
        dx, dy = x[k : k + some, None] - x, y[k : k + some, None] - y
        close = dx * dx + dy * dy <= limit * limit * (1 + 1e-9)
        for i in (np.flatnonzero(close.sum(axis=1) > 1) + k).tolist():
            if not alive[i]:
                continue
            for j in (np.flatnonzero(close[i - k, i + 1 :] & alive[i + 1 :]) + i + 1).tolist():
                if math.hypot(x[i] - x[j], y[i] - y[j]) < limit:
                    alive[j if near[i] <= near[j] else i] = False
                    if not alive[i]:
                        break
    return alive


def dedupe_endpoints(endpoints: DataFrame, boxes: DataFrame, scales: DataFrame, reach: float = 5.0) -> DataFrame:
    """Of two endpoints nearer than reach times the scale, the one nearer to a class stays, the earlier on
    ties. Endpoints are taken in order of their ids, each against all later ones; when the one in hand goes,
    the next in its place is taken. Decided within a diagram, in order, beside its class boxes."""

    def drop(_: tuple, rows: list[tuple], classes: list[tuple], scale: list[tuple]) -> list[tuple]:
        if not (rows and classes and scale) or scale[0][0] is None:
            return []
        rows = sorted(rows)
        x, y = np.array([r[1:] for r in rows], dtype=float).T
        near = _box_distance(x, y, np.array(classes, dtype=float))
        return [r for r, stays in zip(rows, _thinned(x, y, near, round(reach * scale[0][0], 3)).tolist(), strict=True) if stays]

    return per_group([(endpoints, ("endpoint_id", "x", "y")), (boxes, ("x", "y", "w", "h")), (scales, ("scale",))], ("diagram_id",), drop, "endpoint_id long, x double, y double")


def attachment(endpoints: DataFrame, boxes: DataFrame, scales: DataFrame) -> DataFrame:
    """Endpoints that attach (diagram_id, endpoint_id, how, class_index, other_id): to a class that is near
    enough, or else with the nearest endpoint in a gap. Only what lies within reach is compared. Of diagrams
    without class boxes, and of a lone endpoint, none attach. What can attach, and the classes that it meets, are
    written first: box_pairs has each of its sides three times, and two of them in one plan are a hundred nodes."""
    keys = ["diagram_id", "endpoint_id"]
    paired = endpoints.groupBy("diagram_id").agg(F.count("*").alias("n")).where("n > 1").select("diagram_id")
    some = endpoints.select(*keys, "x", "y").join(scales, "diagram_id").join(paired, "diagram_id").join(boxes.select("diagram_id").distinct(), "diagram_id")
    some = written(some, "paired")
    reach = lambda least: F.bround(least * F.col("scale"), 3)
    around = lambda r: (F.col("x") - r, F.col("y") - r, F.col("x") + r, F.col("y") + r)

    b = boxes.select("diagram_id", "class_index", *(F.col(c).alias(f"b{c}") for c in "xywh"))
    met = box_pairs(some, b, around(reach(10)), (F.col("bx"), F.col("by"), F.col("bx") + F.col("bw"), F.col("by") + F.col("bh")))
    d = point_box_distance(*(F.col(c) for c in ("x", "y", "bx", "by", "bw", "bh")))
    classes = written(met.withColumn("d", d).where(F.col("d") < reach(10)).groupBy(*keys).agg(F.min(F.struct("d", "class_index")).alias("c")), "near_classes")

    o = some.select("diagram_id", F.col("endpoint_id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    met = box_pairs(some, o, around(reach(15)), (F.col("ox"), F.col("oy"), F.col("ox"), F.col("oy"))).where("endpoint_id <> o")
    d = point_distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"))
    others = met.withColumn("d", d).where(F.col("d") < reach(15)).groupBy(*keys).agg(F.min(F.struct("d", "o")).alias("n"))

    near = classes.join(others, keys, "full_outer")
    how = F.when(F.col("c").isNotNull(), "class").otherwise("gap")
    return near.select(*keys, how.alias("how"), F.col("c.class_index").alias("class_index"), F.col("n.o").alias("other_id"))


def attach_endpoints(endpoints: DataFrame, boxes: DataFrame, scales: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(diagram_id, endpoint_id, class_index, position): endpoints that belong to a class or, with a null
    class, to a gap between two endpoints. Positions (from 0) follow the first step that adds an endpoint:
    its own, or that of the endpoint whose nearest it is, own before partner. near: their attachment, if it
    is there already."""
    near = written(attachment(endpoints, boxes, scales), "attachment") if near is None else near
    own = near.select("diagram_id", "endpoint_id", F.col("endpoint_id").alias("step"), F.lit(0).alias("partner"), F.when(F.col("how") == "class", F.col("class_index")).alias("class_index"))
    partner = near.where("how = 'gap'").select("diagram_id", F.col("other_id").alias("endpoint_id"), F.col("endpoint_id").alias("step"), F.lit(1).alias("partner"), F.lit(None).cast("long").alias("class_index"))
    kept = own.unionByName(partner).groupBy("diagram_id", "endpoint_id").agg(F.min(F.struct("step", "partner")).alias("first"), F.max("class_index").alias("class_index"))
    by = Window.partitionBy("diagram_id").orderBy("first")
    return kept.select("diagram_id", "endpoint_id", "class_index", (F.row_number().over(by) - 1).cast("long").alias("position"))


def gap_pairs(endpoints: DataFrame, boxes: DataFrame, scales: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(diagram_id, a, b): each pair of an endpoint in a gap and its nearest once, as first found. near: their
    attachment, if it is there already."""
    near = (attachment(endpoints, boxes, scales) if near is None else near).where("how = 'gap'")
    pair = F.struct(F.col("endpoint_id").alias("a"), F.col("other_id").alias("b"))
    key = [F.least("endpoint_id", "other_id").alias("lo"), F.greatest("endpoint_id", "other_id").alias("hi")]
    return near.groupBy("diagram_id", *key).agg(F.min(pair).alias("p")).select("diagram_id", "p.a", "p.b")


def end_shape_mapping(endpoints: DataFrame, shapes: DataFrame, scales: DataFrame) -> DataFrame:
    """(diagram_id, endpoint_id, end_shape, shape_score): a shape within reach of its nearest endpoint goes
    to it and to all within 1.2 times that distance; the last shape of several stays."""
    s = shapes.select("diagram_id", "shape_index", *(F.col(c).alias(f"s{c}") for c in "xywh"), "label", "score")
    d = point_box_distance(*(F.col(c) for c in ("x", "y", "sx", "sy", "sw", "sh")))
    near = endpoints.join(s, "diagram_id").withColumn("d", d).withColumn("least", F.min("d").over(Window.partitionBy("diagram_id", "shape_index")))
    hit = near.join(scales, "diagram_id").where((F.col("least") <= F.bround(10 * F.col("scale"), 3)) & (F.col("d") <= 1.2 * F.col("least")))
    last = hit.groupBy("diagram_id", "endpoint_id").agg(F.max(F.struct("shape_index", "label", "score")).alias("s"))
    out = endpoints.select("diagram_id", "endpoint_id").join(last, ["diagram_id", "endpoint_id"], "left")
    return out.select("diagram_id", "endpoint_id", F.coalesce("s.label", F.lit(EMPTY)).alias("end_shape"), F.coalesce("s.score", F.lit(1.0)).alias("shape_score"))
