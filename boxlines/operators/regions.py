"""Detections on tiles to regions on images: stitching, overlap suppression, merging and routing.

Tables are keyed by diagram_id; coordinates are percent unless said otherwise."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box_overlap, polygon_area, whole
from .grid import box_pairs
from .grouped import per_group
from .stages import bounded_batches

BORDER = 10
# fixed values: which labels compete with each other
GROUPS = {
    "End Shape": ("Arrow End", "Crossing", "Empty Diamond End", "Filled Diamond End", "Triangle End"),
    "Class Text": ("Stereotype", "Name", "Property", "Package", "Other"),
    "UML Rectangle": ("Class", "Struck Class", "Note"),
}


def stitch_rectangles(regions: DataFrame) -> DataFrame:
    """Percent of the tile to percent of the image (offset_px_*, tile_*, image_* columns)."""
    across, down = F.col("tile_width") / F.col("image_width"), F.col("tile_height") / F.col("image_height")
    return regions.withColumns(
        {
            "x": F.col("x") * across + F.col("offset_px_x") / F.col("image_width") * 100,
            "y": F.col("y") * down + F.col("offset_px_y") / F.col("image_height") * 100,
            "width": F.col("width") * across,
            "height": F.col("height") * down,
        }
    )


def drop_tile_edge_detections(regions: DataFrame) -> DataFrame:
    """Stitches, and drops boxes within 10 px of a tile's border but not of that border of the image. The
    lower border of the image is looked for with the tile's height, as the detections were made."""
    tile = lambda a, size: a * F.col(size) / 100
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    at_tile = {
        "left": tile(x, "tile_width") < BORDER,
        "right": tile(x + w, "tile_width") > F.col("tile_width") - BORDER,
        "top": tile(y, "tile_height") < BORDER,
        "bottom": tile(y + h, "tile_height") > F.col("tile_height") - BORDER,
    }
    out = stitch_rectangles(regions.withColumns({f"__{k}": v for k, v in at_tile.items()}))
    at_image = {
        "left": tile(x, "image_width") < BORDER,
        "right": tile(x + w, "image_width") > F.col("image_width") - BORDER,
        "top": tile(y, "image_height") < BORDER,
        "bottom": tile(y + h, "tile_height") > F.col("image_height") - BORDER,
    }
    cut = F.lit(False)
    for k, v in at_image.items():
        cut = cut | F.col(f"__{k}") & ~v
    return out.where(~cut).drop(*(f"__{k}" for k in at_tile))


def stitch_polygons(regions: DataFrame) -> DataFrame:
    """As stitch_rectangles, for each of points (array<struct<x, y>>)."""
    across, down = F.col("tile_width") / F.col("image_width"), F.col("tile_height") / F.col("image_height")
    moved = lambda p: F.struct((p["x"] * across + F.col("offset_px_x") / F.col("image_width") * 100).alias("x"), (p["y"] * down + F.col("offset_px_y") / F.col("image_height") * 100).alias("y"))
    return regions.withColumn("points", F.transform("points", moved))


def tile_position_id(regions: DataFrame) -> DataFrame:
    """Adds id, `ox,oy WxH n`, n numbering a tile's detections by region_id from 1."""
    by = Window.partitionBy("diagram_id", "offset_px_x", "offset_px_y", "tile_width", "tile_height").orderBy("region_id")
    return regions.withColumn("id", F.format_string("%d,%d %dx%d %d", "offset_px_x", "offset_px_y", "tile_width", "tile_height", F.row_number().over(by)))


def label_group(label: Column) -> Column:
    out = label
    for group, labels in GROUPS.items():
        out = F.when(label.isin(*labels), group).otherwise(out)
    return out


def overlap_pairs(regions: DataFrame) -> DataFrame:
    """(diagram_id, region_a, region_b, overlap, ratio) of boxes of one group that share some area, the
    ratio being to the smaller of the two."""
    r = regions.withColumn("label_group", label_group(F.col("label")))
    a, b = (r.select("diagram_id", "label_group", *(F.col(c).alias(f"{c}_{s}") for c in ("region_id", "x", "y", "width", "height"))) for s in "ab")
    boxes = [F.col(f"{c}_{s}") for s in "ab" for c in ("x", "y", "width", "height")]
    pairs = a.join(b, ["diagram_id", "label_group"]).where("region_id_a < region_id_b").withColumn("overlap", box_overlap(*boxes)).where("overlap > 0")
    smaller = F.least(F.col("width_a") * F.col("height_a"), F.col("width_b") * F.col("height_b"))
    return pairs.select("diagram_id", F.col("region_id_a").alias("region_a"), F.col("region_id_b").alias("region_b"), "overlap", (F.col("overlap") / smaller).alias("ratio"))


def suppress_overlaps(regions: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Of boxes of one group that overlap by more than threshold of the smaller one, the worse goes.

    A group's boxes come by x, ties by region_id. Each meets the boxes still held, in their order, and stops
    at the first that beats it; on equal scores the later one stays. Held boxes that end left of it are
    let go. The order decides, so a group (diagram, labels) is one task's work: it is bounded by an image."""
    grouped = regions.withColumn("__group", label_group(F.col("label")))

    def sweep(_: tuple, rows: list[tuple]) -> list[tuple]:
        rows = sorted(rows, key=lambda r: (r[0], r[1]))
        boxes = [(x, *r) for x, _, *r, _ in rows]
        held: list[int] = []
        gone: set[int] = set()
        for i, (x, y, w, h, score) in enumerate(boxes):
            still, beaten = [], False
            for j in held:
                u, v, p, q, other = boxes[j]
                if beaten:
                    still.append(j)
                elif u + p >= x:
                    shared = max(0.0, min(x + w, u + p) - max(x, u)) * max(0.0, min(y + h, v + q) - max(y, v))
                    clash = shared > 0 and shared / min(w * h, p * q) > threshold
                    if clash and score >= other:
                        gone.add(j)
                    else:
                        still.append(j)
                        beaten = clash
            held = still if beaten else [*still, i]
            if beaten:
                gone.add(i)
        return [(rows[i][-1],) for i in range(len(boxes)) if i not in gone]

    rest = [c for c in regions.columns if c != "diagram_id"]
    row = grouped.withColumn("__row", F.struct(*rest))
    kept = per_group([(row, ("x", "region_id", "y", "width", "height", "score", "__row"))], ("diagram_id", "__group"), sweep, f"__row {row.schema['__row'].dataType.simpleString()}")
    return kept.select(*(F.col(f"__row.`{c}`").alias(c) if c in rest else F.col(c) for c in regions.columns))


def split_loops(points: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """Cuts a ring at each vertex that comes again; what runs between becomes a ring of its own."""
    rings, todo = [], [list(points)]
    while todo:
        ring = todo.pop(0)
        while True:
            seen: dict[tuple[float, float], int] = {}
            again = next(((seen[p], i) for i, p in enumerate(ring) if p in seen or seen.setdefault(p, i) != i), None)
            if again is None or again[1] - again[0] + 1 == len(ring):
                break
            todo.append(ring[again[0] : again[1] + 1])
            ring = ring[: again[0] + 1] + ring[again[1] + 1 :]
        rings.append(ring)
    return rings


def loops(polygons: DataFrame) -> DataFrame:
    """A row for each ring of at least four points: part (from 0) and points."""
    point = "array<struct<x:double,y:double>>"

    @F.pandas_udf(f"array<struct<part:int,points:{point}>>")
    def cut(all_points: pd.Series) -> pd.Series:
        def one(points) -> list[dict]:
            rings = split_loops([(p["x"], p["y"]) for p in points])
            return [{"part": i, "points": [{"x": x, "y": y} for x, y in r]} for i, r in enumerate(rings) if len(r) >= 4]

        return all_points.map(one)

    return bounded_batches(polygons).withColumn("__ring", F.explode(cut("points"))).withColumn("part", F.col("__ring.part").cast("long")).withColumn("points", F.col("__ring.points")).drop("__ring")


def clean_polygons(polygons: DataFrame, least_area: float = 0.1) -> DataFrame:
    """Drops points that repeat the one before them, and polygons of no more than least_area."""
    same = lambda p, i: (i > 0) & (F.get("points", i - 1)["x"] == p["x"]) & (F.get("points", i - 1)["y"] == p["y"])
    out = polygons.withColumn("points", F.filter("points", lambda p, i: ~same(p, i)))
    return out.withColumn("area", polygon_area(F.col("points"))).where(F.col("area") > least_area)


def rectangle_overlaps(polygons: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(diagram_id, a, b, overlap) for axis-parallel boxes (x1, y1, x2, y2) whose shared area is at least
    threshold of the smaller one."""
    a, b = (polygons.select("diagram_id", F.col("region_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("x1", "y1", "x2", "y2"))) for s in "ab")
    w = F.greatest(F.lit(0.0), F.least("x2_a", "x2_b") - F.greatest("x1_a", "x1_b"))
    h = F.greatest(F.lit(0.0), F.least("y2_a", "y2_b") - F.greatest("y1_a", "y1_b"))
    area = lambda s: (F.col(f"x2_{s}") - F.col(f"x1_{s}")) * (F.col(f"y2_{s}") - F.col(f"y1_{s}"))
    bounds = lambda s: tuple(F.col(f"{c}_{s}") for c in ("x1", "y1", "x2", "y2"))
    pairs = box_pairs(a, b, bounds("a"), bounds("b")).where("a < b")
    return pairs.withColumn("overlap", w * h / (F.least(area("a"), area("b")) + 1e-6)).where(F.col("overlap") >= threshold).select("diagram_id", "a", "b", "overlap")


def merge_regions(polygons: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(diagram_id, region_id, merged_id): polygons tied by overlaps carry the least id among them. Ties
    never leave a diagram, so its pairs are united in one task."""
    pairs = rectangle_overlaps(polygons, threshold)
    edges = polygons.select("diagram_id", F.col("region_id").alias("a"), F.col("region_id").alias("b")).unionByName(pairs.select("diagram_id", "a", "b"))

    def unite(_: tuple, rows: list[tuple]) -> list[tuple]:
        root: dict[int, int] = {i: i for row in rows for i in row}

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b in rows:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return [(i, find(i)) for i in sorted(root)]

    return per_group([(edges, ("a", "b"))], ("diagram_id",), unite, "region_id long, merged_id long")


def merged_boxes(polygons: DataFrame, merged: DataFrame) -> DataFrame:
    """Per merged region: bounds, members and score. The score is weighed by area in the order of ids, the
    area so far being that of the union of the members' boxes."""

    def united(rects: list[tuple[float, float, float, float]]) -> float:
        xs = sorted({x for r in rects for x in (r[0], r[2])})
        area = 0.0
        for a, b in zip(xs, xs[1:], strict=False):
            end = -math.inf
            for y1, y2 in sorted((r[1], r[3]) for r in rects if r[0] <= a and r[2] >= b):
                area += max(0.0, y2 - max(y1, end)) * (b - a)
                end = max(end, y2)
        return area

    def fold(_: tuple, rows: list[tuple]) -> list[tuple]:
        rows = sorted(rows)
        rects, score = [r[1:5] for r in rows], rows[0][5]
        for i in range(1, len(rects)):
            so_far, own = united(rects[:i]), united(rects[i : i + 1])
            score = (score * so_far + rows[i][5] * own) / (so_far + own)
        x1, y1, x2, y2 = zip(*rects, strict=True)
        return [(len(rects), min(x1), min(y1), max(x2), max(y2), score)]

    joined = polygons.join(merged, ["diagram_id", "region_id"])
    return per_group([(joined, ("region_id", "x1", "y1", "x2", "y2", "score"))], ("diagram_id", "merged_id"), fold, "n_members long, x1 double, y1 double, x2 double, y2 double, score double")


def stretch_filter(boxes: DataFrame, least: float = 2.0) -> DataFrame:
    """Keeps regions whose bounds' diagonal is over least."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.where(F.sqrt(w * w + h * h) > least)


def stitch_predictions(regions: DataFrame, remove_edges: bool = True, threshold: float = 0.3) -> DataFrame:
    """Stitched, suppressed and numbered by falling score."""
    placed = drop_tile_edge_detections(regions) if remove_edges else stitch_rectangles(regions)
    kept = suppress_overlaps(placed, threshold)
    return kept.withColumn("position", (F.row_number().over(Window.partitionBy("diagram_id").orderBy(F.col("score").desc(), "region_id"))).cast("long"))


def class_boxes(regions: DataFrame) -> DataFrame:
    """(diagram_id, class_index, x, y, w, h) in pixels, numbered by falling score."""
    by = Window.partitionBy("diagram_id").orderBy(F.col("score").desc(), "region_id")
    px = lambda c, size: F.col(c) / 100 * F.col(size)
    return regions.where("label = 'Class'").select("diagram_id", (F.row_number().over(by) - 1).cast("long").alias("class_index"), px("x", "image_width").alias("x"), px("y", "image_height").alias("y"), px("width", "image_width").alias("w"), px("height", "image_height").alias("h"))


def drop_inside_classes(polygons: DataFrame, rectangles: DataFrame, share: float = 0.95) -> DataFrame:
    """Drops boxes (x1, y1, x2, y2) of which `share` or more lies in one of the diagram's rectangles."""
    r = rectangles.select("diagram_id", *(F.col(c).alias(f"r_{c}") for c in ("x", "y", "w", "h")))
    inside = box_overlap(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), *(F.col(f"r_{c}") for c in ("x", "y", "w", "h")))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    covered = polygons.join(r, "diagram_id").where(inside / area >= share).select("diagram_id", "region_id").distinct()
    return polygons.join(covered, ["diagram_id", "region_id"], "left_anti")


def route_endpoints(regions: DataFrame, least: float = 0.5) -> DataFrame:
    """(diagram_id, region_id, route, px, py, ...): centres of empty ends, crossings, and end shapes of a
    known label and of score `least` or more."""
    shapes = [x for x in GROUPS["End Shape"] if x != "Crossing"]
    route = F.when(F.col("label") == "Empty End", "endpoint").when(F.col("label") == "Crossing", "crossing").when(F.col("label").isin(*shapes) & (F.col("score") >= least), "end_shape")
    at = lambda a, b: F.when(route == "endpoint", F.col(a) + F.col(b) / 2).otherwise(F.col(a))
    return regions.withColumn("route", route).where("route IS NOT NULL").withColumns({"px": at("x", "width"), "py": at("y", "height")})


def route_labels(regions: DataFrame) -> DataFrame:
    """(.. x1, y1, x2, y2) of multiplicities and relationship labels."""
    some = regions.where(F.col("label").isin("Multiplicity", "Relationship label"))
    return some.select("diagram_id", "region_id", F.col("label").alias("kind"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("height")).alias("y2"), "score")


def scale_factor(boxes: DataFrame) -> DataFrame:
    """(diagram_id, scale): the median width plus the median height of class boxes, over 200."""
    return boxes.groupBy("diagram_id").agg(((F.median("w") + F.median("h")) / 200).alias("scale"))


def region_pixel_box(regions: DataFrame, cut: int = 3) -> DataFrame:
    """Percent boxes to pixel boxes drawn in by `cut`, within the image; negative ones go."""
    start = lambda c, size: whole(F.col(c) / 100 * F.col(size)) + cut
    x, y = start("x", "image_width"), start("y", "image_height")
    w, h = whole(F.col("width") / 100 * F.col("image_width")) - 2 * cut, whole(F.col("height") / 100 * F.col("image_height")) - 2 * cut
    out = regions.select("diagram_id", "region_id", F.greatest(x, F.lit(0)).alias("x_start"), F.greatest(y, F.lit(0)).alias("y_start"), F.least(x + w, F.col("image_width")).alias("x_end"), F.least(y + h, F.col("image_height")).alias("y_end"))
    return out.where("x_end >= x_start AND y_end >= y_start")


def crop_boxes(regions: DataFrame) -> DataFrame:
    """Pixel crops of percent boxes; empty ones go."""
    a = regions.select("diagram_id", "region_id", whole(F.col("x") / 100 * F.col("image_width")).alias("x1"), whole(F.col("y") / 100 * F.col("image_height")).alias("y1"), "width", "height", "image_width", "image_height")
    b = a.select("diagram_id", "region_id", "x1", "y1", whole(F.col("x1") + F.col("width") / 100 * F.col("image_width")).alias("x2"), whole(F.col("y1") + F.col("height") / 100 * F.col("image_height")).alias("y2"))
    return b.where("x2 > x1 AND y2 > y1")
