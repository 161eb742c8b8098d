"""Outlines of any shape: repair, shared area, merging, and what lies inside of boxes.

`points` is array<struct<x, y>>; `rings` an array of such arrays, an outer ring and its holes, as `clean_outlines`
gives them. Pairs are found by bounds, within a diagram."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import outlines
from ..functions.geometry import rings_in_box
from .grid import box_pairs
from .grouped import per_batch
from .regions import drop_tile_edge_detections, label_group, loops, stitch_polygons, stitch_rectangles, suppress_overlaps, tile_position_id
from .stages import bounded_batches

POINTS = "array<struct<x:double,y:double>>"


def _plain(rings) -> list[outlines.Ring]:
    return [[(p["x"], p["y"]) for p in ring] for ring in rings]


def _rows(ring: outlines.Ring) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in ring]


def _bounds(rings: Column) -> dict[str, Column]:
    at = lambda f, c: f(F.transform(F.get(rings, F.lit(0)), lambda p: p[c]))
    return {"x1": at(F.array_min, "x"), "y1": at(F.array_min, "y"), "x2": at(F.array_max, "x"), "y2": at(F.array_max, "y")}


def clean_outlines(polygons: DataFrame, least_area: float = 0.1) -> DataFrame:
    """A row for each part (piece, from 0, by falling area) of each repaired outline of more than least_area in
    all; points become those of its outer ring, rings and area are the part's. Null or flat outlines go."""

    @F.pandas_udf(f"array<struct<rings:array<{POINTS}>,area:double>>")
    def repaired(points: pd.Series) -> pd.Series:
        def told(made: list[list[outlines.Ring]]) -> list[dict]:
            sizes = [outlines.area(p) for p in made]
            return [{"rings": [_rows(r) for r in p], "area": a} for p, a in zip(made, sizes, strict=True)] if sum(sizes) > least_area else []

        return pd.Series([told(x) for x in outlines.repairs([[] if ring is None else _plain([ring])[0] for ring in points])], index=points.index, dtype=object)

    made = bounded_batches(polygons).select(*(c for c in polygons.columns if c not in ("piece", "rings", "area")), F.posexplode(repaired("points")).alias("piece", "__part"))
    made = made.withColumn("piece", F.col("piece").cast("long")).withColumn("rings", F.col("__part.rings")).withColumn("area", F.col("__part.area"))
    return made.withColumn("points", F.get("rings", F.lit(0))).drop("__part")


def outline_overlaps(outlined: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(diagram_id, a, b, overlap): pairs of outlines (region_id, rings, area) that share at least threshold of
    the smaller one's area."""
    placed = outlined.select("diagram_id", "region_id", "rings", "area").withColumns(_bounds(F.col("rings")))
    a, b = (placed.select("diagram_id", *(F.col(c).alias(f"{c}_{s}") for c in placed.columns if c != "diagram_id")) for s in "ab")
    bounds = lambda s: tuple(F.col(f"{c}_{s}") for c in ("x1", "y1", "x2", "y2"))

    @F.pandas_udf("double")
    def shared(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(outlines.shared_areas([(_plain(p), _plain(q)) for p, q in zip(left, right, strict=True)]), index=left.index, dtype=float)

    pairs = box_pairs(bounded_batches(a), b, bounds("a"), bounds("b")).where("region_id_a < region_id_b")
    pairs = pairs.withColumn("overlap", shared("rings_a", "rings_b") / (F.least("area_a", "area_b") + 1e-6))
    return pairs.where(F.col("overlap") >= threshold).select("diagram_id", F.col("region_id_a").alias("a"), F.col("region_id_b").alias("b"), "overlap")


def merge_outlines(outlined: DataFrame, threshold: float = 0.1, least: float = 2.0, tolerance: float = 0.03) -> DataFrame:
    """Outlines (region_id, score, rings) tied by overlaps, as one: (diagram_id, region_id, n_members, score,
    points, rings, area). The least region_id names it; the score is weighed by area in the order of ids, the
    area so far being that of the union; points are the simplified outer ring of its largest part. Those go
    whose points' bounds have a diagonal of no more than least; where a column bounds (x1, y1, x2, y2) tells each
    outline's as they were before points were held to nine places, a side is as long as those say. Many diagrams are worked out at a time: which
    bounds meet is told by sweeping each diagram's by their left sides, areas and unions of all of them in one
    go, a union a member of each region in turn."""

    def meeting(bounds: list[tuple]) -> list[tuple[int, int]]:
        held, out = [], []
        for i in sorted(range(len(bounds)), key=lambda k: bounds[k][0]):
            held = [j for j in held if bounds[j][2] >= bounds[i][0]]
            out += [(i, j) for j in held if bounds[j][1] <= bounds[i][3] and bounds[i][1] <= bounds[j][3]]
            held.append(i)
        return out

    def sides(points: outlines.Ring, told: list) -> tuple[float, float]:
        x, y = zip(*points, strict=True)
        ends = []
        for c, least_of, held in (("x1", min, min(x)), ("y1", min, min(y)), ("x2", max, max(x)), ("y2", max, max(y))):
            ends.append(least_of([b[c] for b in told if round(b[c], outlines.PLACES) == held], default=held))
        return ends[2] - ends[0], ends[3] - ends[1]

    def merge(diagrams: list[tuple]) -> list[tuple]:
        rows, keys, pairs = [], [], []
        for key, some in diagrams:
            some = sorted(some, key=lambda r: r[0])
            bounds = [(min(x), min(y), max(x), max(y)) for x, y in (zip(*((p["x"], p["y"]) for p in r[2][0]), strict=True) for r in some)]
            pairs += [(len(rows) + i, len(rows) + j) for i, j in meeting(bounds)]
            rows += some
            keys += [key] * len(some)
        rings = [_plain(r[2]) for r in rows]
        sizes = [outlines.area(r) for r in rings]
        root = list(range(len(rows)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for (i, j), inter in zip(pairs, outlines.shared_areas([(rings[i], rings[j]) for i, j in pairs]), strict=True):
            if inter / (min(sizes[i], sizes[j]) + 1e-6) >= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
        members: dict[int, list[int]] = {}
        for i in range(len(rows)):
            members.setdefault(find(i), []).append(i)
        whole, size, score = ({i: x[i] for i in members} for x in (rings, sizes, [r[1] for r in rows]))
        for k in range(1, max(map(len, members.values()), default=1)):
            growing = [(first, of[k]) for first, of in members.items() if len(of) > k]
            for (first, i), made in zip(growing, outlines.unions([(whole[first], rings[i]) for first, i in growing]), strict=True):
                score[first] = (score[first] * size[first] + rows[i][1] * sizes[i]) / (size[first] + sizes[i])
                whole[first], size[first] = made, outlines.area(made)
        out = []
        for (first, of), points in zip(members.items(), outlines.simplified([outlines.parts(whole[i])[0][0] for i in members], tolerance), strict=True):
            w, h = sides(points, [rows[i][3] for i in of if len(rows[i]) > 3])
            if math.sqrt(w * w + h * h) > least:
                out.append((*keys[first], rows[first][0], len(of), score[first], _rows(points), [_rows(r) for r in whole[first]], size[first]))
        return out

    columns = ("region_id", "score", "rings", *(c for c in ("bounds",) if c in outlined.columns))
    return per_batch([(outlined, columns)], ("diagram_id",), merge, f"region_id long, n_members long, score double, points {POINTS}, rings array<{POINTS}>, area double")


def drop_outlines_inside(outlined: DataFrame, rectangles: DataFrame, share: float = 0.95) -> DataFrame:
    """Drops outlines (region_id, rings, area) of which `share` or more lies in one of the diagram's rectangles
    (x, y, w, h). No Python: the area inside of a rectangle is summed along the rings."""
    r = rectangles.select("diagram_id", *(F.col(c).alias(f"r_{c}") for c in ("x", "y", "w", "h")))
    ends = [F.col("r_x"), F.col("r_y"), F.col("r_x") + F.col("r_w"), F.col("r_y") + F.col("r_h")]
    placed = outlined.select("diagram_id", "region_id", "rings", "area").withColumns(_bounds(F.col("rings")))
    met = placed.join(r, "diagram_id").where((F.col("x1") <= ends[2]) & (ends[0] <= F.col("x2")) & (F.col("y1") <= ends[3]) & (ends[1] <= F.col("y2")))
    covered = met.where(rings_in_box(F.col("rings"), *ends) / F.col("area") >= share).select("diagram_id", "region_id").distinct()
    return outlined.join(covered, ["diagram_id", "region_id"], "left_anti")


def stitch_outlines(regions: DataFrame, least_area: float = 0.1, threshold: float = 0.1, least: float = 2.0) -> DataFrame:
    """Outlines found on tiles (points in percent of the tile) to merged ones on images, numbered by falling
    score. Loops of one outline merge as regions of their own; first parts come before further ones, each by
    region_id."""
    drawn = loops(stitch_polygons(regions))
    drawn = drawn.withColumn("bounds", F.struct(*(c.alias(k) for k, c in _bounds(F.array("points")).items())))
    cut = clean_outlines(drawn, least_area)
    by = Window.partitionBy("diagram_id").orderBy(F.col("piece") > 0, "__source", "part", "piece")
    numbered = cut.withColumnRenamed("region_id", "__source").withColumn("region_id", F.row_number().over(by).cast("long"))
    merged = merge_outlines(numbered, threshold, least)
    named = merged.join(numbered.select("diagram_id", "region_id", "__source", "part", "piece"), ["diagram_id", "region_id"])
    best = Window.partitionBy("diagram_id").orderBy(F.col("score").desc(), "region_id")
    return named.withColumn("position", F.row_number().over(best).cast("long")).drop("region_id").withColumnRenamed("__source", "region_id")


def stitch_regions(regions: DataFrame, remove_edges: bool = False, box_ids: bool = False, threshold: float = 0.3) -> DataFrame:
    """All that was found on tiles, boxes (points null) and outlines (points in percent of the tile), in one
    order on the image: (diagram_id, region_id, type, id, label, label_group, score, x, y, width, height, points,
    rings, n_members, position). Boxes are stitched, with remove_edges those cut by a tile's border go, and of
    overlapping ones of a group the worse; outlines are stitched and merged, a merged one having the id and
    label of its first. id says tile and number on the tile, counted over both; boxes have it with box_ids.
    Position follows falling score to nine places, boxes before outlines, then region_id."""
    named = tile_position_id(regions)
    none = lambda kind: F.lit(None).cast(kind)
    boxes = named.where("points IS NULL").drop("points")
    boxes = suppress_overlaps(drop_tile_edge_detections(boxes) if remove_edges else stitch_rectangles(boxes), threshold)
    boxes = boxes.select("diagram_id", "region_id", F.lit("rectanglelabels").alias("type"), (F.col("id") if box_ids else none("string")).alias("id"), "label", "score", "x", "y", "width", "height", none(POINTS).alias("points"), none(f"array<{POINTS}>").alias("rings"), F.lit(1).cast("long").alias("n_members"))
    drawn = named.where("points IS NOT NULL")
    merged = stitch_outlines(drawn).join(drawn.select("diagram_id", "region_id", "id", "label"), ["diagram_id", "region_id"])
    lines = merged.select("diagram_id", "region_id", F.lit("polygonlabels").alias("type"), "id", "label", "score", *(none("double").alias(c) for c in ("x", "y", "width", "height")), "points", "rings", "n_members")
    both = boxes.unionByName(lines).withColumn("label_group", label_group(F.col("label")))
    by = Window.partitionBy("diagram_id").orderBy(F.round("score", 9).desc(), F.col("type").desc(), "region_id")
    return both.withColumn("position", F.row_number().over(by).cast("long"))
