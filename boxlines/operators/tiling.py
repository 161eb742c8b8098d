"""Scale levels and tiles of images, and model output to regions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: least score of a detection, by kind of detector
THRESHOLDS = {"class": 0.5, "text": 0.5, "relationship": 0.5, "label": 0.5, "multiplicity": 0.5, "endpoint": 0.3}


def tile_ladder(images: DataFrame, kind: str, imgsz: int) -> DataFrame:
    """(diagram_id, width, height, level, tile_size, overlap): the scale levels of an image. Level 0 with a
    null tile_size is the whole image. Sizes halve while they are not below the least size P; a last step
    within 20 % of P is taken at exactly P."""
    longest = F.greatest("width", "height")
    base = images.select("diagram_id", "width", "height")
    whole = base.select("*", F.lit(0).cast("long").alias("level"), F.lit(None).cast("long").alias("tile_size"), F.lit(0.0).alias("overlap"))
    if kind in ("text", "multiplicity"):
        return whole
    if kind == "label":
        tiled = base.where(longest > imgsz).select("*", F.lit(1).cast("long").alias("level"), F.lit(imgsz).cast("long").alias("tile_size"), F.lit(0.5).alias("overlap"))
        return whole.where(longest <= imgsz).unionByName(tiled)
    if kind not in ("class", "relationship", "endpoint"):
        raise ValueError(f"unknown detector kind {kind}")
    least = imgsz if kind == "class" else imgsz // 2
    start = longest if kind == "relationship" else F.floor(longest / 2)
    sizes = base.where(longest > least).select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.log2(longest / least)).cast("int"))).alias("k"))
    sizes = sizes.withColumn("raw", F.floor(start / F.pow(F.lit(2.0), F.col("k"))).cast("long"))
    before = F.when(F.col("k") == 0, True).otherwise(F.floor(start / F.pow(F.lit(2.0), F.col("k") - 1)) >= least)
    taken = sizes.where(before & (F.col("raw") >= least * 0.8)).withColumn("tile_size", F.greatest("raw", F.lit(least)).cast("long"))
    overlap = F.lit(0.5) if kind == "class" else F.when(F.col("tile_size") > imgsz, 0.5).otherwise(0.0)
    tiled = taken.select("diagram_id", "width", "height", (F.col("k") + 1).cast("long").alias("level"), "tile_size", overlap.alias("overlap"))
    return (whole if kind == "class" else whole.where(longest <= least)).unionByName(tiled)


def tile_grid(levels: DataFrame) -> DataFrame:
    """(diagram_id, level, tile_size, x1, y1, x2, y2): tiles of each level; those past the right or lower
    edge move back inside, and each place is taken once."""
    size = F.col("tile_size")
    step = F.greatest(F.floor(size * (1 - F.col("overlap"))), F.lit(1)).cast("long")
    starts = lambda extent: F.transform(F.sequence(F.lit(0).cast("long"), F.col(extent) - 1, step), lambda s: F.greatest(F.least(s, F.col(extent) - size), F.lit(0)).cast("long"))
    tiled = levels.where(size.isNotNull()).withColumn("x1", F.explode(F.array_distinct(starts("width")))).withColumn("y1", F.explode(F.array_distinct(starts("height"))))
    tiles = tiled.select("diagram_id", "level", "tile_size", "x1", "y1", F.least(F.col("x1") + size, F.col("width")).alias("x2"), F.least(F.col("y1") + size, F.col("height")).alias("y2"))
    whole = levels.where(size.isNull()).select("diagram_id", "level", "tile_size", F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("y1"), F.col("width").alias("x2"), F.col("height").alias("y2"))
    return tiles.unionByName(whole)


def score_tiles(tiles: DataFrame, load: Callable[[str], Callable[[pd.DataFrame], pd.DataFrame]], kind: str, schema: str) -> DataFrame:
    """Runs the detector of a kind over batches of tiles; it is loaded once in a worker."""
    if kind not in THRESHOLDS:
        raise ValueError(f"unknown detector kind {kind}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load(kind)
        for batch in batches:
            yield scorer(batch)

    return tiles.mapInPandas(run, schema)


def decode_rectangles(raw: DataFrame, least: float) -> DataFrame:
    """(.. cx, cy, w, h in parts of 1, score) to upper left corners and sizes in percent."""
    return raw.where(F.col("score") >= least).select(
        *(c for c in raw.columns if c not in ("cx", "cy", "w", "h")),
        ((F.col("cx") - F.col("w") / 2) * 100).alias("x"),
        ((F.col("cy") - F.col("h") / 2) * 100).alias("y"),
        (F.col("w") * 100).alias("width"),
        (F.col("h") * 100).alias("height"),
    )


def decode_polygons(raw: DataFrame, least: float) -> DataFrame:
    """Points in parts of 1 to percent."""
    points = F.transform("points", lambda p: F.struct((p["x"] * 100).alias("x"), (p["y"] * 100).alias("y")))
    return raw.where(F.col("score") >= least).withColumn("points", points)


def decode_choices(probs: Column, least: float, many: bool = False) -> tuple[Column, Column]:
    """(picked class indexes, mean score): the best class, or all of `least` or more; null if the mean is
    below `least` or there is none."""
    best = F.array_position(probs, F.array_max(probs)).cast("long") - 1
    if many:
        at = F.filter(F.transform(probs, lambda p, i: F.when(p >= least, i.cast("long"))), lambda i: i.isNotNull())
    else:
        at = F.when(F.size(probs) > 0, F.array(best)).otherwise(F.array().cast("array<long>"))
    chosen = F.transform(at, lambda i: F.get(probs, i.cast("int")))
    mean = F.aggregate(chosen, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(chosen) > 0, F.size(chosen))
    good = mean >= least
    return F.when(good, at), F.when(good, mean)


def with_threshold(regions: DataFrame, kind: str = "kind") -> DataFrame:
    """Adds `least`, the threshold of the row's kind of detector (six rows, broadcast)."""
    table = regions.sparkSession.createDataFrame(list(THRESHOLDS.items()), f"{kind} string, least double")
    return regions.join(F.broadcast(table), kind)


def min_score(regions: DataFrame, least: float) -> DataFrame:
    return regions.where(F.col("score") >= least)

