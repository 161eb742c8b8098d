"""Rasters: normalising, cropping, marking and thinning.

Images: (diagram_id, width, height, channels, data binary), row by row, BGR or BGRA. Work is done a batch of
images at a time, without a shuffle; regions come to their image by one join on diagram_id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import raster
from ..sources.pictures import write_pictures
from . import files
from .stages import bounded_batches, bounded_broadcasts, written

IMAGE = "diagram_id long, width long, height long, channels int, data binary"
_FIELDS = ("diagram_id", "width", "height", "channels", "data")
#: Tasks, at least, that write a folder of pictures from a table that may be one small file.
PICTURE_TASKS = 32
# fixed values: colours of marked regions, BGR
COLORS = {"Class": (0, 255, 0), "Struck Class": (0, 0, 255), "relationship": (255, 0, 0)}


def _array(row) -> np.ndarray:
    return np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)


def _row(diagram_id: int, image: np.ndarray) -> tuple:
    return (diagram_id, image.shape[1], image.shape[0], image.shape[2], image.tobytes())


def from_source(images: DataFrame, diagram_id: str, *more: str) -> DataFrame:
    """Spark's image rows as the rasters of this module, with the columns named besides."""
    return images.select(*more, F.col(diagram_id).cast("long").alias("diagram_id"), F.col("image.width").cast("long").alias("width"), F.col("image.height").cast("long").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def map_images(images: DataFrame, change: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    """Each raster changed by change(diagram_id, raster); an image's other columns stay."""
    more = [f for f in images.schema.fields if f.name not in _FIELDS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [_row(r.diagram_id, change(r.diagram_id, _array(r))) for r in batch.itertuples()]
            yield pd.DataFrame(made, columns=list(_FIELDS)).assign(**{f.name: batch[f.name].to_numpy() for f in more})

    return bounded_batches(images).mapInPandas(run, StructType([*StructType.fromDDL(IMAGE).fields, *more]))


def gray_to_bgr(images: DataFrame) -> DataFrame:
    return map_images(images, lambda _, x: raster.gray_to_bgr(x))


def flatten_alpha(images: DataFrame) -> DataFrame:
    return map_images(images, lambda _, x: raster.flatten_alpha(x))


def median_color(images: DataFrame, grid: int | None = None) -> DataFrame:
    """(diagram_id, b, g, r): medians of all pixels or of a sample drawn by the id; with `grid`, of every
    grid-th row and column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(r.diagram_id, *(raster.grid_median(_array(r), grid) if grid else raster.median_color(_array(r), r.diagram_id))) for r in batch.itertuples()]
            yield pd.DataFrame(made, columns=["diagram_id", "b", "g", "r"])

    return bounded_batches(images).mapInPandas(run, "diagram_id long, b long, g long, r long")


def is_dark_mode(medians: DataFrame) -> DataFrame:
    return medians.select("diagram_id", ((F.col("b") + F.col("g") + F.col("r")) / 3 < 128).alias("is_dark"))


def invert_dark(images: DataFrame) -> DataFrame:
    return map_images(images, lambda i, x: 255 - x if raster.is_dark(raster.median_color(x, i)) else x)


def pad_border(images: DataFrame, border: int = 10) -> DataFrame:
    return map_images(images, lambda _, x: raster.pad_border(x, border))


def preprocess_images(images: DataFrame) -> DataFrame:
    return map_images(images, lambda i, x: raster.preprocess(x, i))


def cut_tiles(images: DataFrame, tiles: DataFrame, drop_blank: bool = True) -> DataFrame:
    """The tiles (diagram_id, level, x1, y1, x2, y2) with their pixels; blank ones go. Boxes are gathered by
    diagram before they meet the image, so that a raster is moved once and cut where it lies."""
    boxes = tiles.groupBy("diagram_id").agg(F.collect_list(F.struct("level", "x1", "y1", "x2", "y2")).alias("boxes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for r in batch.itertuples():
                image = _array(r)
                for b in r.boxes:
                    tile = image[b["y1"] : b["y2"], b["x1"] : b["x2"]]
                    if tile.size and not (drop_blank and (tile == 255).all()):
                        made.append((r.diagram_id, b["level"], b["x1"], b["y1"], tile.shape[1], tile.shape[0], tile.shape[2], tile.tobytes()))
            yield pd.DataFrame(made, columns=["diagram_id", "level", "x1", "y1", "width", "height", "channels", "data"])

    return bounded_batches(bounded_broadcasts(images)).join(boxes, "diagram_id").mapInPandas(run, "diagram_id long, level long, x1 long, y1 long, width long, height long, channels int, data binary")


def _with_regions(images: DataFrame, regions: DataFrame, change: Callable[[np.ndarray, list], np.ndarray]) -> DataFrame:
    """change(raster, regions) for each image, whose other columns stay; regions: (diagram_id, label, x1, y1,
    x2, y2 in pixels, rings)."""
    more = [f for f in images.schema.fields if f.name not in _FIELDS]
    told = ["x1", "y1", "x2", "y2", "label", "rings", *(["step"] if "step" in regions.columns else [])]
    listed = regions.groupBy("diagram_id").agg(F.array_sort(F.collect_list(F.struct(*told))).alias("regions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [_row(r.diagram_id, change(_array(r), list(r.regions) if r.regions is not None else [])) for r in batch.itertuples()]
            yield pd.DataFrame(made, columns=list(_FIELDS)).assign(**{f.name: batch[f.name].to_numpy() for f in more})

    return bounded_batches(bounded_broadcasts(images)).join(listed, "diagram_id", "left").mapInPandas(run, StructType([*StructType.fromDDL(IMAGE).fields, *more]))


def _mask(image: np.ndarray, region) -> np.ndarray:
    if region["rings"] is not None and len(region["rings"]):
        return raster.polygon_mask(image.shape[:2], [[(p["x"], p["y"]) for p in ring] for ring in region["rings"]])
    return raster.box_mask(image.shape[:2], region["x1"], region["y1"], region["x2"], region["y2"])


def _marked(image: np.ndarray, some: list, border: bool) -> np.ndarray:
    for region in some:
        mask, color = _mask(image, region), COLORS.get(region["label"], COLORS["relationship"])
        image = raster.blend(image, mask, color)
        if border:
            image = raster.blend(image, raster.outline(mask), color, 0.6)
    return image


def _removed(image: np.ndarray, some: list) -> np.ndarray:
    color, image = raster.grid_median(image), image.copy()
    for region in some:
        image[_mask(image, region)] = color
    return image


def mark_regions(images: DataFrame, regions: DataFrame, border: bool = False) -> DataFrame:
    """Regions blended with their colour at 30 %, with `border` also two pixels of edge at 60 %."""
    return _with_regions(images, regions, lambda image, some: _marked(image, some, border))


def remove_regions(images: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions filled with the image's median colour."""
    return _with_regions(images, regions, _removed)


def keep_only_polygons(images: DataFrame, regions: DataFrame) -> DataFrame:
    """White outside all regions; pure white inside becomes gray."""

    def change(image: np.ndarray, some: list) -> np.ndarray:
        mask = np.zeros(image.shape[:2], dtype=bool)
        for region in some:
            mask |= _mask(image, region)
        return raster.keep_only(image, mask)

    return _with_regions(images, regions, change)


def skeletonize(images: DataFrame, scales: DataFrame) -> DataFrame:
    """(diagram_id, y, x): pixels of the thinned lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                y, x = np.nonzero(raster.skeleton(_array(r), r.scale))
                yield pd.DataFrame({"diagram_id": r.diagram_id, "y": y, "x": x})

    return bounded_batches(bounded_broadcasts(images)).join(scales, "diagram_id").mapInPandas(run, "diagram_id long, y long, x long")


def without_alpha(images: DataFrame) -> DataFrame:
    """Three channels, a fourth being left out."""
    return map_images(images, lambda _, x: np.ascontiguousarray(raster.gray_to_bgr(x)[..., :3]))


def prepare_images(images: DataFrame, regions: DataFrame, mode: str, kinds: tuple[str, ...] = ("classes", "relationships")) -> DataFrame:
    """Training pictures: the regions of the kinds marked, marked with an edge, or removed, in three steps,
    each on what the one before left: `classes`, which are regions with the label Class and then those with
    Struck Class, and `relationships`, all others but notes. With an edge, both kinds of class are green."""
    if mode not in ("mark", "mark_with_border", "remove"):
        raise ValueError(f"unknown mode {mode}")
    label, steps = F.col("label"), []
    if "classes" in kinds:
        steps += [label == "Class", label == "Struck Class"]
    if "relationships" in kinds:
        steps.append(~label.isin("Class", "Struck Class", "Note"))
    step = F.lit(None).cast("int")
    for k, which in enumerate(steps):
        step = F.when(which, k).otherwise(step)
    shown = F.when(label == "Struck Class", "Class").otherwise(label) if mode == "mark_with_border" else label
    some = regions.withColumn("step", step).where("step IS NOT NULL").withColumn("label", shown)

    n_steps = len(steps)

    def change(image: np.ndarray, found: list) -> np.ndarray:
        for k in range(n_steps):
            own = [x for x in found if x["step"] == k]
            image = _removed(image, own) if mode == "remove" else _marked(image, own, mode == "mark_with_border")
        return image

    return _with_regions(images, some, change)


def named_images(pictures: DataFrame) -> DataFrame:
    """Pictures (file_name, stem, image) as rasters with file_name; diagram_id is the hash of that."""
    return from_source(pictures.withColumn("diagram_id", F.xxhash64("file_name")), "diagram_id", "file_name")


def prepare_folder(spark: SparkSession, source: str, target: str, detect: Callable[[DataFrame], DataFrame], mode: str, kinds: tuple[str, ...] = ("classes", "relationships")) -> None:
    """The pictures of a folder, prepared, as PNG files of the same stems below target, in the place of what
    earlier runs wrote there. detect gives the regions (diagram_id, label, x1, y1, x2, y2, rings) of rasters;
    pictures without any are written as they are. Pictures of one stem, or of names whose hashes agree, fail
    the job before a picture is read."""
    prepare_folders(spark, source, detect, [(target, mode, kinds)])


def prepare_folders(spark: SparkSession, source: str, detect: Callable[[DataFrame], DataFrame], wanted: list[tuple[str, str, tuple[str, ...]]]) -> None:
    """prepare_folder for several targets (target, mode, kinds). Pictures are read and decoded once, and stored
    where there are several targets."""
    png_name = F.regexp_replace("file_name", r"\.[^.]*$", ".png")
    names = files.list_images(spark, source).select("file_name", png_name.alias("png_name"))
    if names.groupBy(F.xxhash64("file_name")).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("two file names are equal or have the same hash")
    plain = without_alpha(named_images(files.read_images(spark, source)))
    if len(wanted) > 1:
        names, plain = written(names, "names"), written(plain, "decoded")
    found = detect(plain)
    for target, mode, kinds in wanted:
        made = prepare_images(plain, found, mode, kinds).withColumn("file_name", png_name)
        write_pictures(made, target, "overwrite", names.select(F.col("png_name").alias("file_name")))
