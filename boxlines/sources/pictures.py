"""A Spark data source that writes rasters as PNG files, a picture a file.

A task puts its pictures in a folder of its own attempt, below `_temporary`. The commit drops the folders of
attempts that didn't make it and moves the run's folder to its place at once, so that a reader sees all
pictures of a run or none, each once, however often tasks were repeated. A failed run is removed; what its
tasks still write while they are stopped stays below `_temporary`, where no reader looks. Paths may be of any
file system that pyarrow.fs knows by its scheme."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

_COLUMNS = ("file_name", "width", "height", "channels", "data")
# fixed values: PNG's colour types by number of channels
_COLOR_TYPES = {1: 0, 3: 2, 4: 6}


def png(image: np.ndarray) -> bytes:
    """A raster (height, width, channels: gray, BGR or BGRA) as a PNG file."""
    height, width, channels = image.shape
    if channels >= 3:
        image = image[..., [2, 1, 0, *range(3, channels)]]
    lines = np.zeros((height, 1 + width * channels), dtype=np.uint8)  # each begins with its filter, none
    lines[:, 1:] = image.reshape(height, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, _COLOR_TYPES[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    pictures: int


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class PictureWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, f"run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, top = _files(self.path)
        task = TaskContext.get()
        folder = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        at, seen = f"{top}/_temporary/{self.run}/{folder}", set()
        for batch in iterator:
            for name, width, height, channels, data in zip(*(batch.column(c).to_pylist() for c in _COLUMNS), strict=True):
                if not name or "/" in name or name[0] in "._" or name in seen:
                    raise ValueError(f"not a name of a picture, or one that comes twice: {name!r}")
                if not seen:
                    files.create_dir(at, recursive=True)
                seen.add(name)
                with files.open_output_stream(f"{at}/{name}") as out:
                    out.write(png(np.frombuffer(data, np.uint8).reshape(height, width, channels)))
        return Written(folder, len(seen))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, top = _files(self.path)
        run, kept = f"{top}/_temporary/{self.run}", {m.folder for m in messages if m is not None}
        before = [x.path for x in files.get_file_info(fs.FileSelector(top, allow_not_found=True)) if x.base_name.startswith("run-")] if self.overwrite else []
        for x in files.get_file_info(fs.FileSelector(run, allow_not_found=True)):
            if x.base_name not in kept:
                files.delete_dir(x.path)
        files.create_dir(run, recursive=True)  # there may be no picture at all
        files.move(run, f"{top}/{self.run}")
        for x in before:
            files.delete_dir(x)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, top = _files(self.path)
        if files.get_file_info(f"{top}/_temporary/{self.run}").type == fs.FileType.Directory:
            files.delete_dir(f"{top}/_temporary/{self.run}")


class Pictures(DataSource):
    """Format `pictures`, for writing: rows of (file_name, width, height, channels, data), option `path`."""

    @classmethod
    def name(cls) -> str:
        return "pictures"

    def writer(self, schema: StructType, overwrite: bool) -> PictureWriter:
        return PictureWriter(self.options["path"], overwrite)


def write_pictures(pictures: DataFrame, path: str, mode: str = "append", names: DataFrame | None = None, dealt: int = 0) -> None:
    """Rasters (file_name, width, height, channels, data) as PNG files below path; mode `overwrite` takes the
    place of earlier runs. A name that comes twice fails the run before a picture is written; names, by
    default taken from the pictures, can be given by a table (file_name) that is cheaper to work out. With dealt, pictures
    are dealt out by name to as many tasks or more: a table that is one small file would be written by one."""
    spark: SparkSession = pictures.sparkSession
    twice = (pictures if names is None else names).groupBy("file_name").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several pictures have the name {twice[0].file_name}")
    spark.dataSource.register(Pictures)
    kinds = {"width": "int", "height": "int", "channels": "int", "file_name": "string", "data": "binary"}
    if dealt:
        pictures = pictures.repartition(max(dealt, pictures.sparkSession.sparkContext.defaultParallelism), "file_name")
    pictures.select(*(F.col(c).cast(kinds[c]).alias(c) for c in _COLUMNS)).write.format("pictures").mode(mode).option("path", path).save()
