"""What the text operators share: stored intermediates, batch bounds and the word rule."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII lower-casing of UTF-8 bytes; bytes.split() then cuts at exactly \x20 and \x09-\x0D.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: Upper bound of one Arrow batch handed to a Python worker.
BATCH_BYTES = 16 << 20

#: Keys that can be hot at once, and rows up to which none is: what is broadcast about them is bounded.
HOT_KEYS = 1 << 16
SALT_ROWS = 1024


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that a run of very long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set on a local master
    (tests). On a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut, and a lost
    executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables of which nothing is read any more, as what came of them is stored. A file system
    that pyarrow doesn't know keeps them."""
    for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()[:1]}:
        try:
            files, at = FileSystem.from_uri(path)
        except pa.ArrowInvalid:
            continue
        files.delete_dir(at)


def hot_keys(counted: DataFrame, *keys: str) -> DataFrame:
    """(keys, __salts int) of the hot keys of a stored table (keys, n long): those with over SALT_ROWS rows
    and over 1/HOT_KEYS of all, so at most HOT_KEYS; a salt gets no more rows than makes a key hot."""
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    most = max(SALT_ROWS, -(-total // HOT_KEYS))
    return counted.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("__salts"))


def salted(rows: DataFrame, hot: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """rows with `__salt`, a part of its key for each row by its columns `by`; 0 for keys that are not hot."""
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("__salts")).cast("int"), F.lit(0))
    return rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__salts")


def spread(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `__salt`, once for each part that `salted` deals their key to."""
    return rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")


def quoted(columns: list[str]) -> list[Column]:
    """Columns by name, whatever the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in columns]


def packed(docs: DataFrame, *replaced: str) -> DataFrame:
    """One column, `row`, with all columns of docs but those that an operator adds, so that no name of the
    caller's meets one of the operator's."""
    return docs.select(F.struct(*quoted([c for c in docs.columns if c not in replaced])).alias("row"))


def renamed(docs: DataFrame, needed: tuple[str, ...], replaced: tuple[str, ...] = ()) -> tuple[DataFrame, list[Column]]:
    """docs with the columns that an operator needs and, under names that clash with none of its own, all
    others but those it replaces; and the columns that give the caller's names and order back."""
    kept = [c for c in docs.columns if c not in replaced]
    names = {c: c if c in needed else f"__other{i}" for i, c in enumerate(kept)}
    return docs.select(*(c.alias(names[x]) for c, x in zip(quoted(kept), kept, strict=True))), [F.col(names[c]).alias(c) for c in kept]


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, as UTF-8; null: none."""
    return text.encode("utf-8", "replace").translate(LOWER).split() if text else []
