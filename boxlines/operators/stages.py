"""Intermediate tables that cut long plans."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch of rows that a Python worker gets at once; as Python objects they take 20 to 30 times as many.
#: Small, so that batches are as large on little input as on much.
BATCH_BYTES = 1 << 20


#: Bytes as stored of a table that Spark may still send whole to all tasks. They pack so well that ten megabytes,
#: Spark's own bound, are a million rows and hundreds of megabytes in the driver.
BROADCAST_BYTES = 256 << 10

#: Bytes of one task, packed, shuffled or read from files; sorted in several steps they take up to 50 times as many.
PART_BYTES = 8 << 20
LEAST_PART_BYTES = 64 << 10


def bounded_batches(df: DataFrame) -> DataFrame:
    """df; bounds its session's Arrow batches by bytes, so that rows which hold a whole diagram each do not come
    ten thousand at a time, and a worker's memory doesn't follow the size of its partition."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return bounded_parts(df)


def bounded_parts(df: DataFrame) -> DataFrame:
    """df; bounds its session's partitions, shuffled or read from files, by bytes, PART_BYTES where the bound is greater,
    so that the memory of a task that sorts or sums them doesn't follow the input, and lets shuffled ones be as small as
    LEAST_PART_BYTES where there are idle cores: what is done to a packed row may be much."""
    conf = df.sparkSession.conf
    for name, most in (("adaptive.advisoryPartitionSizeInBytes", PART_BYTES), ("adaptive.coalescePartitions.minPartitionSize", LEAST_PART_BYTES), ("files.maxPartitionBytes", PART_BYTES)):
        if _bytes(conf.get(f"spark.sql.{name}")) > most:
            conf.set(f"spark.sql.{name}", str(most))
    return df


def bounded_broadcasts(df: DataFrame) -> DataFrame:
    """df; bounds what its session's joins send through the driver by BROADCAST_BYTES, where the bound is greater.
    A join of two tables that both follow the input is dealt out."""
    conf = df.sparkSession.conf
    if _bytes(conf.get("spark.sql.autoBroadcastJoinThreshold")) > BROADCAST_BYTES:
        conf.set("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST_BYTES))
    return df


def _bytes(told: str) -> int:
    """Bytes of a size as Spark's settings have it: 10485760b, 10MB, 256k."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", told.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def shared_dir(spark: SparkSession) -> str:
    """The folder which driver and executors share, as spark.checkpoint.dir names it. Where that is unset, a
    temporary one on a local master; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@dataclass
class Steps:
    """What a measured run has written so far: name, seconds and rows of each table, and the run's seconds."""

    steps: list[tuple[str, float, int]] = field(default_factory=list)
    total: float | None = None


_measured: ContextVar[Steps | None] = ContextVar("measured", default=None)


@contextmanager
def measured() -> Iterator[Steps]:
    """Within it, `written` notes what each table took, as the driver's clock and the job's own count of rows
    have it. The whole time is measured by itself: it also holds what lies between the tables."""
    found, began = Steps(), time.monotonic()
    before = _measured.set(found)
    try:
        yield found
    finally:
        found.total = time.monotonic() - began
        _measured.reset(before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: its plan starts anew, and a lost executor
    costs a re-read."""
    path = f"{shared_dir(bounded_broadcasts(df).sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    if (run := _measured.get()) is None:
        df.write.parquet(path)
    else:
        rows, began = Observation(), time.monotonic()
        df.observe(rows, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        run.steps.append((name, time.monotonic() - began, rows.get["rows"]))
    return df.sparkSession.read.schema(df.schema).parquet(path)
