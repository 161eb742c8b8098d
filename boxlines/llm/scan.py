"""Running sums of ordered rows by key, however many rows a key has.

Rows are ranged over partitions by key and order, and summed within each; a key that goes on from one
partition into the next is carried over there. What the driver sees is one row a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from .common import stored


def _with(batch: pa.RecordBatch, more: dict[str, np.ndarray], without: tuple[str, ...] = ()) -> pa.RecordBatch:
    kept = {name: column for name, column in zip(batch.schema.names, batch.columns, strict=True) if name not in without}
    made = kept | {name: pa.array(x) for name, x in more.items()}
    return pa.RecordBatch.from_arrays(list(made.values()), list(made))


def running(rows: DataFrame, key: str, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """rows and, for each x of sums, `x_run`: the sum of x over the rows of the same key up to this one, and
    `x_before`: the sum without this one. key and sums are longs without nulls; sums wrap around."""
    held_schema = StructType([*rows.schema.fields, StructField("__part", IntegerType()), StructField("__at", LongType()), StructField("__first", BooleanType()), *(StructField(f"{x}_run", LongType()) for x in sums)])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, key_before, sofar, in_first = TaskContext.get().partitionId(), 0, None, [0] * len(sums), True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            begins = np.ones(n, dtype=bool)
            begins[1:] = keys[1:] != keys[:-1]
            begins[0] = key_before is None or keys[0] != key_before
            run = np.cumsum(begins)
            first = (run == 0) & in_first if key_before is not None else run == 1
            starts, more = np.flatnonzero(begins), {}
            for k, x in enumerate(sums):
                values = batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(values)
                offsets = np.concatenate([[np.int64(sofar[k])], values[starts] - total[starts]])
                more[f"{x}_run"] = total + offsets[run]
                sofar[k] = more[f"{x}_run"][-1]
            yield _with(batch, {"__part": np.full(n, part, dtype=np.int32), "__at": np.arange(at, at + n), "__first": first, **more})
            at, key_before, in_first = at + n, keys[-1], bool(first[-1])

    ranged = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    held = stored(ranged.mapInArrow(within, held_schema), name)
    tail = F.struct(F.col(key).alias("key"), F.col("__first").alias("whole"), F.array(*(f"{x}_run" for x in sums)).alias("sums"))
    ends = held.groupBy("__part").agg(F.min_by(key, "__at").alias("head"), F.max_by(tail, "__at").alias("tail")).orderBy("__part").collect()
    carried: dict[int, np.ndarray] = {}
    for before, here in zip(ends, ends[1:], strict=False):
        if before.tail.key == here.head:
            sofar = np.array(before.tail.sums, dtype=np.int64)
            carried[here["__part"]] = sofar + carried[before["__part"]] if before.tail.whole and before["__part"] in carried else sofar
    done_schema = StructType([*rows.schema.fields, *(StructField(f"{x}_{k}", LongType()) for x in sums for k in ("run", "before"))])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(len(sums), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                parts, first = batch.column("__part").to_numpy(), batch.column("__first").to_numpy(zero_copy_only=False)
                which, back = np.unique(parts, return_inverse=True)
                added = np.stack([carried.get(int(p), none) for p in which])[back] * first[:, None]
                more = {}
                for k, x in enumerate(sums):
                    run = batch.column(f"{x}_run").to_numpy() + added[:, k]
                    more |= {f"{x}_run": run, f"{x}_before": run - batch.column(x).to_numpy(zero_copy_only=False)}
                yield _with(batch, more, ("__part", "__at", "__first", *(f"{x}_run" for x in sums)))

    return held.mapInArrow(carry, done_schema)
