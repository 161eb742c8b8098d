"""Order-dependent steps of small groups, many groups to a call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .stages import bounded_batches, bounded_broadcasts


def _rows(column: pa.ListArray) -> Iterator[list[tuple]]:
    """Each list of structs as tuples; null as no rows."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
    fields = [f.to_pylist() for f in column.flatten().flatten()]
    flat, at = list(zip(*fields, strict=True)), 0
    for n in lengths:
        yield flat[at : at + n]
        at += n


def _numbers(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Each list of numbers as an array; null as an empty one."""
    lengths, flat, at = pc.fill_null(pc.list_value_length(column), 0).to_pylist(), column.flatten().to_numpy(zero_copy_only=False), 0
    for n in lengths:
        yield flat[at : at + n]
        at += n


def per_batch(tables: list[tuple[DataFrame, tuple[str, ...] | str]], keys: tuple[str, ...], work: Callable[..., list[tuple] | Iterator[pa.RecordBatch]], schema: str, arrow: bool = False, raw: bool = False) -> DataFrame:
    """work([(key, rows of each table), ..]) for the keys of any of the tables, a batch of them at a time; it
    returns tuples of the keys' values and what schema names. A table's rows come as tuples of the named
    columns, in no order. The tables' rows are gathered by key together, so that one shuffle for all of them, without
    a join, and one call to Python a batch of groups is all; a group (a diagram, or less) must fit a task. A table that
    names one column of numbers instead comes as an array. Keys that are null meet only their own table. With arrow,
    work also gets the Arrow schema, and returns batches of it, one after the other; with raw, it gets the Arrow batch
    instead of tuples, the keys and then a column of lists of structs for each table."""
    said = [F.col(columns) if isinstance(columns, str) else F.struct(*columns) for _, columns in tables]
    kinds = [table.select(row).schema[0].dataType for (table, _), row in zip(tables, said, strict=True)]
    whole = None
    for i, ((table, _), row) in enumerate(zip(tables, said, strict=True)):
        apart = F.when(F.coalesce(*(F.when(F.col(k).isNull(), 1) for k in keys), F.lit(0)) == 1, i).alias("__apart")
        rows = table.select(*keys, apart, *((row if j == i else F.lit(None).cast(kind)).alias(f"__rows{j}") for j, kind in enumerate(kinds)))
        whole = rows if whole is None else whole.unionAll(rows)
    whole = whole.groupBy(*keys, "__apart").agg(*(F.collect_list(f"__rows{i}").alias(f"__rows{i}") for i in range(len(tables))))
    key_fields = [f for f in whole.schema.fields if f.name in keys]
    out = StructType([*sorted(key_fields, key=lambda f: keys.index(f.name)), *StructType.fromDDL(schema).fields])
    told, n_keys = to_arrow_schema(out), len(keys)
    read = [_numbers if isinstance(columns, str) else _rows for _, columns in tables]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and raw:
                yield from work(batch, told)
            elif batch.num_rows:
                lists = zip(*(f(c) for f, c in zip(read, batch.columns[n_keys:], strict=True)), strict=True)
                groups = [(tuple(key), *one) for *key, one in zip(*(c.to_pylist() for c in batch.columns[:n_keys]), lists, strict=True)]
                if arrow:
                    yield from work(groups, told)
                elif made := work(groups):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), told, strict=True)], schema=told)

    return bounded_batches(bounded_broadcasts(whole)).select(*keys, *(f"__rows{i}" for i in range(len(tables)))).mapInArrow(run, out)


def per_group(tables: list[tuple[DataFrame, tuple[str, ...]]], keys: tuple[str, ...], work: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """work(key, rows of each table) for each key, as in per_batch; its tuples follow the key's columns."""
    return per_batch(tables, keys, lambda groups: [(*key, *row) for key, *rows in groups for row in work(key, *rows)], schema)
