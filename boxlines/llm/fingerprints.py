"""Quartile bucket digests of texts.

The UTF-8 bytes of a text are read as overlapping triplets (three shapes in a window of four bytes), hashed
into 256 buckets and counted. The digest has a length code, the ratios of the lower quartile and the median
of the counts to the upper quartile, and for each bucket the quarter that its count falls in (two bits).
Digests are compared by a difference score that is bounded and turned into a likeness from 0 to 1.

Edge cases: null texts are empty ones; a text of under three bytes has no triplets, and all buckets are in
the lowest quarter; equal texts have equal digests whatever their rows hold besides; rows that agree in id
and text are neighbours in the order of documents and stay separate rows; null ids come first; texts may be of
any length; an empty table gives an empty table; other input columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import bounded_batches, stored

BUCKETS = 256
#: The difference from which two digests count as unlike: about what two unrelated bodies have.
BOUND = 400
#: Code of a difference between two quarters.
_STEP = np.array([0, 1, 2, 6], dtype=np.int64)
_SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))


def _counts(raw: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for start in range(0, max(len(raw) - 2, 0), 1 << 20):
        b = np.frombuffer(raw[start : start + (1 << 20) + 3], np.uint8).astype(np.uint32)
        for salt, (i, j, k) in enumerate(_SHAPES):
            n = min(len(b) - k, 1 << 20)
            if n > 0:
                x = b[i : i + n] * np.uint32(0x9E3779B1) + b[j : j + n] * np.uint32(0x85EBCA77) + b[k : k + n] * np.uint32(0xC2B2AE3D) + np.uint32(salt * 0x27D4EB2F)
                x ^= x >> np.uint32(15)
                x *= np.uint32(0x2C1B3C6D)
                counts += np.bincount(x >> np.uint32(24), minlength=BUCKETS)
    return counts


def fingerprint(text: str | None) -> str:
    """The digest in hex: one byte of length, one of the quartile ratios, 64 of bucket quarters."""
    raw = (text or "").encode("utf-8", "replace")
    counts = _counts(raw)
    ranked = np.sort(counts)
    q1, q2, q3 = (int(ranked[BUCKETS * i // 4 - 1]) for i in (1, 2, 3))
    quarter = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = quarter[0::4] << 6 | quarter[1::4] << 4 | quarter[2::4] << 2 | quarter[3::4]
    ratios = (16 * q1 // (q3 + 1)) << 4 | 16 * q2 // (q3 + 1)
    return bytes([min(255, round(8 * math.log2(len(raw) + 1))), ratios]).hex() + packed.astype(np.uint8).tobytes().hex()


def difference(a: str, b: str) -> int:
    """Difference score of two digests: their lengths, ratios, and each bucket's quarters."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8).astype(np.int64), np.frombuffer(bytes.fromhex(b), np.uint8).astype(np.int64)
    score = max(0, abs(int(x[0] - y[0])) - 1) + abs(int((x[1] >> 4) - (y[1] >> 4))) + abs(int((x[1] & 15) - (y[1] & 15)))
    body = sum(int(_STEP[np.abs((x[2:] >> s & 3) - (y[2:] >> s & 3))].sum()) for s in (0, 2, 4, 6))
    return score + body


def likeness(a: str, b: str) -> float:
    """1 for equal digests, falling with their difference to 0 at BOUND."""
    return 1.0 - min(difference(a, b), BOUND) / BOUND


def with_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the digest of each row's text; a column of that name is replaced."""
    bounded_batches(docs.sparkSession)
    source = docs.drop(out) if out != text_col else docs
    at = source.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], [*batch.schema.names, out])

    return source.mapInArrow(run, StructType([*source.schema.fields, StructField(out, StringType())]))


def _row(doc_id: object, text: str, mark: str, next_text: str, next_mark: str) -> tuple:
    cut = len(text) // 4
    edited = text[: len(text) - cut] + next_text[:cut]
    edited_mark = fingerprint(edited) if edited != text else mark
    return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, next_mark))


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Each document's digest against those of its edited text and of the next document by doc_id.

    Documents are dealt once, by range of doc_id, and sorted in each partition; only the first and last
    texts of a partition go on to be paired with the partitions beside it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {_OUT}, part int, place string, text string"
    names = ["doc_id", *_NAMES, "part", "place", "text"]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple | None = None
        made: list[tuple] = []
        types: pa.Schema | None = None

        def batch_of(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), types.types, strict=True)], names)

        for batch in batches:
            if types is None:
                types = pa.schema([("doc_id", batch.schema.types[0]), *zip(_NAMES, [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True), ("part", pa.int32()), ("place", pa.string()), ("text", pa.string())])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mark = fingerprint(text)
                if held is None:
                    made.append((doc_id, *[None] * 6, part, "first", text))
                else:
                    made.append((*_row(*held, text, mark), part, None, None))
                held = (doc_id, text, mark)
            if made:
                yield batch_of(made)
                made = []
        if held is not None:
            yield batch_of([(held[0], *[None] * 6, part, "last", held[1])])

    kept = stored(dealt.mapInArrow(within, schema), "fingerprints")
    ends = kept.where("place IS NOT NULL")
    parts = sorted(r.part for r in ends.where("place = 'first'").select("part").collect())  # one a partition
    follows = spark.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part int, next_part int")
    firsts = ends.where("place = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    lasts = ends.where("place = 'last'").select("doc_id", "part", "text").join(F.broadcast(follows), "part").join(firsts, "next_part").select("doc_id", "text", "next_text")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_row(i, t, fingerprint(t), n, fingerprint(n))[1:] for i, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if made:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*made, strict=True), kinds, strict=True))], ["doc_id", *_NAMES])

    return kept.where("place IS NULL").select("doc_id", *_NAMES).unionByName(lasts.mapInArrow(across, f"doc_id {id_type}, {_OUT}"))
