"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are ranged by length, and each range is cut into buckets of up to BUCKET_ROWS, however many rows the
sampled bounds of a range let in; a bucket is one row: ids, lengths and the matrix. Query blocks first meet
the buckets of the range with the longest vectors, which gives each query a running k-th result. Queries
are then dealt anew to blocks by the length that a vector needs to reach their k-th score, and a block meets
only the buckets whose longest vector has the length that its least demanding query needs: that is decided on
lengths alone, before any matrix is moved. In a meeting, from the k-th score, the query's length and the
bucket's longest vector follows a local cosine threshold. Above 1 the bucket holds no result for the query;
a high threshold prunes by one coordinate (the query's largest: a vector within the angle must lie in an
interval there); a low one prunes by length, a prefix of the bucket. What is left is verified by the integer
products, and only what comes before the k-th result, in score and then id, is handed on.

Edge cases: vectors that are null or hold null or non-finite components, and rows without an id, take no
part; rows that share an id are rows of their own, as queries and as candidates, also of each other; missing
components count as zero; components and scores beyond a long stay at its end; ties go to the smaller id;
with fewer candidates than k all are returned; other input columns are not read; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BUCKET_ROWS = 8192
QUERY_ROWS = 1024
#: Parts to which the blocks that meet one bucket are dealt.
GROUPS = 64
#: Local cosine thresholds from which one coordinate prunes better than the length alone.
COORDINATE_FROM = 0.6


def integer_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(row long, vec_id, v array<long>): each component x as floor(scale * x); row numbers the rows."""
    x = F.col("embedding")
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    taking_part = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & fit)
    return taking_part.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v"))


_BLOCK = "n long, width long, kind string, rows binary, ids binary, matrix binary"
_PARTS = ("n", "width", "kind", "rows", "ids", "matrix")
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _block(some: list[tuple[int, int, list[int]]]) -> list:
    """Rows, ids and vectors in bytes, by the narrowest type that holds them."""
    width = max(len(v) for _, _, v in some)
    matrix = np.zeros((len(some), width), dtype=np.int64)
    for i, (_, _, v) in enumerate(some):
        matrix[i, : len(v)] = v
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if not matrix.size or (np.iinfo(k).min <= matrix.min() and matrix.max() <= np.iinfo(k).max))
    return [len(some), width, kind, np.array([x[0] for x in some], dtype="<i8").tobytes(), np.array([x[1] for x in some], dtype="<i8").tobytes(), matrix.astype(kind).tobytes()]


def _buckets(ranged: DataFrame) -> DataFrame:
    """Each partition's rows (row, vec_id, v, length), in their order, as blocks with a number of their own,
    `bucket`, whose upper half is the partition's, and their longest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = (TaskContext.get().partitionId() << 32) - 1
        held: list[tuple] = []

        def made(some: list[tuple]) -> pa.RecordBatch:
            nonlocal bucket
            bucket += 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (bucket, math.sqrt(max(x[3] for x in some)), *_block([x[:3] for x in some]))], ["bucket", "longest", *_PARTS])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= BUCKET_ROWS:
                yield made(held[:BUCKET_ROWS])
                held = held[BUCKET_ROWS:]
        if held:
            yield made(held)

    return ranged.select("row", "vec_id", "v", "length").mapInArrow(run, f"bucket long, longest double, {_BLOCK}")


def _query_blocks(asked: DataFrame) -> DataFrame:
    """The queries (row, vec_id, v, length, floor, floor_id), a partition a run of blocks: with the k-th
    results so far, and `needed`, the least length of a vector that can come before one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def made(some: list[tuple]) -> pa.RecordBatch:
            nonlocal block
            block += 1
            floors = np.array([_LEAST if x[4] is None else x[4] for x in some], dtype="<i8")
            floor_ids = np.array([_MOST if x[5] is None else x[5] for x in some], dtype="<i8")
            needed = min(0.0 if f <= 0 or not x[3] else float(f) / math.sqrt(x[3]) for f, x in zip(floors.tolist(), some, strict=True))
            row = (block, needed * (1 - 1e-9), floors.tobytes(), floor_ids.tobytes(), *_block([x[:3] for x in some]))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["block", "needed", "floors", "floor_ids", *_PARTS])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= QUERY_ROWS:
                yield made(held[:QUERY_ROWS])
                held = held[QUERY_ROWS:]
        if held:
            yield made(held)

    return asked.select("row", "vec_id", "v", "length", "floor", "floor_id").mapInArrow(run, f"block long, needed double, floors binary, floor_ids binary, {_BLOCK}")


def _matrix(n: int, width: int, kind: str, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=kind).reshape(n, width)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of a with the rows of b."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(width, 1)
    if bound < 2**62:
        kind = np.float64 if bound < 2**53 else np.int64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    whole = a.astype(object) @ b.astype(object).T  # Python's own integers
    return np.clip(whole, _LEAST, _MOST).astype(np.int64)


def _met(q_rows: np.ndarray, q: np.ndarray, floors: np.ndarray, floor_ids: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query, the up to k best candidates of one bucket that come no later than its floor.
    Returns (query position, candidate ids, scores)."""
    q_len = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    c_len = np.sqrt((c.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(-c_len, kind="stable")
    c, c_rows, c_ids, c_len = c[order], c_rows[order], c_ids[order], c_len[order]
    unit = c / np.maximum(c_len, 1e-300)[:, None]
    width = min(q.shape[1], c.shape[1])
    out = []

    def top(i: int, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        fit = ((scores > floors[i]) | (scores == floors[i]) & (ids <= floor_ids[i])) & (rows != q_rows[i])
        ids, scores = ids[fit], scores[fit]
        if len(ids) > k:
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        if len(ids):
            out.append((i, ids, scores))

    whole = []
    for i in range(len(q)):
        if floors[i] <= 0 or not q_len[i] or not c_len[0]:  # no positive threshold: nothing can be ruled out
            whole.append((i, len(c)))
            continue
        local = floors[i] / (q_len[i] * c_len[0])
        if local > 1 + 1e-9:
            continue
        upto = int(np.searchsorted(-c_len, -(floors[i] / q_len[i]) * (1 - 1e-9), "right"))
        if local < COORDINATE_FROM:
            whole.append((i, upto))
            continue
        at = int(np.argmax(np.abs(q[i, :width])))
        x = q[i, at] / q_len[i]
        slack = math.sqrt(max(0.0, (1 - min(local, 1.0) ** 2) * (1 - x * x))) + 1e-7
        near = np.flatnonzero(np.abs(unit[:upto, at] - min(local, 1.0) * x) <= slack + (1 - min(local, 1.0)) * abs(x))
        if len(near):
            top(i, c_rows[near], c_ids[near], _products(q[i : i + 1], c[near])[0])
    for a in range(0, len(whole), 64):
        some = whole[a : a + 64]
        most = max(n for _, n in some)
        if most:
            scores = _products(q[[i for i, _ in some]], c[:most])
            for (i, n), row in zip(some, scores, strict=True):
                top(i, c_rows[:n], c_ids[:n], row[:n])
    return out


def _scores(pairs: DataFrame, k: int) -> DataFrame:
    """(query_row, query_id, vec_id, score): results of the meetings (floors, floor_ids, q_*, c_*)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q = _matrix(row["q_n"], row["q_width"], row["q_kind"], row["q_matrix"])
                c = _matrix(row["c_n"], row["c_width"], row["c_kind"], row["c_matrix"])
                q_rows, q_ids, floors, floor_ids, c_rows, c_ids = (np.frombuffer(row[x], "<i8") for x in ("q_rows", "q_ids", "floors", "floor_ids", "c_rows", "c_ids"))
                found = _met(q_rows, q, floors, floor_ids, c_rows, c_ids, c, k)
                if found:
                    at, size = [x[0] for x in found], [len(x[1]) for x in found]
                    values = [np.repeat(q_rows[at], size), np.repeat(q_ids[at], size), np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in values], ["query_row", "query_id", "vec_id", "score"])

    columns = [f"{side}_{c}" for side in "qc" for c in _PARTS]
    return pairs.select("floors", "floor_ids", *columns).mapInArrow(run, "query_row long, query_id long, vec_id long, score long")


def _named(blocks: DataFrame, side: str) -> DataFrame:
    return blocks.withColumnsRenamed({c: f"{side}_{c}" for c in _PARTS})


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row whose id is divisible by `every`."""
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = stored(integer_vectors(vectors, scale).withColumn("length", length), "vectors")
    n = rows.count()
    order = [F.col("length").desc(), F.col("vec_id"), F.col("row")]
    ranged = rows.repartitionByRange(max(1, math.ceil(n / BUCKET_ROWS)), *order).sortWithinPartitions(*order)
    buckets = stored(_named(_buckets(ranged), "c"), "buckets")
    asked = rows.where(F.col("vec_id") % every == 0)
    n_blocks = max(1, math.ceil(n / every / QUERY_ROWS))
    none = {"floor": F.lit(None).cast("long"), "floor_id": F.lit(None).cast("long")}

    # the range of the longest vectors meets every block, and gives the running k-th results
    blocks = stored(_named(_query_blocks(asked.withColumns(none).repartition(n_blocks, "row")), "q"), "queries").withColumn("salt", F.col("block") % 64)
    first = buckets.agg(F.min("bucket").alias("bucket")).first().bucket or 0
    longest = buckets.where(F.shiftright("bucket", 32) == first >> 32).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    by = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    found = _scores(blocks.join(longest.drop("longest", "bucket"), "salt"), k).withColumn("place", F.row_number().over(by))
    kth = found.where(F.col("place") == k).select(F.col("query_row").alias("row"), F.col("score").alias("floor"), F.col("vec_id").alias("floor_id"))

    # queries that need vectors of like length come together, and meet the buckets that have them
    needed = F.when((F.col("floor") > 0) & (F.col("length") > 0), F.col("floor") / F.sqrt("length")).otherwise(0.0)
    dealt = asked.join(kth, "row", "left").repartitionByRange(n_blocks, needed.desc(), "row").sortWithinPartitions(needed.desc(), "row")
    asking = stored(_named(_query_blocks(dealt), "q"), "asking")
    bin_of = lambda x: F.floor(F.log2(F.greatest(x, F.lit(1.0))) * 4).cast("int")
    lengths = buckets.select("bucket", "longest", bin_of(F.col("longest")).alias("bin"))
    top_bin = lengths.agg(F.max("bin").alias("bin")).first().bin or 0
    wants = asking.select("block", "needed").withColumn("bin", bin_of(F.col("needed"))).where(F.col("bin") <= top_bin).withColumn("bin", F.explode(F.sequence("bin", F.lit(top_bin))))
    meetings = wants.join(lengths, "bin").where(F.col("longest") >= F.col("needed")).select("block", "bucket", F.floor(F.col("block") / 8).alias("near"))
    # a bucket goes once to each run of neighbouring blocks that meet it
    groups = stored(meetings, "meetings")
    sent = buckets.drop("longest").join(groups.select("bucket", F.pmod(F.xxhash64("near"), F.lit(GROUPS)).alias("group")).distinct(), "bucket")
    met = asking.drop("needed").join(groups.select("block", "bucket", F.pmod(F.xxhash64("near"), F.lit(GROUPS)).alias("group")), "block").join(sent, ["bucket", "group"])
    ranked = _scores(met, k).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row_id, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.row_id <> q.row_id),
r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
