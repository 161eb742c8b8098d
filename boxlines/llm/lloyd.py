"""Exact Lloyd rounds over two trees: cover trees over the vectors, and one over each round's centroids.

Vectors become integers, are dealt to the nearest of ANCHORS anchors (the vectors whose ids have the least
hashes) and ranged by it, so that a block of up to BLOCK_ROWS neighbours gets a cover tree of its own, once:
farthest-first centres, whose level sets are 2^l apart and cover what is below within 2^l, cut off at some
LEAF points a centre. Each round broadcasts the centroids (k rows), builds their tree, and walks pairs of a
vector node and a centroid node. A pair goes when its least possible distance exceeds, by more than rounding,
the most that a vector of the node can be from some centroid; a node left with one centroid is handed over
whole, by its sums; leaf nodes compare their vectors with what is left in whole numbers. So ties and results
are those of comparing all. Tasks return a sum per centroid, added up as decimals; the driver sees k rows.

Edge cases: vectors of another width than `width`, null ones and those with null or non-finite components
take no part; components are held within +-2^27 after scaling, so that squared distances fit a long; rows
without vec_id take part but start no centroid, and where no row has an id the result is empty; repeated rows
are rows of their own, and can start centroids of their own (equal hashes: by components); of equal centroids
the smaller number takes all; with fewer than k vectors there are as many centroids; an empty table gives an
empty table; other input columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

BLOCK_ROWS = 2048
#: Points a centre of a vector tree has at the mean.
LEAF = 16
ANCHORS = 256
_HELD = 1 << 27


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a from the rows of b, as longs."""
    most = max(int(np.abs(x).max(initial=0)) for x in (a, b))
    kind = np.float64 if 4 * most * most * max(a.shape[1], 1) < 2**53 else np.int64
    a, b = a.astype(kind), b.astype(kind)
    found = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return found.astype(np.int64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of a from the same rows of b, as floats."""
    return np.sqrt(((a.astype(np.float64) - b) ** 2).sum(axis=1))


@dataclass
class Tree:
    """points (distinct, int32) in the order of the leaves; each node's run of points, its centre among
    them, its radius, and its run of children (none: a leaf). Node 0 is the root."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    kids_from: np.ndarray
    kids_to: np.ndarray

    KINDS = {"points": "<i4", "starts": "<i4", "ends": "<i4", "centres": "<i4", "radii": "<f8", "kids_from": "<i4", "kids_to": "<i4"}

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, x.name), self.KINDS[x.name]).tobytes() for x in fields(self)]

    @classmethod
    def unpacked(cls, raw: list[bytes], width: int) -> Tree:
        arrays = [np.frombuffer(x, cls.KINDS[f.name]) for f, x in zip(fields(cls), raw, strict=True)]
        return cls(arrays[0].reshape(-1, width), *arrays[1:])


def cover_tree(points: np.ndarray, leaf: int) -> tuple[Tree, np.ndarray]:
    """The tree of distinct points, and the order in which it has them."""
    n, x = len(points), points.astype(np.float64)
    norms = (x * x).sum(axis=1)
    n_centres = max(1, -(-n // leaf))
    # farthest first: each centre is the point that lies farthest from all before it
    centres, gaps, near = [0], [np.inf], np.full(n, np.inf)
    owner = np.zeros(n, dtype=np.int64)
    while True:
        at = np.maximum(norms + norms[centres[-1]] - 2 * (x @ x[centres[-1]]), 0)
        at[centres[-1]] = 0
        closer = at < near
        owner[closer] = len(centres) - 1
        near = np.minimum(near, at)
        far = int(near.argmax())
        if len(centres) >= n_centres or near[far] <= 0:
            break
        gaps.append(np.sqrt(near[far]))
        centres.append(far)
    # level sets: centres that were more than 2^l from all before; each centre's ancestor in each set
    levels = np.concatenate([[2000], np.ceil(np.log2(np.maximum(gaps[1:], 1e-9)))])
    steps = np.unique(levels)[::-1]
    spots = x[centres]
    ancestors = [np.arange(len(centres))]
    for level in steps[:-1][::-1]:  # from fine to coarse
        members = np.flatnonzero(levels >= level)
        below = np.unique(ancestors[-1])
        apart = (spots[below] ** 2).sum(axis=1)[:, None] + (spots[members] ** 2).sum(axis=1) - 2 * spots[below] @ spots[members].T
        up = members[apart.argmin(axis=1)]
        up[levels[below] >= level] = below[levels[below] >= level]
        jump = np.zeros(len(centres), dtype=np.int64)
        jump[below] = up
        ancestors.append(jump[ancestors[-1]])
    coarse_to_fine = ancestors[::-1]
    rank = np.empty(len(centres), dtype=np.int64)
    rank[np.lexsort(coarse_to_fine[::-1])] = np.arange(len(centres))
    order = np.argsort(rank[owner], kind="stable")
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    x, made = x[order], []
    owner = owner[order]
    for of in coarse_to_fine:
        node = of[owner]
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        middle = place[np.array(centres)[node]]
        made.append((starts, np.append(starts[1:], n), middle[starts], np.maximum.reduceat(np.sqrt(((x - x[middle]) ** 2).sum(axis=1)), starts)))
    first = np.cumsum([0, *(len(s) for s, *_ in made)])
    kids_from, kids_to = [], []
    for k, (starts, ends, *_) in enumerate(made):
        if k + 1 < len(made):
            kids_from.append(first[k + 1] + np.searchsorted(made[k + 1][0], starts))
            kids_to.append(first[k + 1] + np.searchsorted(made[k + 1][0], ends))
        else:
            kids_from.append(np.zeros(len(starts), dtype=np.int64))
            kids_to.append(np.zeros(len(starts), dtype=np.int64))
    parts = [np.concatenate([m[k] for m in made]) for k in range(4)]
    return Tree(points[order], *parts, np.concatenate(kids_from), np.concatenate(kids_to)), order


def _spread(lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each low to below its high, one after the other, and whose they are."""
    sizes = highs - lows
    whose = np.repeat(np.arange(len(lows)), sizes)
    return lows[whose] + np.arange(len(whose)) - np.repeat(np.cumsum(sizes) - sizes, sizes), whose


def walk(tree: Tree, centroids: Tree, numbers: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Runs of points that go to one centroid whole (from, to, number), and each point's number."""
    nodes, others = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    given = np.full(len(tree.points), -1, dtype=np.int64)
    runs: list[tuple[int, int, int]] = []
    spots, ends = tree.points[tree.centres], centroids.points[centroids.centres]
    while len(nodes):
        apart = np.concatenate([_apart(spots[nodes[a : a + 16384]], ends[others[a : a + 16384]]) for a in range(0, len(nodes), 16384)])
        starts = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
        group = np.cumsum(np.concatenate([[0], nodes[1:] != nodes[:-1]]))
        most = np.minimum.reduceat(apart + tree.radii[nodes], starts)
        kept = apart - tree.radii[nodes] - centroids.radii[others] <= most[group] * (1 + 1e-9) + 1e-6
        nodes, others = nodes[kept], others[kept]
        starts = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
        group = np.cumsum(np.concatenate([[0], nodes[1:] != nodes[:-1]]))
        heads = nodes[starts]
        inner = centroids.kids_to[others] > centroids.kids_from[others]
        any_inner = np.maximum.reduceat(inner, starts)
        widest = np.maximum.reduceat(centroids.radii[others], starts)
        alone = (np.diff(np.append(starts, len(nodes))) == 1) & ~any_inner
        is_leaf = tree.kids_to[heads] == tree.kids_from[heads]
        for g in np.flatnonzero(alone):
            number = int(numbers[centroids.centres[others[starts[g]]]])
            runs.append((int(tree.starts[heads[g]]), int(tree.ends[heads[g]]), number))
            given[tree.starts[heads[g]] : tree.ends[heads[g]]] = number
        final = ~alone & is_leaf & ~any_inner
        for g in np.flatnonzero(final):
            some = centroids.centres[others[starts[g] : starts[g + 1] if g + 1 < len(starts) else None]]
            some = some[np.argsort(numbers[some])]  # the first of equal distances is the smaller number
            a, b = tree.starts[heads[g]], tree.ends[heads[g]]
            given[a:b] = numbers[some[_squares(tree.points[a:b], centroids.points[some]).argmin(axis=1)]]
        down = ~alone & ~final
        split_node = down & ~is_leaf & (~any_inner | (tree.radii[heads] > widest))
        # a node's children meet what the node met; else the centroids' nodes are opened
        kids, whose = _spread(tree.kids_from[heads[split_node]], tree.kids_to[heads[split_node]])
        lows, highs = starts, np.append(starts[1:], len(nodes))
        at, of = _spread(lows[split_node][whose], highs[split_node][whose])
        new_nodes, new_others = [kids[of]], [others[at]]
        opened = (down & ~split_node)[group]
        stay = opened & ~inner
        new_nodes.append(nodes[stay])
        new_others.append(others[stay])
        ends_of, of = _spread(centroids.kids_from[others[opened & inner]], centroids.kids_to[others[opened & inner]])
        new_nodes.append(nodes[opened & inner][of])
        new_others.append(ends_of)
        nodes, others = np.concatenate(new_nodes), np.concatenate(new_others)
        by = np.argsort(nodes, kind="stable")
        nodes, others = nodes[by].astype(np.int64), others[by].astype(np.int64)
    return runs, given


def _centroid_tree(centroids: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of the distinct centroids and, for each of its points, the smallest number that has it."""
    distinct, first = np.unique(centroids, axis=0, return_index=True)
    tree, order = cover_tree(distinct, 1)
    return tree, first[order]


_TREE = ["points", "starts", "ends", "centres", "radii", "kids_from", "kids_to"]
_BLOCK = "ids array<long>, owners binary, " + ", ".join(f"{x} binary" for x in _TREE)


def integer_vectors(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """(vec_id, row, v array<int>) of the vectors that take part."""
    x = F.col("embedding")
    fit = (F.size(x) == width) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    held = lambda c: F.floor(F.least(F.greatest(c.cast("double") * F.lit(float(scale)), F.lit(float(-_HELD))), F.lit(float(_HELD)))).cast("int")
    return vectors.where(x.isNotNull() & fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.transform(x, held).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _dealt(rows: DataFrame, anchors: np.ndarray, width: int) -> DataFrame:
    """(vec_id, row, anchor int, x binary): each vector and the nearest anchor, so that neighbours come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(a, BLOCK_ROWS)
                v = _matrix(some.column("v"), width).astype("<i4")
                x, y = v.astype(np.float64), anchors.astype(np.float64)
                nearest = ((y * y).sum(axis=1) - 2 * (x @ y.T)).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("row"), pa.array(nearest), pa.array([r.tobytes() for r in v], pa.binary())], ["vec_id", "row", "anchor", "x"])

    return rows.mapInArrow(run, "vec_id long, row long, anchor int, x binary")


def _blocks(dealt: DataFrame, width: int) -> DataFrame:
    """A row a block: its rows' ids and which point each is, and the tree of its distinct points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        raw: list[bytes] = []

        def made(n: int) -> pa.RecordBatch:
            v = np.frombuffer(b"".join(raw[:n]), "<i4").reshape(n, width)
            distinct, back = np.unique(v, axis=0, return_inverse=True)
            tree, order = cover_tree(distinct, LEAF)
            place = np.empty(len(order), dtype="<i4")
            place[order] = np.arange(len(order))
            row = [ids[:n], place[back.reshape(-1)].tobytes(), *tree.packed()]
            del ids[:n], raw[:n]
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in row[1:])], ["ids", "owners", *_TREE])

        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            raw += batch.column("x").to_pylist()
            while len(ids) >= BLOCK_ROWS:
                yield made(BLOCK_ROWS)
        if ids:
            yield made(len(ids))

    ranged = dealt.repartitionByRange("anchor", "row").sortWithinPartitions("anchor", "row")
    return ranged.select("vec_id", "x").mapInArrow(run, _BLOCK)


def _sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """number: (vectors that are nearest to this centroid, their sum); centroids without any are absent."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, numbers = _centroid_tree(centroids)
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
        for batch in batches:
            for block in batch.to_pylist():
                tree = Tree.unpacked([block[x] for x in _TREE], width)
                weights = np.bincount(np.frombuffer(block["owners"], "<i4"), minlength=len(tree.points))
                weighed = tree.points.astype(np.int64) * weights[:, None]
                runs, given = walk(tree, ends, numbers)
                upto, n_upto = np.concatenate([np.zeros((1, width), dtype=np.int64), weighed.cumsum(axis=0)]), np.append(0, weights.cumsum())
                for a, b, number in runs:  # a node goes over whole
                    sums[number] += upto[b] - upto[a]
                    counts[number] += n_upto[b] - n_upto[a]
                    given[a:b] = -1
                left = np.flatnonzero(given >= 0)
                if len(left):
                    left = left[np.argsort(given[left], kind="stable")]
                    starts = np.flatnonzero(np.concatenate([[True], given[left][1:] != given[left][:-1]]))
                    sums[given[left][starts]] += np.add.reduceat(weighed[left], starts)
                    counts[given[left][starts]] += np.add.reduceat(weights[left], starts)
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = blocks.mapInArrow(run, "cluster int, n long, sums array<long>")
    exact = "decimal(38,0)"
    added = parts.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum(F.col("n").cast(exact)).alias("n"), F.sum(F.col("x").cast(exact)).alias("x")).collect()
    found: dict[int, tuple[int, list[int]]] = {}
    for r in added:
        found.setdefault(r.cluster, (int(r.n), [0] * width))[1][r.i] = int(r.x)
    return found


def _labels(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, numbers = _centroid_tree(centroids)
        for batch in batches:
            for ids, block in zip(batch.column("ids"), batch.select(["owners", *_TREE]).to_pylist(), strict=True):
                tree, owners = Tree.unpacked([block[x] for x in _TREE], width), np.frombuffer(block["owners"], "<i4")
                _, given = walk(tree, ends, numbers)
                apart = ((tree.points.astype(np.int64) - centroids[given]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(given[owners].astype(np.int32)), pa.array(apart[owners])], ["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, and the centroids."""
    rows = integer_vectors(vectors, width, scale)
    hashed = rows.where("vec_id IS NOT NULL").withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = np.array([r.v for r in hashed.orderBy("hash", "v").select("v").limit(max(ANCHORS, k)).collect()], dtype=np.int64).reshape(-1, width)
    if not len(first):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), first
    dealt = stored(_dealt(rows, first, width), "dealt_vectors")
    blocks = stored(_blocks(dealt, width), "vector_trees")
    centroids = first[:k].copy()
    for _ in range(rounds):
        for number, (n, total) in _sums(blocks, centroids).items():
            centroids[number] = [x // n for x in total]
    return _labels(blocks, centroids), centroids


def digests(vectors: DataFrame, k: int = 40, rounds: int = 5) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector."""
    spark = vectors.sparkSession
    found, centroids = cluster(vectors, k, rounds)
    found = stored(found, "labels")
    inertia = {r.cluster: int(r.inertia) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    held = lambda x: min(x, 2**63 - 1)
    rows = [(c, held(x), held(sum(inertia.values())), hashlib.sha256(",".join(str(v) for v in centroids[c].tolist()).encode()).hexdigest()) for c, x in inertia.items()]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row a centroid
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5) -> str:
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, e) - 1 AS INT) AS cluster, e FROM (SELECT sha256('2:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        apart = "CAST(list_dot_product(v.e, v.e) + list_dot_product(c.e, c.e) - 2 * list_dot_product(v.e, c.e) AS BIGINT)"
        steps.append(f"a{r} AS MATERIALIZED (SELECT row_id, min({{'d': {apart}, 'c': c.cluster}}) AS m FROM v, c{r} c GROUP BY row_id)")
        if r < rounds:
            steps.append(
                f"s{r} AS (SELECT m.c AS cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT a.m, unnest(v.e) AS x, unnest(range(64)) AS i FROM a{r} a JOIN v USING (row_id)) GROUP BY 1, 2),"
                f" c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.e, c.e) AS e FROM c{r} c LEFT JOIN"
                f" (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM s{r} GROUP BY cluster) n USING (cluster))"
            )
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, m.c AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (row_id) JOIN c{rounds} c ON c.cluster = m.c"
    )


SQL = _sql()
