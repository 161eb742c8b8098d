"""Labels: orientation, clusters, and their assignment to endpoints and lines."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import point_box_distance
from .connections import attach_to_connection
from .grid import box_pairs
from .grouped import per_group
from .stages import written


def text_orientation(boxes: DataFrame) -> DataFrame:
    """Adds orientation: at least as wide as high is horizontal."""
    return boxes.withColumn("orientation", F.when(F.col("x2") - F.col("x1") >= F.col("y2") - F.col("y1"), "horizontal").otherwise("vertical"))


def _clusters(along: list[float], across: list[float], long_: list[float], wide: list[float]) -> list[int]:
    """Cluster of each box, boxes coming in order of `along`. A box joins the first active box with which it
    is in line (centres across within 0.4 of the larger width) and close (gap along from -0.4 to under 0.6
    of the larger length); one that joins none ends those that are more than 1.6 lengths behind."""
    out: list[int] = []
    active: list[int] = []
    for i in range(len(along)):
        joined = None
        for a in active:
            centre = abs((across[i] + wide[i] / 2) - (across[a] + wide[a] / 2))
            gap, size = along[i] - (along[a] + long_[a]), max(long_[i], long_[a])
            if centre < 0.4 * max(wide[i], wide[a]) and -0.4 * size <= gap < 0.6 * size:
                joined = out[a]
                break
        if joined is None:
            active = [a for a in active if abs(along[i] - along[a]) < long_[a] * 1.6]
            joined = max(out, default=-1) + 1
        out.append(joined)
        active.append(i)
    return out


def cluster_text_boxes(boxes: DataFrame) -> DataFrame:
    """(diagram_id, label_id, cluster_id, pos): vertical texts side by side first, then horizontal ones below
    each other; pos counts a cluster's boxes in reading order. Order decides, so a diagram is one task's."""

    def cluster(_: tuple, rows: list[tuple]) -> list[tuple]:
        out, base = [], 0
        for upright in (True, False):
            some = [r for r in rows if (r[3] - r[1] < r[4] - r[2]) == upright]
            some.sort(key=lambda r: (r[1], r[2], r[0]) if upright else (r[2], r[1], r[0]))
            x, y, w, h = ([f(r) for r in some] for f in (lambda r: r[1], lambda r: r[2], lambda r: r[3] - r[1], lambda r: r[4] - r[2]))
            ids = _clusters(x, y, w, h) if upright else _clusters(y, x, h, w)
            size: dict[int, int] = {}
            for r, i in zip(some, ids, strict=True):
                out.append((r[0], base + i, size.setdefault(i, 0)))
                size[i] += 1
            base += max(ids, default=-1) + 1
        return out

    return per_group([(boxes, ("label_id", "x1", "y1", "x2", "y2"))], ("diagram_id",), cluster, "label_id long, cluster_id long, pos long")


def cluster_bounds(clusters: DataFrame, boxes: DataFrame) -> DataFrame:
    """(diagram_id, cluster_id, x1, y1, x2, y2)."""
    joined = clusters.join(boxes, ["diagram_id", "label_id"])
    return joined.groupBy("diagram_id", "cluster_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def _scaled(boxes: DataFrame, reach: float, scales: DataFrame | None) -> tuple[DataFrame, Column]:
    """The boxes and the reach, times the diagram's scale (diagram_id, scale) if scales are given; 1 where it has none.
    Boxes with their reach are written, as box_pairs has them three times."""
    if scales is None:
        return boxes, F.lit(reach)
    known = scales.select("diagram_id", F.bround(reach * F.col("scale"), 3).alias("__reach"))
    return written(boxes.join(known, "diagram_id", "left"), "scaled"), F.coalesce("__reach", F.lit(reach))


def assignment_candidates(boxes: DataFrame, points: DataFrame, reach: float, scales: DataFrame | None = None) -> DataFrame:
    """(diagram_id, left_id, right_id, distance) of boxes (left_id, x1 .. y2) and points (right_id, x, y)
    within reach times the scale, the bounds compared before the distance."""
    boxes, reach = _scaled(boxes, reach, scales)
    around = (F.col("x1") - reach, F.col("y1") - reach, F.col("x2") + reach, F.col("y2") + reach)
    near = box_pairs(boxes, points.select("diagram_id", "right_id", "x", "y"), around, (F.col("x"), F.col("y"), F.col("x"), F.col("y")))
    d = point_box_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return near.withColumn("distance", d).where(F.col("distance") <= reach).select("diagram_id", "left_id", "right_id", "distance")


def near_segments(boxes: DataFrame, lines: DataFrame, reach: float, scales: DataFrame | None = None) -> DataFrame:
    """Segments (diagram_id, right_id, x, y, u, v), for line_candidates, of the lines (right_id, path) whose bounds come
    within reach times the scale of any box: a line has hundreds of them, and most lines are near no box."""
    boxes, reach = _scaled(boxes, reach, scales)
    around = (F.col("x1") - reach, F.col("y1") - reach, F.col("x2") + reach, F.col("y2") + reach)
    side = {f"l{c}{i}": f(F.col(f"path.{c}")) for i, f in ((1, F.array_min), (2, F.array_max)) for c in "xy"}
    bounds = lines.where("path IS NOT NULL").select("diagram_id", "right_id", *(c.alias(n) for n, c in side.items()))
    met = box_pairs(boxes, bounds, around, tuple(F.col(n) for n in side)).select("diagram_id", "right_id").distinct()
    steps = F.arrays_zip(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(1))).alias("a"), F.when(F.size("path") > 1, F.slice("path", F.lit(2), F.size("path"))).otherwise(F.col("path")).alias("b"))
    some = lines.where("path IS NOT NULL").join(met.hint("merge"), ["diagram_id", "right_id"], "left_semi")
    return some.select("diagram_id", "right_id", F.explode(steps).alias("s")).select("diagram_id", "right_id", F.col("s.a.x").alias("x"), F.col("s.a.y").alias("y"), F.col("s.b.x").alias("u"), F.col("s.b.y").alias("v"))


def line_candidates(boxes: DataFrame, segments: DataFrame, reach: float, scales: DataFrame | None = None) -> DataFrame:
    """As assignment_candidates, for lines given as their segments (right_id, x, y, u, v). The distance of a
    box and a segment is the least between an end or corner of one and the other; 0 where they meet."""
    boxes, reach = _scaled(boxes, reach, scales)
    around = (F.col("x1") - reach, F.col("y1") - reach, F.col("x2") + reach, F.col("y2") + reach)
    near = box_pairs(boxes, segments.select("diagram_id", "right_id", "x", "y", "u", "v"), around, (F.least("x", "u"), F.least("y", "v"), F.greatest("x", "u"), F.greatest("y", "v")))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ends = [point_box_distance(F.col(a), F.col(b), F.col("x1"), F.col("y1"), w, h) for a, b in (("x", "y"), ("u", "v"))]
    dx, dy = F.col("u") - F.col("x"), F.col("v") - F.col("y")
    size = dx * dx + dy * dy

    def corner(cx: Column, cy: Column) -> Column:
        t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((cx - F.col("x")) * dx + (cy - F.col("y")) * dy) / size))).otherwise(0.0)
        ex, ey = F.col("x") + t * dx - cx, F.col("y") + t * dy - cy
        return F.sqrt(ex * ex + ey * ey)

    side = lambda cx, cy: dx * (cy - F.col("y")) - dy * (cx - F.col("x"))
    spots = [(F.col(a), F.col(b)) for a in ("x1", "x2") for b in ("y1", "y2")]
    sides = [side(*c) for c in spots]
    meets = (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0) & (F.greatest("x", "u") >= F.col("x1")) & (F.least("x", "u") <= F.col("x2")) & (F.greatest("y", "v") >= F.col("y1")) & (F.least("y", "v") <= F.col("y2"))
    d = F.when(meets, F.lit(0.0)).otherwise(F.least(*ends, *(corner(*c) for c in spots)))
    found = near.withColumn("distance", d).where(F.col("distance") <= reach)
    return found.groupBy("diagram_id", "left_id", "right_id").agg(F.min("distance").alias("distance"))


def greedy(pairs: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """Pairs by rising distance, each side once."""
    lefts, rights, out = set(), set(), []
    for _, a, b in sorted(pairs):
        if a not in lefts and b not in rights:
            lefts.add(a), rights.add(b)
            out.append((a, b))
    return out


#: A cost that no choice may have; costs are whole numbers of 1e-9.
_NEVER = np.int64(1) << 60


def _priced(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Column of each row at least total cost, and the dual prices of rows and columns, from a matrix of longs
    with no more rows than columns; None if a cost of _NEVER is needed. Shortest augmenting paths; columns
    that stay free have price 0, others at most 0."""
    n, m = cost.shape
    if n > m:
        return None
    u, v = np.zeros(n + 1, dtype=np.int64), np.zeros(m + 1, dtype=np.int64)
    row_of = np.zeros(m + 1, dtype=np.int64)
    for i in range(1, n + 1):
        row_of[0], column = i, 0
        least, used, came = np.full(m + 1, _NEVER), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=np.int64)
        while row_of[column]:
            used[column] = True
            r = row_of[column]
            reduced = cost[r - 1] - u[r] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], came[1:][better] = reduced[better], column
            free = np.where(used[1:], _NEVER, least[1:])
            step = free.min()
            if step >= _NEVER // 2:
                return None
            column_next = int(free.argmin()) + 1
            u[row_of[used]] += step
            v[used] -= step
            least[~used] -= step
            column = column_next
        while column:
            row_of[column] = row_of[came[column]]
            column = came[column]
    out = np.zeros(n, dtype=np.int64)
    held = np.flatnonzero(row_of[1:])
    out[row_of[1:][held] - 1] = held
    return out, u[1:], v[1:]


def hungarian(cost: np.ndarray) -> list[int] | None:
    """Column of each row at least total cost, to nine places, rows no more than columns; None if an infinite
    cost is needed."""
    found = _priced(np.where(np.isfinite(cost), np.rint(np.where(np.isfinite(cost), cost, 0) * 1e9), float(_NEVER)).astype(np.int64))
    return None if found is None else found[0].tolist()


def _first_of_equals(cost: np.ndarray, chosen: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of all choices of the same total cost, that whose columns come first, row by row. They are the perfect
    matchings of the tight pairs (cost equal to the prices), where a free column belongs to one of as many
    rows that cost nothing. A row may change to a column if whoever has that can, by alternating pairs of rows
    that are still to come, be led to the column which the row leaves."""
    n, m = cost.shape
    tight = np.zeros((m, m), dtype=bool)
    tight[:n] = cost - u[:, None] - v[None, :] == 0
    tight[n:] = v == 0
    column_of = np.concatenate([chosen, np.setdiff1d(np.arange(m), chosen)])
    row_of = np.empty(m, dtype=np.int64)
    row_of[column_of] = np.arange(m)
    for i in range(n):
        leaves = column_of[i]
        wanted = np.flatnonzero(tight[i, :leaves])
        wanted = wanted[row_of[wanted] > i]
        if not len(wanted):
            continue
        onward = np.full(m, -1, dtype=np.int64)  # the column to which a row can change
        reached = np.array([leaves])
        while len(reached):
            new = tight[:, reached].any(axis=1) & (onward < 0)
            new[: i + 1] = False
            rows = np.flatnonzero(new)
            onward[rows] = reached[tight[np.ix_(rows, reached)].argmax(axis=1)]
            reached = column_of[rows]
        able = wanted[onward[row_of[wanted]] >= 0]
        if len(able):
            row, column = i, able[0]
            while True:
                pushed, row_of[column], column_of[row] = row_of[column], row, column
                if column == leaves:
                    break
                row, column = pushed, onward[pushed]
    return column_of[:n]


#: So many choices of a right item for each left one are tried in turn; more are left to prices.
TRIALS = 512


def _tried(options: list[list[tuple[int, int]]]) -> list[int] | None:
    """The right item of each row at least total cost, from the rows' (right, cost) by rising right; of equal
    totals the first, as they are tried in that order; None if there is none."""
    rest = [0]
    for row in reversed(options):
        rest.append(rest[-1] + min(c for _, c in row))
    rest.reverse()
    least, found, chosen = None, None, []

    def on(i: int, total: int) -> None:
        nonlocal least, found
        if least is not None and total + rest[i] >= least:
            return
        if i == len(options):
            least, found = total, chosen[:]
            return
        for b, c in options[i]:
            if b not in chosen:
                chosen.append(b)
                on(i + 1, total + c)
                chosen.pop()

    on(0, 0)
    return found


def optimal(pairs: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """Every left item that has a pair exactly once, every right one at most once, at least total distance;
    if that cannot be, the greedy choice. Distances count to nine places; among equal optima it is the one
    whose right ids, in the order of left ids, come first."""
    lefts, rights = sorted({a for _, a, _ in pairs}), sorted({b for _, _, b in pairs})
    costs: dict[int, dict[int, int]] = {a: {} for a in lefts}
    for d, a, b in pairs:
        costs[a][b] = min(round(d * 1e9), costs[a].get(b, int(_NEVER)))
    if math.prod(map(len, costs.values())) <= TRIALS and max((c for row in costs.values() for c in row.values()), default=0) < _NEVER >> 10:
        chosen = _tried([sorted(row.items()) for row in costs.values()])
        return greedy(pairs) if chosen is None else list(zip(lefts, chosen, strict=True))
    row, column = ({x: i for i, x in enumerate(side)} for side in (lefts, rights))
    cost = np.full((len(lefts), len(rights)), _NEVER)
    for a, some in costs.items():
        for b, c in some.items():
            cost[row[a], column[b]] = c
    found = _priced(cost)
    if found is None:
        return greedy(pairs)
    return [(a, rights[j]) for a, j in zip(lefts, _first_of_equals(cost, *found).tolist(), strict=True)]


def _assign(candidates: DataFrame, choose) -> DataFrame:
    return per_group([(candidates, ("distance", "left_id", "right_id"))], ("diagram_id",), lambda _, pairs: choose(pairs), "left_id long, right_id long")


def optimal_assignment(candidates: DataFrame) -> DataFrame:
    """(diagram_id, left_id, right_id) by `optimal`, a diagram at a time."""
    return _assign(candidates, optimal)


def greedy_assignment(candidates: DataFrame) -> DataFrame:
    """(diagram_id, left_id, right_id) by `greedy`, a diagram at a time."""
    return _assign(candidates, greedy)


def decode_multiplicity(assigned: DataFrame) -> DataFrame:
    """The text of each multiplicity class: STAR is `*`; struck and unclassified ones go."""
    return assigned.where("choice IS NOT NULL AND choice <> 'Struck'").withColumn("multiplicity", F.when(F.col("choice") == "STAR", "*").otherwise(F.col("choice"))).drop("choice")


def multiplicity_pairs(boxes: DataFrame, points: DataFrame, scales: DataFrame, reach: float = 40.0) -> DataFrame:
    """(diagram_id, label_id, endpoint_index): multiplicity boxes (label_id, x1 .. y2) by `optimal` to points
    (endpoint_index, x, y) within reach times the scale."""
    found = assignment_candidates(boxes.withColumnRenamed("label_id", "left_id"), points.withColumnRenamed("endpoint_index", "right_id"), reach, scales)
    return optimal_assignment(found).withColumnsRenamed({"left_id": "label_id", "right_id": "endpoint_index"})


def decode_pairs(pairs: DataFrame, choices: DataFrame, links: DataFrame) -> DataFrame:
    """(diagram_id, label_id, endpoint_index, multiplicity, rel_index, side): pairs decoded by their choices
    (label_id, choice), then put to the first connection of the endpoint."""
    return attach_to_connection(decode_multiplicity(pairs.join(choices.select("diagram_id", "label_id", "choice"), ["diagram_id", "label_id"])), links)


def assign_multiplicities(boxes: DataFrame, choices: DataFrame, points: DataFrame, links: DataFrame, scales: DataFrame, reach: float = 40.0) -> DataFrame:
    """multiplicity_pairs, decoded. Boxes that are dropped in decoding have taken their endpoint."""
    return decode_pairs(multiplicity_pairs(boxes, points, scales, reach), choices, links)
