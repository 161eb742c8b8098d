"""From thinned lines to paths between line ends.

Pixels: (diagram_id, y, x). Crossings: (diagram_id, crossing_index, x, y, w, h). Endpoints: (diagram_id,
endpoint_index, x, y). Lines are followed many diagrams at a time, each diagram within one task."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import per_batch, per_group
from .stages import written

STEPS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def split_overlapping_crossings(crossings: DataFrame) -> DataFrame:
    """Crossing boxes that overlap are drawn back by half of it each along its thinner side, at least 1 px
    staying; pairs in order of their indexes, each on what the ones before left."""

    def part(a: list[float], b: list[float], at: int, cut: float) -> None:
        """Draws the first of two boxes back at its end and the second at its start, along axis at."""
        near, far = (a, b) if a[at] < b[at] else (b, a)
        near[at + 2] = max(1.0, near[at + 2] - cut)
        far[at] += cut
        far[at + 2] = max(1.0, far[at + 2] - cut)

    def split(_: tuple, rows: list[tuple]) -> list[tuple]:
        rows = sorted(rows)
        boxes = [list(r[1:]) for r in rows]
        for i, a in enumerate(boxes):
            for b in boxes[i + 1 :]:
                over = [min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k]) for k in (0, 1)]
                if min(over) > 0:
                    at = 1 if over[1] < over[0] else 0
                    part(a, b, at, over[at] / 2)
        return [(r[0], *b) for r, b in zip(rows, boxes, strict=True)]

    return per_group([(crossings, ("crossing_index", "x", "y", "w", "h"))], ("diagram_id",), split, "crossing_index long, x double, y double, w double, h double")


def _whole_boxes(crossings: DataFrame) -> DataFrame:
    """Crossing boxes with all four numbers made whole, as x1, y1 and, not of them any more, x2, y2."""
    at = lambda c: F.col(c).cast("long")
    return crossings.select("diagram_id", "crossing_index", at("x").alias("x1"), at("y").alias("y1"), (at("x") + at("w")).alias("x2"), (at("y") + at("h")).alias("y2"))


def crossing_border_points(pixels: DataFrame, crossings: DataFrame) -> DataFrame:
    """(diagram_id, crossing_index, y, x): line pixels on the outermost rows and columns of a crossing's box."""
    inside = (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2"))
    rim = (F.col("x") == F.col("x1")) | (F.col("x") == F.col("x2") - 1) | (F.col("y") == F.col("y1")) | (F.col("y") == F.col("y2") - 1)
    return pixels.join(_whole_boxes(crossings), "diagram_id").where(inside & rim).select("diagram_id", "crossing_index", "y", "x")


def crossing_outside_neighbours(pixels: DataFrame, crossings: DataFrame, borders: DataFrame | None = None) -> DataFrame:
    """(diagram_id, crossing_index, y, x, ny, nx): for each border point the line pixels that touch it from
    outside the box. They are looked up by equality: each border point asks for its eight places. borders: the
    crossing_border_points, if they are there already."""
    borders = (crossing_border_points(pixels, crossings) if borders is None else borders).join(_whole_boxes(crossings), ["diagram_id", "crossing_index"])
    around = F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in STEPS))
    asked = borders.withColumn("n", F.explode(around)).withColumns({"ny": F.col("n.y"), "nx": F.col("n.x")})
    outside = asked.where("nx < x1 OR nx >= x2 OR ny < y1 OR ny >= y2").select("diagram_id", "crossing_index", "y", "x", "ny", "nx")
    return outside.hint("merge").join(pixels.select("diagram_id", F.col("y").alias("ny"), F.col("x").alias("nx")), ["diagram_id", "ny", "nx"]).select("diagram_id", "crossing_index", "y", "x", "ny", "nx")


def snap_endpoints(endpoints: DataFrame, pixels: DataFrame, cell: int = 16) -> DataFrame:
    """(diagram_id, endpoint_index, py, px): the nearest line pixel, the first in row order on ties; of
    endpoints that share one the last has it. Pixels lie in a grid, and an endpoint looks at its own cell and
    the eight around it: what is found within a cell's length is the nearest. Endpoints that find none so
    near look at all pixels of their diagram. Both sides of the joins are dealt out, as Spark
    takes the nine rows of an endpoint for one."""
    place = lambda c: F.floor(F.col(c) / cell)
    p = pixels.select("diagram_id", F.col("y").alias("py"), F.col("x").alias("px"), place("y").alias("cy"), place("x").alias("cx"))
    d = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    nearest = F.min(F.struct(d.alias("d"), F.col("py"), F.col("px"))).alias("s")
    ends = endpoints.select("diagram_id", "endpoint_index", "x", "y")
    around = F.array(*(F.struct((place("y") + dy).alias("cy"), (place("x") + dx).alias("cx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    asked = ends.withColumn("c", F.explode(around)).select(*ends.columns, "c.cy", "c.cx")
    close = asked.hint("merge").join(p, ["diagram_id", "cy", "cx"]).groupBy("diagram_id", "endpoint_index").agg(nearest).where(F.col("s.d") <= cell * cell)
    far = ends.join(close.hint("merge"), ["diagram_id", "endpoint_index"], "left_anti").join(p.hint("merge"), "diagram_id").groupBy("diagram_id", "endpoint_index").agg(nearest)
    owner = F.row_number().over(Window.partitionBy("diagram_id", "s.py", "s.px").orderBy(F.col("endpoint_index").desc()))
    return close.unionByName(far).withColumn("__at", owner).where("__at = 1").select("diagram_id", "endpoint_index", F.col("s.py").alias("py"), F.col("s.px").alias("px"))


#: Places of pixels in the order array of one wave; more sources wait for the next.
WAVE = 1 << 24

#: Steps by column and then row: in this order a border point is left.
_LEAVING = sorted(range(8), key=lambda k: STEPS[k][::-1])


def _code(y: Column, x: Column) -> Column:
    """A pixel as one number, in row order."""
    return y.cast("long") * (1 << 32) + x.cast("long")


@dataclass
class Drawn:
    """Pixels that are worked out from fewer rows where they are used: a table, its columns, and what makes the pixels
    of a diagram, numbered y * 2 ** 32 + x, in any order, from its rows as tuples. So they are not moved."""

    rows: DataFrame
    columns: tuple[str, ...]
    ink: Callable[[list[tuple]], np.ndarray]


class _Ink:
    """The pixels of many diagrams, a diagram after the other, each in row order: where a diagram's begin (first), their
    places (y, x), and for each the numbers of its eight neighbours (near), -1 for none."""

    def __init__(self, inks: list[np.ndarray]) -> None:
        inks = [np.unique(ink) for ink in inks]
        sizes = [len(ink) for ink in inks]
        self.first = np.cumsum([0, *sizes])
        codes = np.concatenate([*inks, np.zeros(0, dtype=np.int64)]).astype(np.int64, copy=False)
        self.y = (codes + (1 << 31)) >> 32
        self.x = codes - (self.y << 32)
        width, base, at = np.ones(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=np.int64), 0
        for i, n in enumerate(sizes):
            if n:
                own = slice(self.first[i], self.first[i + 1])
                left, top = int(self.x[own].min()), int(self.y[own][0])
                width[own] = w = int(self.x[own].max()) - left + 3
                base[own] = at - top * w - left + 1
                at += (int(self.y[own][-1]) - top + 3) * w
        told = np.append(base + self.y * width + self.x, [at + (1 << 40)] * 3)
        n, here = len(codes), np.arange(len(codes), dtype=np.int32)
        self.near = np.full((n, 8), -1, dtype=np.int32)
        side = np.flatnonzero(told[1 : n + 1] == told[:n] + 1)
        self.near[side, 4], self.near[side + 1, 3] = side + 1, side
        below = np.searchsorted(told, told[:n] + width - 1)
        for k, shift in ((5, -1), (6, 0), (7, 1)):
            hit = told[below] == told[:n] + width + shift
            self.near[hit, k] = below[hit]
            self.near[below[hit], 7 - k] = here[hit]
            below = below + hit


class _Lines:
    """The pixels of one diagram, (y, x) each, numbered in row order."""

    def __init__(self, ink: list[tuple]) -> None:
        self.ink = _Ink([np.array([y * (1 << 32) + x for y, x in ink], dtype=np.int64)])
        self.points = list(zip(self.ink.y.tolist(), self.ink.x.tolist(), strict=True))


class _Source:
    """Where a line is followed from: the first pixels, one that is never entered, and which stops count."""

    def __init__(self, lines: int, own: int, group: int, starts: list[int], barred: int) -> None:
        self.lines, self.own, self.group, self.starts, self.barred = lines, own, group, starts, barred


def follow(lines: list[_Lines], stops: list[np.ndarray], groups: list[np.ndarray], sources: list[_Source]) -> list[list[int]]:
    """For each source the pixels from one of its starts to the first stop that counts, breadth first; none
    where there is no way. stops: of each diagram's pixels, the number of the stop there or -1; groups: of each
    stop, its group or -1; a source's own stop and those of its group don't count.

    A wave goes out from all sources at once, a ring of pixels a step. Within a ring, pixels are in the order
    of the first pixel of the last ring that touches them, and then of STEPS; that numbers the pixels of a
    source. A path goes back from a pixel to the one with the next smaller number among those it touches."""
    first = np.cumsum([0, *(len(x.points) for x in lines)])
    near = np.concatenate([np.where(x.ink.near >= 0, x.ink.near + first[i], -1) for i, x in enumerate(lines)])
    stop_first = np.cumsum([0, *map(len, groups)])
    stop = np.concatenate([np.where(x >= 0, x + stop_first[i], -1) for i, x in enumerate(stops)])
    moved = [_Source(s.lines, s.own + stop_first[s.lines], s.group, [p + first[s.lines] for p in s.starts], s.barred + first[s.lines] if s.barred >= 0 else -1) for s in sources]
    begin, flat = _ways(near, first, stop, np.concatenate(groups), moved)
    return [(flat[begin[i] : begin[i + 1]] - first[s.lines]).tolist() for i, s in enumerate(sources)]


def _ways(near: np.ndarray, first: np.ndarray, stop: np.ndarray, group: np.ndarray, sources: list[_Source]) -> tuple[np.ndarray, np.ndarray]:
    """The ways of follow, one after the other, and where each begins; pixels, stops and diagrams in a row."""
    of = np.array([s.lines for s in sources], dtype=np.int64)
    sizes = (first[1:] - first[:-1])[of]
    upto, lens, flat, at = np.cumsum(sizes), [], [], 0
    order = None
    while at < len(sources):
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + WAVE, side="right")))
        if order is None or len(order) < upto[end - 1] - before:
            order = np.full(int(upto[end - 1] - before), -1, dtype=np.int32)
        shift = upto[at:end] - sizes[at:end] - before - first[of[at:end]]  # from a pixel to its place in the order array
        n, way = _wave(near, stop, group, sources[at:end], shift, order)
        lens.append(n)
        flat.append(way)
        at = end
    return np.concatenate([[0], *lens]).cumsum(), np.concatenate([*flat, np.zeros(0, dtype=np.int64)])


def _wave(near: np.ndarray, stop: np.ndarray, group: np.ndarray, sources: list[_Source], shift: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the sources' ways, and the ways. order: -1 everywhere, and so again afterwards."""
    own = np.array([s.own for s in sources])
    own_group = np.array([s.group for s in sources])
    barred = np.array([s.barred if s.barred >= 0 else -2 for s in sources])
    ended = np.full(len(sources), -1, dtype=np.int64)
    source = np.repeat(np.arange(len(sources)), [len(s.starts) for s in sources])
    pixel = np.array([p for s in sources for p in s.starts], dtype=np.int64)
    fit = pixel != barred[source]
    source, pixel = source[fit], pixel[fit]
    keys, counter, seen = shift[source] + pixel, 0, []
    while len(source):
        number = np.arange(counter, counter + len(keys), dtype=np.int32)
        counter += len(keys)
        order[keys[::-1]] = number[::-1]
        once = order[keys] == number  # what comes first has the last word
        source, pixel, keys = source[once], pixel[once], keys[once]
        seen.append(keys)
        here = stop[pixel]
        at = np.flatnonzero(here >= 0)
        if len(at):
            s, h = source[at], here[at]
            at = at[(h != own[s]) & ~((own_group[s] >= 0) & (group[h] == own_group[s]))][::-1]
            ended[source[at]] = pixel[at]
            still = ended[source] < 0
            source, pixel = source[still], pixel[still]
        around = near[pixel]
        real = around >= 0
        source, pixel = np.repeat(source, real.sum(axis=1)), around[real].astype(np.int64)
        keys = shift[source] + pixel
        new = (order[keys] < 0) & (pixel != barred[source])
        source, pixel, keys = source[new], pixel[new], keys[new]

    source = np.flatnonzero(ended >= 0)
    pixel, steps = ended[source], []
    while len(source):
        steps.append((source, pixel))
        around = near[pixel]
        keys = shift[source][:, None] + around
        real = (around >= 0) & (around != barred[source][:, None])
        keys[~real] = 0
        numbers = np.where(real, order[keys], -1)
        numbers[numbers >= order[shift[source] + pixel][:, None]] = -1
        best = numbers.argmax(axis=1)
        at = np.arange(len(source))
        back = numbers[at, best] >= 0
        source, pixel = source[back], around[at, best][back].astype(np.int64)
    for keys in seen:
        order[keys] = -1
    lens = np.zeros(len(sources), dtype=np.int64)
    for source, _ in steps:
        lens[source] += 1
    last = lens.cumsum() - 1
    flat = np.zeros(int(lens.sum()), dtype=np.int64)
    for k, (source, pixel) in enumerate(steps):
        flat[last[source] - k] = pixel
    return lens, flat


def _nearest(codes: np.ndarray, py: np.ndarray, px: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each of the points the number of the nearest pixel, the first on ties; pixels are in row order."""
    exact = (y == np.floor(y)) & (x == np.floor(x)) & (np.abs(y) < 1 << 30) & (np.abs(x) < 1 << 30)
    want = np.where(exact, y, 0).astype(np.int64) * (1 << 32) + np.where(exact, x, 0).astype(np.int64)
    at = np.minimum(np.searchsorted(codes, want), len(codes) - 1)
    rest = np.flatnonzero(~exact | (codes[at] != want))
    some = max(1, (1 << 20) // len(codes))
    for i in range(0, len(rest), some):
        r = rest[i : i + some]
        at[r] = ((x[r, None] - px) * (x[r, None] - px) + (y[r, None] - py) * (y[r, None] - py)).argmin(axis=1)
    return at


def _snapped(ink: _Ink, d: int, ends: list[tuple]) -> list[tuple[int, int]]:
    """(endpoint_index, pixel) by index, for ends (endpoint_index, x, y); of those that share a pixel the last has it."""
    own = slice(ink.first[d], ink.first[d + 1])
    y, x = ink.y[own], ink.x[own]
    if not ends or not len(y):
        return []
    ends = sorted(ends, key=lambda r: r[0])
    places = np.array([r[1:] for r in ends], dtype=float)
    last = dict(zip(_nearest(y * (1 << 32) + x, y, x, places[:, 1], places[:, 0]).tolist(), (r[0] for r in ends), strict=True))
    return sorted((i, p + int(ink.first[d])) for p, i in last.items())


def _borders(ink: _Ink, d: int, boxes: list[tuple]) -> list[tuple[int, int, list[int]]]:
    """(crossing_index, pixel, pixels that touch it from outside the box) for the line pixels on the outermost rows and
    columns of crossing boxes, in order of index and row, those outside by column and row."""
    out = []
    own = slice(ink.first[d], ink.first[d + 1])
    y, x, begin = ink.y[own], ink.x[own], int(ink.first[d])
    boxes = sorted((k, int(left), int(top), int(left) + int(w), int(top) + int(h)) for k, left, top, w, h in boxes)
    for (k, x1, y1, x2, y2), low, high in zip(boxes, np.searchsorted(y, [b[2] for b in boxes]), np.searchsorted(y, [b[4] for b in boxes]), strict=True):
        if low >= high:
            continue
        ys, xs = y[low:high], x[low:high]
        rim = (xs >= x1) & (xs < x2) & ((xs == x1) | (xs == x2 - 1) | (ys == y1) | (ys == y2 - 1))
        for p in (np.flatnonzero(rim) + low + begin).tolist():
            around = [n for n in ink.near[p][_LEAVING].tolist() if n >= 0]
            out.append((k, p, [n for n in around if not (x1 <= ink.x[n] < x2 and y1 <= ink.y[n] < y2)]))
    return out


_CENTRE, _END = "c{}", "e{}"
_PATH = "array<struct<x:double,y:double>>"


def _edges(groups: list[tuple], arrow: pa.Schema, snap: bool, draw: Callable[[list[tuple]], np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Edges (key, a, b, path) of the line graphs of a batch of diagrams."""
    ink = _Ink([draw(g[1]) if draw else g[1] for g in groups])
    number = [dict(zip(zip(ink.y[a:b].tolist(), ink.x[a:b].tolist(), strict=True), range(a, b), strict=True)) if not snap else None for a, b in zip(ink.first[:-1].tolist(), ink.first[1:].tolist(), strict=True)]
    names, crossings, owner = [], [], []  # of all stops
    stop = np.full(len(ink.y), -1, dtype=np.int64)
    sources, tied = [], []
    for d, (_, _, ends, boxes) in enumerate(groups):
        centre = {k: (int(x) + int(w) / 2, int(y) + int(h) / 2) for k, x, y, w, h in boxes}
        spots, starts = {}, {}
        group = {k: i for i, k in enumerate(centre)}
        for n, (k, p, outside) in enumerate(_borders(ink, d, boxes)):
            spots[p] = len(names)
            starts[len(names)] = outside
            tied.append((len(names), k, p, *centre[k]))
            names.append(f"b{k}.{n}")
            crossings.append(group[k])
        for i, p in _snapped(ink, d, ends) if snap else ((i, number[d][y, x]) for i, y, x in sorted(ends)):
            spots[p] = len(names)
            names.append(_END.format(i))
            crossings.append(-1)
        owner += [d] * (len(names) - len(owner))
        for p, n in spots.items():
            stop[p] = n
            k = crossings[n]
            sources.append(_Source(d, n, k, [p] if k < 0 else starts[n], -1 if k < 0 else p))
    begin, flat = _ways(ink.near, ink.first, stop, np.array(crossings, dtype=np.int64), sources)
    had = np.flatnonzero(begin[1:] > begin[:-1])
    own = np.array([s.own for s in sources], dtype=np.int64)[had]
    there = stop[flat[begin[had + 1] - 1]]
    # of both directions the path that is less stays
    points = lambda i: list(zip(ink.x[way].tolist(), ink.y[way].tolist(), strict=True)) if len(way := flat[begin[had[i]] : begin[had[i] + 1]]) else []
    pair = np.lexsort((np.maximum(own, there), np.minimum(own, there)))  # stable: the one that was followed first comes first
    twice = np.flatnonzero((own[pair[1:]] == there[pair[:-1]]) & (there[pair[1:]] == own[pair[:-1]]))
    one, two = pair[twice], pair[twice + 1]
    p, q = flat[begin[had[one]]], flat[begin[had[two]]]
    less = (ink.x[q] < ink.x[p]) | ((ink.x[q] == ink.x[p]) & (ink.y[q] < ink.y[p]))
    for i in np.flatnonzero(p == q):
        less[i] = points(two[i]) < points(one[i])
    stays = np.ones(len(had), dtype=bool)
    stays[np.where(less, one, two)] = False
    had, own, there = had[stays], own[stays], there[stays]
    lens = begin[had + 1] - begin[had]
    at = flat[np.repeat(begin[had] - (lens.cumsum() - lens), lens) + np.arange(int(lens.sum()))]
    tie = np.array([r[:3] for r in tied], dtype=np.int64).reshape(-1, 3)
    middle = np.array([r[3:] for r in tied], dtype=float).reshape(-1, 2)
    xs = np.concatenate([ink.x[at], np.stack([ink.x[tie[:, 2]], middle[:, 0]], axis=1).reshape(-1)]).astype(float)
    ys = np.concatenate([ink.y[at], np.stack([ink.y[tie[:, 2]], middle[:, 1]], axis=1).reshape(-1)]).astype(float)
    offsets = np.concatenate([[0], lens, np.full(len(tie), 2, dtype=np.int64)]).cumsum().astype(np.int32)
    told = pa.array([*names, *(_CENTRE.format(k) for k in tie[:, 1].tolist())], pa.string())
    a, b = np.concatenate([own, tie[:, 0]]), np.concatenate([there, len(names) + np.arange(len(tie))])
    whose = pa.array(np.array(owner, dtype=np.int64)[a])
    keys = [pa.array([g[0][i] for g in groups], arrow[i].type).take(whose) for i in range(len(groups[0][0]))]
    path = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(xs), pa.array(ys)], fields=list(arrow[-2].type.value_type)), type=arrow[-2].type)
    whose = np.array(owner, dtype=np.int64)[a]
    sizes = np.bincount(whose, minlength=len(groups))
    number = np.empty(len(a), dtype=np.int32)  # of each diagram's edges, from 0
    number[whose.argsort(kind="stable")] = np.arange(len(a)) - np.repeat(sizes.cumsum() - sizes, sizes)
    yield pa.RecordBatch.from_arrays([*keys, told.take(pa.array(a)), told.take(pa.array(b)), path, pa.array(number)], schema=arrow)


def trace_edges(pixels: DataFrame | Drawn, ends: DataFrame, crossings: DataFrame | None = None) -> DataFrame:
    """(diagram_id, a, b, path, edge): the line graph, its edges numbered. Nodes are endpoints `e<index>`, border points of crossings
    `b<crossing>.<n>` and their centres `c<crossing>`. A border point is tied to its centre, and followed from
    the pixels outside its box to the first endpoint or border point of another crossing; an endpoint is
    followed to the first other endpoint or border point. Of both directions of an edge the path which is
    less as a list of (x, y) stays, seen from its own start. An endpoint on a border point takes its place.

    ends: as snap_endpoints gives them, or (diagram_id, endpoint_index, x, y), which are then snapped as there. Pixels
    are by far the most of an extraction, and come to Python once: snapping, border points and what touches them are
    worked out beside the lines, of the pixels of one diagram, many diagrams a call."""
    none = ends.select("diagram_id", F.lit(0).cast("long").alias("crossing_index"), *(F.lit(0.0).alias(c) for c in "xywh")).where("false")
    boxes = none if crossings is None else crossings
    snap, draw = "py" not in ends.columns, pixels.ink if isinstance(pixels, Drawn) else None
    ink = (pixels.rows, pixels.columns) if draw else (pixels.where("y IS NOT NULL AND x IS NOT NULL").select("diagram_id", _code(F.col("y"), F.col("x")).alias("ink")), "ink")
    columns = ("endpoint_index", "x", "y") if snap else ("endpoint_index", "py", "px")
    return per_batch([ink, (ends, columns), (boxes, ("crossing_index", "x", "y", "w", "h"))], ("diagram_id",), lambda groups, arrow: _edges(groups, arrow, snap, draw), f"a string, b string, path {_PATH}, edge int", arrow=True)


def graph_nodes(endpoints: DataFrame, edges: DataFrame) -> DataFrame:
    """(diagram_id, node, kind, x, y) of a line graph: endpoints where they were seen, border points and
    centres where their edges say."""
    of_ends = endpoints.select("diagram_id", F.concat(F.lit("e"), F.col("endpoint_index").cast("string")).alias("node"), F.lit("endpoint").alias("kind"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    tied = edges.where("b LIKE 'c%'")
    at = lambda name, kind, i: tied.select("diagram_id", F.col(name).alias("node"), F.lit(kind).alias("kind"), F.col("path")[i]["x"].alias("x"), F.col("path")[i]["y"].alias("y"))
    return of_ends.unionByName(at("a", "border", 0)).unionByName(at("b", "crossing", 1).distinct())


#: Steps that a task takes on the paths of one diagram, or of a part of them, before what is still open is dealt anew.
ROUTE_STEPS = 100_000

#: Ended paths of one Arrow batch, and parts that open paths of one diagram are dealt to.
_ROUTE_ROWS, _ROUTE_PARTS = 4096, 1024


def _turned(before: tuple, at: tuple, after: tuple) -> float:
    """Degrees between the ways into and out of a place."""
    if None in (*before, *at, *after):
        return 0.0
    ux, uy, vx, vy = at[0] - before[0], at[1] - before[1], after[0] - at[0], after[1] - at[1]
    size = math.sqrt(ux * ux + uy * uy) * math.sqrt(vx * vx + vy * vy)
    return math.degrees(math.acos(max(-1.0, min(1.0, (ux * vx + uy * vy) / size)))) if size > 0 else 0.0


def _walk(begun: list[tuple], nodes: list[tuple], edges: list[tuple], most_nodes: int | None, most_steps: int) -> Iterator[tuple]:
    """(start, end, steps, turned, length) of the paths that go on from those begun (start, steps, turned, length), depth
    first; at last those that are still open after most_steps steps, with no end. So what is held is one path and the
    ways that leave it, however many paths there are."""
    number = {node: i for i, (node, *_) in enumerate(nodes)}
    places, kinds, names = [r[2:] for r in nodes], [r[1] for r in nodes], [r[0] for r in nodes]
    ways: list[list[tuple]] = [[] for _ in nodes]
    ends = {}
    for edge, a, b, n in edges:
        i, j = number.get(a), number.get(b)
        ends[edge + 1], ends[-edge - 1] = j, i
        if i is not None and j is not None:
            ways[i].append((j, edge + 1, n))
            ways[j].append((i, -edge - 1, n))
    turns: dict[tuple[int, int, int], float] = {}
    open_ = []
    for start, steps, turned, length in begun:
        way = (number[start], *(ends[s] for s in steps))
        open_.append((way, tuple(steps), turned, length))
    taken = 0
    while open_ and taken < most_steps:
        way, steps, turned, length = open_.pop()
        if most_nodes is not None and len(way) >= most_nodes:
            continue
        here = way[-1]
        bends = kinds[here] == "crossing" and len(way) > 1
        for there, step, n in ways[here]:
            if there in way:
                continue
            taken += 1
            turn = 0.0
            if bends:
                key = (way[-2], here, there)
                if (turn := turns.get(key)) is None:
                    turn = turns[key] = _turned(places[way[-2]], places[here], places[there])
            on = ((*way, there), (*steps, step), turned + turn, length + n)
            if kinds[there] == "endpoint":
                yield (names[way[0]], names[there], *on[1:], [names[i] for i in on[0]])
            else:
                open_.append(on)
    for way, *rest in open_:
        yield (names[way[0]], None, *rest, [names[i] for i in way])


def _routes(groups: list[tuple], arrow: pa.Schema, most_nodes: int | None, most_steps: int) -> Iterator[pa.RecordBatch]:
    made: list[tuple] = []
    named = "nodes" in arrow.names
    told = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)
    for (diagram, deal), begun, nodes, edges in groups:
        for *row, way in _walk(begun, nodes, edges, most_nodes, most_steps) if begun else ():
            made.append((diagram, deal, *row, way) if named else (diagram, deal, *row))
            if len(made) == _ROUTE_ROWS:
                yield told()
                made.clear()
    if made:
        yield told()


def enumerate_routes(nodes: DataFrame, edges: DataFrame, most_nodes: int | None = None, named: bool = False, most_steps: int = ROUTE_STEPS) -> DataFrame:
    """(diagram_id, start_index, endpoint_index, total_div, steps, path_len), with named also nodes: every path without
    a repeated node from an endpoint to the first other one. nodes: (diagram_id, node, kind, x, y), see graph_nodes;
    edges: (diagram_id, edge, a, b) with their path, or its size as n; edge: its number in the diagram, from 0. total_div
    sums the angles turned at crossings, in degrees; steps are the edges' numbers plus one, negative where they are gone
    from b to a; path_len sums their sizes. Paths of more than most_nodes are not followed; by default there is no such
    limit.

    Of one diagram there may be exponentially many. They are walked depth first, by tasks that hold one path each and
    hand on what has ended; after most_steps steps a task leaves what is open, a row a path, which is dealt by path to
    many tasks in the next round. Points don't come along, see with_points."""
    n = F.col("n") if "n" in edges.columns else F.size("path")
    nodes = nodes.select("diagram_id", "node", "kind", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    edges = edges.select("diagram_id", "edge", "a", "b", n.cast("long").alias("n"))
    begun = nodes.where("kind = 'endpoint'").select("diagram_id", F.col("node").alias("start"), F.array().cast("array<int>").alias("steps"), F.lit(0.0).alias("turned"), F.lit(0).cast("long").alias("n"))
    begun, parts = begun.withColumn("deal", F.lit(0)), None
    done: DataFrame | None = None
    while True:
        dealt = lambda df, parts=parts: df.withColumn("deal", F.lit(0)) if parts is None else df.hint("merge").join(parts.hint("merge"), "diagram_id")
        tables = [(begun, ("start", "steps", "turned", "n")), (dealt(nodes), ("node", "kind", "x", "y")), (dealt(edges), ("edge", "a", "b", "n"))]
        schema = "start string, end string, steps array<int>, turned double, n long" + ", nodes array<string>" * named
        on = written(per_batch(tables, ("diagram_id", "deal"), lambda groups, arrow: _routes(groups, arrow, most_nodes, most_steps), schema, arrow=True), "paths")
        ended = on.where("end IS NOT NULL")
        done = ended if done is None else done.unionByName(ended)
        begun = on.where("end IS NULL")
        if begun.isEmpty():
            break
        begun = begun.withColumn("deal", F.pmod(F.hash("start", "steps"), F.lit(_ROUTE_PARTS)))
        parts = begun.select("diagram_id", "deal").distinct()
    number = lambda node: F.substring(node, F.lit(2), F.length(node)).cast("long")
    return done.select("diagram_id", number(F.col("start")).alias("start_index"), number(F.col("end")).alias("endpoint_index"), F.round("turned", 2).alias("total_div"), *(["nodes"] if named else []), "steps", F.col("n").alias("path_len"))


#: A step beyond this is a stay at the endpoint whose index is so much less.
STAY = 1 << 40


def _pointed(batch: pa.RecordBatch, arrow: pa.Schema, steps_at: int) -> Iterator[pa.RecordBatch]:
    """Routes with their points: the places of all steps' points among those of the batch's edges."""
    groups = lambda column: np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    numbers = lambda array: array.to_numpy(zero_copy_only=False)
    sizes_of = lambda column: numbers(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    routes, edges, stays = batch.columns[-3:]
    whose, told = groups(routes), routes.flatten().flatten()
    if not len(whose):
        return
    (edge, xs, ys), (stay, stay_x, stay_y) = edges.flatten().flatten(), stays.flatten().flatten()
    own = np.concatenate([groups(edges), groups(stays)]) * (STAY << 2) + np.concatenate([numbers(edge).astype(np.int64), numbers(stay) + STAY - 1])
    sizes = np.concatenate([sizes_of(xs), np.ones(len(stay), dtype=np.int64)])
    begin = sizes.cumsum() - sizes
    x, y = (np.concatenate([numbers(a.flatten()), numbers(b)]) for a, b in ((xs, stay_x), (ys, stay_y)))
    steps, upto = told[steps_at], np.concatenate([[0], sizes_of(told[steps_at]).cumsum()])
    step = numbers(steps.flatten()).astype(np.int64)
    order = own.argsort()
    want = np.repeat(whose, np.diff(upto)) * (STAY << 2) + np.abs(step) - 1
    at = order[np.minimum(np.searchsorted(own[order], want), max(len(own) - 1, 0))] if len(want) else np.zeros(0, dtype=np.int64)
    if (own[at] != want).any():
        raise ValueError("a step along an edge that isn't there")
    n = sizes[at]
    ends = np.concatenate([[0], n.cumsum()])
    local = np.arange(int(ends[-1])) - np.repeat(ends[:-1], n)
    place = np.repeat(begin[at], n) + np.where(np.repeat(step < 0, n), np.repeat(n, n) - 1 - local, local)
    kind = arrow[-1].type
    values = pa.StructArray.from_arrays([pa.array(x[place]), pa.array(y[place])], fields=list(kind.value_type))
    mask = pa.array(numbers(pc.is_null(steps)).astype(bool))
    points = pa.ListArray.from_arrays(pa.array(ends[upto].astype(np.int32)), values, type=kind, mask=mask)
    columns = [*(c.take(pa.array(whose)) for c in batch.columns[:-3]), *told]
    yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(columns, arrow)), points], schema=arrow)  # noqa: B905


def with_points(routes: DataFrame, edges: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Routes (diagram_id, steps, ..) with path: the points of their edges (diagram_id, edge, path), the node between two
    edges coming twice; for a step of STAY and more the place of that endpoint (diagram_id, endpoint_index, x, y). Edges
    meet the routes of their diagram in one shuffle, and are not multiplied."""
    rest = [c for c in routes.columns if c != "diagram_id"]
    kinds = {f.name: f.dataType.simpleString() for f in routes.schema.fields}
    at = rest.index("steps")
    if ends is None:
        ends = routes.select("diagram_id", F.lit(0).cast("long").alias("endpoint_index"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).where("false")
    ends = ends.select("diagram_id", F.col("endpoint_index").cast("long").alias("endpoint_index"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    edges = edges.select("diagram_id", "edge", F.col("path.x").alias("xs"), F.col("path.y").alias("ys"))  # half the bytes
    tables = [(routes, tuple(rest)), (edges, ("edge", "xs", "ys")), (ends, ("endpoint_index", "x", "y"))]
    return per_batch(tables, ("diagram_id",), lambda batch, arrow: _pointed(batch, arrow, at), ", ".join(f"`{c}` {kinds[c]}" for c in rest) + f", path {_PATH}", raw=True)


def enumerate_paths(nodes: DataFrame, edges: DataFrame, most_nodes: int | None = None) -> DataFrame:
    """(diagram_id, start_index, endpoint_index, total_div, nodes, path): enumerate_routes with the nodes and points of
    each path. edges: (diagram_id, a, b, path), numbered if they are not. No side of a join is broadcast: stored tables
    pack so well that Spark takes large ones for small."""
    if "edge" not in edges.columns:
        edges = written(edges.withColumn("edge", F.row_number().over(Window.partitionBy("diagram_id").orderBy("a", "b", "path")) - 1), "edges")
    parts = enumerate_routes(nodes, edges, most_nodes, named=True).withColumn("path_id", F.monotonically_increasing_id()).drop("path_len")
    found = written(parts, "ended_paths")
    step = found.select("diagram_id", "path_id", F.posexplode("steps").alias("at", "step")).withColumn("edge", F.abs("step") - 1)
    points = F.when(F.col("step") < 0, F.reverse("path")).otherwise(F.col("path"))
    gone = step.join(edges.select("diagram_id", "edge", "path").hint("merge"), ["diagram_id", "edge"])
    joined = gone.groupBy("path_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", points.alias("points")))), lambda s: s["points"])).alias("path"))
    return found.hint("merge").join(joined, "path_id").select("diagram_id", "start_index", "endpoint_index", "total_div", "nodes", "path")
