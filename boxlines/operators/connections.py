"""Traced paths to connections between classes.

Paths: (diagram_id, start_index, endpoint_index, class_a, class_b, total_div, path_len). Connections keep
their order in rel_index. Steps that rewrite connections in order work within one diagram."""

from __future__ import annotations

from collections.abc import Callable
from operator import itemgetter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grouped import per_group
from .stages import bounded_broadcasts, bounded_parts
from .tracing import STAY

EMPTY = "Empty End"


def _bounded(df: DataFrame) -> DataFrame:
    return bounded_parts(bounded_broadcasts(df))


def path_probability(paths: DataFrame) -> DataFrame:
    """Adds probability (percent, by the inverse square of the turning) among the paths of one start, and
    its rank: on ties the earlier end comes first, then the shorter path, then that whose points (or, without
    points, classes) come first. So ranks don't depend on the order of the rows."""
    by = Window.partitionBy("diagram_id", "start_index")
    order = ["total_div", "endpoint_index", *(c for c in ("path_len", "path", "class_a", "class_b") if c in paths.columns)]
    paths = _bounded(paths)
    weight = 1.0 / F.pow(F.col("total_div") + 1e-6, F.lit(2.0))
    out = paths.withColumn("probability", 100 * weight / F.sum(weight).over(by))
    return out.withColumn("rank", F.row_number().over(by.orderBy(*order)).cast("long"))


def _good(paths: DataFrame, endpoints: DataFrame, scales: DataFrame | None, least: float) -> DataFrame:
    limit = F.lit(least)
    some = _bounded(paths).join(endpoints.where("n_endpoints > 2").select("diagram_id"), "diagram_id")
    if scales is not None:
        some, limit = some.join(scales, "diagram_id"), F.bround(least * F.col("scale"), 3)
    return some.where(~F.col("class_a").eqNullSafe(F.col("class_b")) | (F.col("path_len") > limit))


def best_connections(ranked: DataFrame, endpoints: DataFrame, scales: DataFrame | None = None, least: float = 30.0) -> DataFrame:
    """Each start's best path that joins two classes or is longer than least times the scale, in diagrams of
    more than two endpoints (diagram_id, n_endpoints)."""
    best = F.row_number().over(Window.partitionBy("diagram_id", "start_index").orderBy("rank"))
    return _good(ranked, endpoints, scales, least).withColumn("__at", best).where("__at = 1").drop("__at")


def first_paths(paths: DataFrame, endpoints: DataFrame, scales: DataFrame | None = None, least: float = 30.0) -> DataFrame:
    """best_connections of paths whose points aren't there yet: those that come first by turning, end and length, and
    n_first, how many do. Of several, the one whose points come first is the best."""
    by = Window.partitionBy("diagram_id", "start_index")
    good = _good(paths, endpoints, scales, least).withColumn("__at", F.rank().over(by.orderBy("total_div", "endpoint_index", "path_len")))
    return good.where("__at = 1").withColumn("n_first", F.count("*").over(by)).select(*paths.columns, "n_first")


def dedupe_undirected(connections: DataFrame) -> DataFrame:
    """The first of (a, b) and (b, a), by start_index; rel_index (from 0) numbers what stays."""
    key = [F.least("start_index", "endpoint_index"), F.greatest("start_index", "endpoint_index")]
    first = F.row_number().over(Window.partitionBy("diagram_id", *key).orderBy("start_index"))
    kept = _bounded(connections).withColumn("__at", first).where("__at = 1").drop("__at")
    return kept.withColumn("rel_index", (F.row_number().over(Window.partitionBy("diagram_id").orderBy("start_index")) - 1).cast("long"))


def final_connections(connections: DataFrame, least: float = 30.0, scales: DataFrame | None = None) -> DataFrame:
    """Drops connections without a class, from an endpoint to itself, and those within one class that are
    shorter than least times the scale."""
    some, limit = connections, F.lit(least)
    if scales is not None:
        some, limit = some.join(scales, "diagram_id", "left"), F.bround(least * F.coalesce("scale", F.lit(1.0)), 3)
    within = (F.col("class_a") == F.col("class_b")) & (F.col("path_len") < limit)
    return some.where(F.col("class_a").isNotNull() & F.col("class_b").isNotNull() & (F.col("start_index") != F.col("endpoint_index")) & ~within).select(*connections.columns)


def connection_endpoints(connections: DataFrame) -> DataFrame:
    """(diagram_id, endpoint_index, position): endpoints in use, in the order of their first use."""
    both = _bounded(connections).select("diagram_id", "rel_index", F.posexplode(F.array("start_index", "endpoint_index")).alias("side", "endpoint_index"))
    first = both.groupBy("diagram_id", "endpoint_index").agg(F.min(F.struct("rel_index", "side")).alias("first"))
    return first.select("diagram_id", "endpoint_index", (F.row_number().over(Window.partitionBy("diagram_id").orderBy("first")) - 1).cast("long").alias("position"))


_REWRITTEN = "rel_index long, start_index long, endpoint_index long, class_a long, class_b long, end_shape_0 string, end_shape_1 string, shape_score_0 double, shape_score_1 double, path_len long, path array<struct<x:double,y:double>>"
_LINK = tuple(c.split(" ")[0] for c in _REWRITTEN.split(", "))
_END = ("endpoint_index", "class_index", "end_shape", "shape_score", "x", "y")


def _told_columns(df: DataFrame, columns: tuple[str, ...]) -> tuple[tuple[str, ...], Callable[[list[tuple]], list[tuple]]]:
    """Those of the columns that df has, and what makes of rows of them rows of all: lacking scores are 1, all
    else null. So what df lacks isn't carried to Python."""
    had = tuple(c for c in columns if c in df.columns)
    if had == columns:
        return had, lambda rows: rows
    lacking = tuple(1.0 if c.startswith("shape_score") else None for c in columns if c not in had)
    place = [had.index(c) if c in had else len(had) + sum(x not in had for x in columns[:i]) for i, c in enumerate(columns)]
    pick = itemgetter(*place)
    return had, lambda rows: [pick((*r, *lacking)) for r in rows]


class _Net:
    """Connections of one diagram in order, keyed by their two endpoints. Shapes are (label, score)."""

    def __init__(self, rows: list[tuple]):
        self.links: dict[tuple[int, int], dict] = {}
        self.used: dict[int, dict[tuple[int, int], None]] = {}
        self.count = 0
        for _, a, b, class_a, class_b, shape_0, shape_1, score_0, score_1, length, path in sorted(rows, key=lambda r: r[0]):
            self.put((a, b), [class_a, class_b], [(shape_0, score_0), (shape_1, score_1)], length, path)

    def at(self, endpoint: int) -> dict | None:
        """The first connection of an endpoint."""
        used = self.used.get(endpoint)
        return self.links[min(used, key=lambda ends: self.links[ends]["order"])] if used else None

    def by_endpoint(self) -> dict[int, list[tuple[int, int]]]:
        out: dict[int, list[tuple[int, int]]] = {}
        for pair in self.links:
            for e in dict.fromkeys(pair):
                out.setdefault(e, []).append(pair)
        return out

    def put(self, ends: tuple[int, int], classes: list, shapes: list, length: int, path: list | None) -> None:
        order = self.links[ends]["order"] if ends in self.links else self.count
        self.count += 1
        self.links[ends] = {"ends": ends, "classes": classes, "shapes": shapes, "len": length, "path": path, "order": order}
        for e in ends:
            self.used.setdefault(e, {})[ends] = None

    def drop(self, ends: tuple[int, int]) -> None:
        del self.links[ends]
        for e in set(ends):
            del self.used[e][ends]

    def rows(self) -> list[tuple]:
        return [(i, *x["ends"], *x["classes"], x["shapes"][0][0], x["shapes"][1][0], x["shapes"][0][1], x["shapes"][1][1], x["len"], x["path"]) for i, x in enumerate(self.links.values())]


def _toward(link: dict, side: int) -> list | None:
    """The path so that it ends at the given side; steps go the other way round."""
    path = link["path"]
    if side == 1 or path is None:
        return path
    return [-s for s in reversed(path)] if path and isinstance(path[0], int) else path[::-1]


def _joined(a: list | None, b: list | None) -> list | None:
    return None if a is None or b is None else [*a, *b]


def _merge_shared(net: _Net, class_of: dict[int, int | None], shape_of: dict[int, tuple]) -> None:
    again = True
    while again:
        again = False
        for e, pairs in net.by_endpoint().items():
            if len(pairs) != 2:
                continue
            if any(p not in net.links for p in pairs):
                again = True
                break
            one, two = (net.links[p] for p in pairs)
            i, j = (1 if x["ends"][0] == e else 0 for x in (one, two))  # the far sides
            own, far_one, far_two = class_of.get(e), one["classes"][i], two["classes"][j]
            if own in (far_one, far_two):
                shapes = [one["shapes"][i], two["shapes"][j]]
                side = 0 if own == far_one and shapes[0][0] == EMPTY else 1 if own == far_two and shapes[1][0] == EMPTY else None
                if side is not None and shape_of.get(e, (EMPTY, 1.0))[0] != EMPTY:
                    shapes[side] = shape_of[e]
                for p in pairs:
                    net.drop(p)
                net.put((one["ends"][i], two["ends"][j]), [far_one, far_two], shapes, one["len"] + two["len"], _joined(_toward(one, 1 - i), _toward(two, j)))
            elif far_one == far_two:
                net.drop(pairs[1])
                if one["shapes"][i][0] == EMPTY and two["shapes"][j][0] != EMPTY:
                    one["shapes"][i] = two["shapes"][j]


def _bridge(net: _Net, pairs: list[tuple[int, int]], about: dict[int, tuple]) -> None:
    for a, b in sorted(pairs):
        found = [net.at(a), net.at(b)]
        if found[0] is found[1]:
            continue
        far, classes, shapes, paths, length = [], [], [], [], 0
        for at, (e, link) in enumerate(zip((a, b), found, strict=True)):
            own_class, own_shape, point = about.get(e, (None, (EMPTY, 1.0), None))
            if link is None:
                far.append(e), classes.append(own_class), shapes.append(own_shape), paths.append([point] if point is not None else None)
                length += 1
                continue
            i = 1 if link["ends"][0] == e else 0
            far.append(link["ends"][i]), classes.append(link["classes"][i])
            shapes.append(own_shape if link["shapes"][i][0] == EMPTY and own_shape[0] != EMPTY else link["shapes"][i])
            paths.append(_toward(link, i if at else 1 - i))
            length += link["len"]
            net.drop(link["ends"])
        net.put((far[0], far[1]), classes, shapes, length, _joined(*paths))


def _told(ends: list[tuple]) -> dict[int, tuple]:
    return {e: (c, (shape, score), None if x is None else {"x": x, "y": y}) for e, c, shape, score, x, y in ends}


def merge_shared_endpoints(connections: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Joins or thins two connections that share an endpoint. If the endpoint's class is at a far end, both
    go and the far ends are connected, an empty far end in that class taking the endpoint's shape; else, if
    both far ends are in one class, the second goes, its shape moving to an empty first. The shape is that of
    the shared endpoint itself, not of an endpoint that happens to have the class's number. endpoints:
    (diagram_id, endpoint_index, class_index, end_shape[, shape_score, x, y]). A pass is repeated when it
    meets a connection that it took away before; paths are joined, and add up in path_len."""
    return rewrite_connections(connections, endpoints, bridge=False)


def bridge_gaps(connections: DataFrame, gaps: DataFrame, endpoints: DataFrame) -> DataFrame:
    """For each gap (diagram_id, a, b), in order, makes one connection of the two that end in it, or of the
    bare endpoints; a far end that is empty takes the shape at the gap. Nothing is done where both ends are
    in one connection or in none."""
    return rewrite_connections(connections, endpoints, gaps, merge=False)


def rewrite_connections(connections: DataFrame, endpoints: DataFrame, gaps: DataFrame | None = None, merge: bool = True, bridge: bool = True) -> DataFrame:
    """merge_shared_endpoints and bridge_gaps in one pass over the diagrams, with the columns of connections. Instead of
    their path they may have its steps along edges, see tracing.with_points, which are less to move."""
    if "steps" in connections.columns:
        stepped = connections.withColumn("steps", F.col("steps").cast("array<bigint>")).withColumnRenamed("steps", "path")
        return _rewritten(stepped, endpoints, gaps, merge, bridge, True).withColumnRenamed("path", "steps")
    return _rewritten(connections, endpoints, gaps, merge, bridge, False)


def _rewritten(connections: DataFrame, endpoints: DataFrame, gaps: DataFrame | None, merge: bool, bridge: bool, stepped: bool) -> DataFrame:
    (link_columns, whole_links), (end_columns, whole_ends) = _told_columns(connections, _LINK), _told_columns(endpoints, _END)
    out = [c for c in _REWRITTEN.split(", ") if c.split(" ")[0] in link_columns]
    out = ["path array<bigint>" if stepped and c.startswith("path ") else c for c in out]
    at = [_LINK.index(c) for c in link_columns]

    def work(_: tuple, links: list[tuple], ends: list[tuple], *pairs: list[tuple]) -> list[tuple]:
        if not links and not (bridge and pairs and pairs[0]):
            return []
        net, about = _Net(whole_links(links)), _told(whole_ends(ends))
        if stepped:
            about = {e: (c, shape, None if point is None else STAY + e) for e, (c, shape, point) in about.items()}
        if merge:
            _merge_shared(net, {e: x[0] for e, x in about.items()}, {e: x[1] for e, x in about.items()})
        if bridge and pairs:
            _bridge(net, pairs[0], about)
        return [tuple(row[i] for i in at) for row in net.rows()]

    tables = [(_bounded(connections), link_columns), (endpoints, end_columns), *([(gaps, ("a", "b"))] if gaps is not None else [])]
    return per_group(tables, ("diagram_id",), work, ", ".join(out))


def attach_to_connection(values: DataFrame, connections: DataFrame) -> DataFrame:
    """(.. rel_index, side) of the first connection that has the value's endpoint_index."""
    sides = _bounded(connections).select("diagram_id", "rel_index", F.posexplode(F.array("start_index", "endpoint_index")).alias("side", "endpoint_index"))
    first = sides.groupBy("diagram_id", "endpoint_index").agg(F.min(F.struct("rel_index", "side")).alias("first"))
    return values.join(first, ["diagram_id", "endpoint_index"]).select(*values.columns, F.col("first.rel_index").alias("rel_index"), F.col("first.side").cast("long").alias("side"))
