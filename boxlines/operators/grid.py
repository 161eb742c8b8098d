"""Joins of what is near in a diagram, by cells of a grid.

A diagram's cells follow its own boxes, so that a box touches a few of them and a cell holds a few boxes;
what meets is joined by diagram and cell, and work grows with the boxes of a diagram, not with their pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import bounded_broadcasts, written

_SIDES = ("x1", "y1", "x2", "y2")


def _cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """(diagram_id, __cell): twice the mean side of the boxes that can meet, for each diagram of both."""
    size = F.greatest(F.col("__x2") - F.col("__x1"), F.col("__y2") - F.col("__y1"))
    mean = lambda df, name: df.groupBy("diagram_id").agg(F.avg(size).alias(name))
    side = F.greatest("__a", "__b")
    return mean(a, "__a").join(mean(b, "__b"), "diagram_id").select("diagram_id", F.when(side > 0, 2 * side).otherwise(1.0).alias("__cell"))


def box_pairs(a: DataFrame, b: DataFrame, box_a: tuple[Column, ...], box_b: tuple[Column, ...]) -> DataFrame:
    """Each row of a with each of b in the same diagram whose boxes (x1, y1, x2, y2) meet, edges included: all
    columns of both, whose names must differ but for diagram_id. A box stands in every cell that it touches; a
    pair counts in one of those that they share, where the greater of their lower corners lies. Boxes with a
    null side meet nothing."""
    with_box = lambda df, box: df.withColumns({f"__{s}": c.cast("double") for s, c in zip(_SIDES, box, strict=True)}).where(" AND ".join(f"__{s} IS NOT NULL" for s in _SIDES))
    a, b = with_box(bounded_broadcasts(a), box_a), with_box(b, box_b)
    cells = _cells(a, b)

    def placed(df: DataFrame, side: str) -> DataFrame:
        at = lambda s: F.floor(F.col(f"__{s}") / F.col("__cell"))
        spread = df.join(cells, "diagram_id").withColumns({f"__cx_{side}": at("x1"), f"__cy_{side}": at("y1")})
        spread = spread.withColumn("__cx", F.explode(F.sequence(at("x1"), F.greatest(at("x1"), at("x2"))))).withColumn("__cy", F.explode(F.sequence(at("y1"), F.greatest(at("y1"), at("y2")))))
        return spread.drop("__cell").withColumnsRenamed({f"__{s}": f"__{s}_{side}" for s in _SIDES})

    met = placed(a, "a").join(placed(b, "b"), ["diagram_id", "__cx", "__cy"])
    once = (F.col("__cx") == F.greatest("__cx_a", "__cx_b")) & (F.col("__cy") == F.greatest("__cy_a", "__cy_b"))
    meet = (F.col("__x1_a") <= F.col("__x2_b")) & (F.col("__x1_b") <= F.col("__x2_a")) & (F.col("__y1_a") <= F.col("__y2_b")) & (F.col("__y1_b") <= F.col("__y2_a"))
    found = met.where(once & meet)
    return found.drop("__cx", "__cy", *(f"__{s}_{side}" for s in (*_SIDES, "cx", "cy") for side in "ab"))


def nearest_points(points: DataFrame, id_col: str) -> DataFrame:
    """(diagram_id, id_col, other_id, other_distance) for points (id_col, x, y): the nearest other point of the
    diagram, the first id on ties; a lone one has none. A point looks at its cell and the eight around it; what
    it finds within a cell's length is the nearest. Those that find none so near look again with cells four
    times as long, of which there are soon few and then none. Both sides of its joins are dealt out:
    Spark takes the nine rows of a point for one, and would send them all through the driver."""
    extent = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    about = points.groupBy("diagram_id").agg(extent.alias("__extent"), F.count("*").alias("__n")).where("__n > 1")
    cell = F.when(F.col("__extent") > 0, F.col("__extent") / F.sqrt("__n")).otherwise(1.0)
    known = written(points.join(about.hint("merge"), "diagram_id").select("diagram_id", id_col, "x", "y", cell.alias("__cell")), "points")
    place = lambda c, times: F.floor(F.col(c) / (F.col("__cell") * times))
    todo, found, times = known, None, 1.0
    while True:
        others = known.select("diagram_id", F.col(id_col).alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), place("x", times).alias("cx"), place("y", times).alias("cy"))
        around = F.array(*(F.struct((place("x", times) + dx).alias("cx"), (place("y", times) + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
        asked = todo.withColumn("c", F.explode(around)).select("diagram_id", id_col, "x", "y", "__cell", "c.cx", "c.cy")
        met = asked.hint("merge").join(others, ["diagram_id", "cx", "cy"]).where(F.col(id_col) != F.col("o"))
        d = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
        best = met.groupBy("diagram_id", id_col).agg(F.min(F.struct(d.alias("d"), F.col("o").alias("i"))).alias("s"), F.first("__cell").alias("__cell"))
        here = written(best.where(F.col("s.d") <= F.col("__cell") * times).select("diagram_id", id_col, F.col("s.i").alias("other_id"), F.col("s.d").alias("other_distance")), "nearest")
        found = here if found is None else found.unionByName(here)
        todo = written(todo.join(here.select("diagram_id", id_col).hint("merge"), ["diagram_id", id_col], "left_anti"), "left")
        if todo.isEmpty():
            return found
        times *= 4
