"""Outlines of any shape against a grid of points, and hand-made cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boxlines.functions import outlines
from boxlines.functions.geometry import rings_in_box
from boxlines.operators import outlines as ops

N, SIDE = 160, 10.0
CELL = (SIDE / N) ** 2
CLOSE = 0.7  # of an area of 100: what the grid may miss along the edges


def turns(rings):
    """How often rings run around each point of a grid, by summed angles."""
    g = (np.arange(N) + 0.5) / N * SIDE
    x, y = (c.ravel() for c in np.meshgrid(g, g))
    total = np.zeros(N * N)
    for ring in rings:
        a = [np.arctan2(v - y, u - x) for u, v in ring]
        for p, q in zip(a, [*a[1:], a[0]], strict=True):
            total += (q - p + np.pi) % (2 * np.pi) - np.pi
    return np.rint(total / (2 * np.pi)).astype(int)


whole = st.tuples(st.integers(0, 10), st.integers(0, 10)).map(lambda p: (float(p[0]), float(p[1])))
between = st.tuples(st.floats(0, 10), st.floats(0, 10))
ring = st.one_of(st.lists(whole, min_size=1, max_size=8), st.lists(between, min_size=1, max_size=8))


@settings(max_examples=60, deadline=None)
@given(ring, ring)
def test_areas_against_a_grid(a, b):
    p, q = ([r for part in outlines.repair(x) for r in part] for x in (a, b))
    raw, in_p, in_q = turns([a]), turns(p), turns(q)
    kept = outlines.area(p)
    assert min(abs(kept - (raw > 0).sum() * CELL), abs(kept - (raw < 0).sum() * CELL)) < CLOSE
    assert set(np.unique(in_p)) <= {0, 1}
    assert abs(outlines.shared(p, q) - ((in_p > 0) & (in_q > 0)).sum() * CELL) < CLOSE
    assert abs(outlines.area(outlines.united(p, q)) - ((in_p > 0) | (in_q > 0)).sum() * CELL) < CLOSE


def square(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_repair():
    assert outlines.repair([]) == outlines.repair([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]) == []
    assert outlines.repair(square(0.0, 0.0, 2.0, 2.0)) == [[square(0.0, 0.0, 2.0, 2.0)]]
    bow = outlines.repair([(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)])
    assert len(bow) == 1 and outlines.area(bow[0]) == 4.0  # the lobe that turns the other way goes
    spike = outlines.repair([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (9.0, 9.0), (4.0, 4.0), (0.0, 4.0)])
    assert [outlines.area(p) for p in spike] == [16.0]


def test_union_keeps_holes_and_touching_parts_apart():
    frame = [square(0.0, 0.0, 6.0, 1.0), square(0.0, 5.0, 6.0, 1.0), square(0.0, 0.0, 1.0, 6.0), square(5.0, 0.0, 1.0, 6.0)]
    so_far = [frame[0]]
    for r in frame[1:]:
        so_far = outlines.united(so_far, [r])
    (part,) = outlines.parts(so_far)
    assert len(part) == 2 and outlines.area(part) == 20.0
    corner = outlines.parts(outlines.united([square(0.0, 0.0, 2.0, 2.0)], [square(2.0, 2.0, 1.0, 1.0)]))
    assert [outlines.area(p) for p in corner] == [4.0, 1.0]


def test_simplify():
    r = [(0.0, 0.0), (5.0, 0.02), (10.0, 0.0), (10.0, 10.0), (5.0, 9.5), (0.0, 10.0)]
    assert outlines.simplify(r, 0.03) == [r[0], *r[2:]]
    assert outlines.simplify(r, 50.0) == r


TABLE = f"diagram_id long, region_id long, score double, points {ops.POINTS}"


def table(spark, rows):
    return spark.createDataFrame([(d, i, s, None if p is None else [{"x": float(x), "y": float(y)} for x, y in p]) for d, i, s, p in rows], TABLE)


DIAMOND = [(5, 0), (10, 5), (5, 10), (0, 5)]
FAR = [(60, 60), (70, 60), (65, 70)]


def test_clean_and_overlaps(spark):
    bow = [(0, 0), (4, 4), (4, 0), (0, 4)]
    rows = table(spark, [(1, 1, 0.5, DIAMOND), (1, 2, 0.5, bow), (1, 3, 0.5, FAR), (1, 4, 0.5, None), (1, 5, 0.5, [(0, 0), (0.1, 0), (0, 0.1)]), (2, 6, 0.5, DIAMOND)])
    clean = ops.clean_outlines(rows)
    assert sorted((r.region_id, r.piece, round(r.area, 6)) for r in clean.collect()) == [(1, 0, 50.0), (2, 0, 4.0), (3, 0, 50.0), (6, 0, 50.0)]
    # of the kept lobe (2, 2), (4, 0), (4, 4) the triangle (2.5, 2.5), (4, 1), (4, 4) lies in the diamond
    (pair,) = ops.outline_overlaps(clean).collect()
    assert (pair.a, pair.b) == (1, 2) and pair.overlap == pytest.approx(2.25 / (4 + 1e-6))
    assert ops.clean_outlines(rows.where("false")).count() == 0


def test_merge(spark):
    shift = lambda k: [(x + k, y) for x, y in DIAMOND]
    rows = table(spark, [(1, 1, 0.9, DIAMOND), (1, 2, 0.3, shift(5)), (1, 3, 0.6, FAR), (1, 4, 0.6, [(80, 80), (81, 80), (81, 81), (80, 81)]), (2, 7, 0.2, shift(5))])
    got = {(r.diagram_id, r.region_id): r for r in ops.merge_outlines(ops.clean_outlines(rows)).collect()}
    assert set(got) == {(1, 1), (1, 3), (2, 7)}  # the small one doesn't reach 2 across
    one = got[1, 1]
    assert one.n_members == 2 and one.score == pytest.approx(0.6) and one.area == pytest.approx(87.5)
    assert min(p.x for p in one.points) == 0 and max(p.x for p in one.points) == 15 and len(one.points) == 8
    assert ops.merge_outlines(ops.clean_outlines(rows.where("false"))).count() == 0


def test_inside_classes(spark):
    rows = ops.clean_outlines(table(spark, [(1, 1, 0.5, DIAMOND), (1, 2, 0.5, FAR), (2, 3, 0.5, DIAMOND)]))
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 10.0), (1, 60.0, 60.0, 5.0, 10.0)], "diagram_id long, x double, y double, w double, h double")
    assert sorted(r.region_id for r in ops.drop_outlines_inside(rows, boxes).collect()) == [2, 3]  # 49 of 50, 25 of 50, no box


def test_area_in_box_against_shared(spark):
    rng = np.random.default_rng(3)
    made = [(outlines.repair(rng.uniform(0, 10, (7, 2)).tolist()), *sorted(rng.uniform(0, 10, 2)), *sorted(rng.uniform(0, 10, 2))) for _ in range(60)]
    made = [(p, float(x1), float(y1), float(x2), float(y2)) for parts, x1, x2, y1, y2 in made for p in parts]
    df = spark.createDataFrame([([[{"x": x, "y": y} for x, y in r] for r in p], *b) for p, *b in made], f"rings array<{ops.POINTS}>, x1 double, y1 double, x2 double, y2 double")
    got = [r[0] for r in df.select(rings_in_box(F.col("rings"), *(F.col(c) for c in ("x1", "y1", "x2", "y2")))).collect()]
    assert got == pytest.approx([outlines.shared(p, [square(x1, y1, x2 - x1, y2 - y1)]) for p, x1, y1, x2, y2 in made], abs=1e-4)


def test_stitch(spark):
    about = dict(offset_px_x=100, offset_px_y=0, tile_width=100, tile_height=100, image_width=200, image_height=100)
    rows = table(spark, [(1, 1, 0.4, [(0, 0), (20, 0), (20, 20), (0, 20)]), (1, 2, 0.8, [(40, 0), (60, 0), (60, 20), (40, 20)]), (1, 3, 0.4, [(10, 0), (30, 0), (30, 20), (10, 20)])])
    got = ops.stitch_outlines(rows.withColumns({k: F.lit(v) for k, v in about.items()})).orderBy("position").collect()
    assert [(r.region_id, r.n_members, r.position) for r in got] == [(2, 1, 1), (1, 2, 2)]
    assert got[1].area == pytest.approx(300.0) and {(p.x, p.y) for p in got[1].points} == {(50.0, 0.0), (65.0, 0.0), (65.0, 20.0), (50.0, 20.0)}


def test_lengths_are_those_before_rounding(spark):
    """Boxes whose diagonal is 2 but for the last digits of its doubles, to either side: (user, event) of the fixtures."""
    rows, long = [], set()
    for i, (user, event) in enumerate([(22200, 9), (34400, 18), (15600, 26), (40000, 18), (10400, 36), (18800, 48)]):
        wide, high, x, y = 800 + user * 37 % 3200, 600 + user * 53 % 2600, float(event * 7919 % 88), float(event * 10007 % 88)
        u, v, left, top = x + 1 + event % 11, y + 1 + event % 5, event % 4 * 240, event // 4 % 3 * 240
        across = lambda a: a * (480.0 / wide) + left / wide * 100  # noqa: B023, E731
        down = lambda a: a * (480.0 / high) + top / high * 100  # noqa: B023, E731
        if ((across(u) - across(x)) ** 2 + (down(v) - down(y)) ** 2) ** 0.5 > 2:
            long.add(i)
        rows.append((i, i, 0.5, [(x, y), (u, y), (u, v), (x, v)], left, top, 480, 480, wide, high))
    told = "diagram_id long, region_id long, score double, points array<struct<x:double,y:double>>, offset_px_x long, offset_px_y long, tile_width long, tile_height long, image_width long, image_height long"
    assert long == {0, 1, 2} == {r["region_id"] for r in ops.stitch_outlines(spark.createDataFrame(rows, told)).collect()}
