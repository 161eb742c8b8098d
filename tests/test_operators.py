"""Boundaries, ties and empty tables of the diagram operators on hand-made rows."""

import base64
import datetime
import zlib
from itertools import permutations

import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boxlines.functions import text as names
from boxlines.jobs.queries import _extracted
from boxlines.operators import assign, connections, diagram, endpoints, extraction, files, regions, results, text, tiling, tracing
from boxlines.operators.stages import measured
from boxlines.streaming.intake import PIECE, stream_extract, stream_extract_pieces

REGION = "diagram_id long, region_id long, label string, x double, y double, width double, height double, score double"


def kept(spark, rows, threshold=0.3):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], REGION)
    return sorted(r.region_id for r in regions.suppress_overlaps(df, threshold).collect())


def test_suppression_keeps_the_better_and_on_ties_the_later(spark):
    a, b = ("Class", 0.0, 0.0, 10.0, 10.0, 0.9), ("Note", 1.0, 0.0, 10.0, 10.0, 0.8)
    assert kept(spark, [a, b]) == [0]
    assert kept(spark, [a[:5] + (0.8,), b]) == [1]
    assert kept(spark, [a, a, a]) == [2]
    assert kept(spark, [a, ("Crossing", *b[1:])]) == [0, 1]  # another group
    assert kept(spark, [a, ("Class", 7.0, 0.0, 10.0, 10.0, 0.1)]) == [0, 1]  # a ratio of exactly 0.3


def test_suppression_of_nothing(spark):
    assert regions.suppress_overlaps(spark.createDataFrame([], REGION)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=25))
def test_rings_have_no_inner_repeats(points):
    for ring in regions.split_loops(points):
        inner = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
        assert len(set(inner)) == len(inner)


def test_doubled_endpoints(spark):
    ends = spark.createDataFrame([(1, i, x, 0.0) for i, x in enumerate((30.0, 26.0, 22.0, 80.0))], "diagram_id long, endpoint_id long, x double, y double")
    boxes = spark.createDataFrame([(1, 0, 0.0, -5.0, 20.0, 10.0)], "diagram_id long, class_index long, x double, y double, w double, h double")
    scales = spark.createDataFrame([(1, 1.0)], "diagram_id long, scale double")
    assert sorted(r.endpoint_id for r in endpoints.dedupe_endpoints(ends, boxes, scales).collect()) == [2, 3]
    attached = {r.endpoint_id: (r.class_index, r.position) for r in endpoints.attach_endpoints(ends, boxes, scales).collect()}
    assert attached == {0: (None, 0), 1: (0, 1), 2: (0, 2)}
    alone = ends.where("endpoint_id = 0")
    assert endpoints.attach_endpoints(alone, boxes, scales).count() == 0  # a lone endpoint has no neighbour
    assert endpoints.attach_endpoints(ends, boxes.where("false"), scales).count() == 0


LINK = "diagram_id long, rel_index long, start_index long, endpoint_index long, class_a long, class_b long, end_shape_0 string, end_shape_1 string, path_len long"
END = "diagram_id long, endpoint_index long, class_index long, end_shape string"


def test_connections_through_a_class_edge_are_joined(spark):
    links = spark.createDataFrame([(1, 0, 1, 2, 7, 7, "Empty End", "Empty End", 10), (1, 1, 2, 3, 7, 8, "Empty End", "Arrow End", 20)], LINK)
    ends = spark.createDataFrame([(1, 1, 7, "Empty End"), (1, 2, 7, "Triangle End"), (1, 3, 8, "Empty End")], END)
    (r,) = connections.merge_shared_endpoints(links, ends).collect()
    assert tuple(r) == (1, 0, 1, 3, 7, 8, "Triangle End", "Arrow End", 30)


def test_two_lines_to_one_class_become_one(spark):
    links = spark.createDataFrame([(1, 0, 1, 2, 5, 6, "Empty End", "Empty End", 10), (1, 1, 2, 3, 6, 5, "Empty End", "Arrow End", 20)], LINK)
    ends = spark.createDataFrame([(1, 1, 5, "Empty End"), (1, 2, 6, "Empty End"), (1, 3, 5, "Empty End")], END)
    (r,) = connections.merge_shared_endpoints(links, ends).collect()
    assert tuple(r) == (1, 0, 1, 2, 5, 6, "Arrow End", "Empty End", 10)


def test_gaps_are_bridged(spark):
    links = spark.createDataFrame([(1, 0, 1, 2, 5, None, "Empty End", "Empty End", 10), (1, 1, 3, 4, None, 6, "Empty End", "Empty End", 20)], LINK)
    ends = spark.createDataFrame([(1, 2, None, "Arrow End"), (1, 3, None, "Empty End"), (1, 8, 9, "Empty End"), (1, 9, 4, "Empty End")], END)
    gaps = spark.createDataFrame([(1, 2, 3), (1, 8, 9)], "diagram_id long, a long, b long")
    got = [tuple(r) for r in sorted(connections.bridge_gaps(links, gaps, ends).collect(), key=lambda r: r.rel_index)]
    assert got == [(1, 0, 1, 4, 5, 6, "Arrow End", "Empty End", 30)]  # neither 8 nor 9 has a line
    assert connections.final_connections(connections.bridge_gaps(links, gaps, ends)).count() == 1


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.randoms(use_true_random=False))
def test_assignment_is_optimal(n, m, random):
    cost = np.array([[random.choice([1.0, 2.0, 3.5, 7.0, np.inf]) for _ in range(m)] for _ in range(n)])
    best = min((sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(m), n)), default=np.inf)
    got = assign.hungarian(cost)
    assert (got is None) == (not np.isfinite(best))
    if got is not None:
        assert sum(cost[i, j] for i, j in enumerate(got)) == pytest.approx(best) and len(set(got)) == n


def test_assignment_falls_back_to_the_nearest(spark):
    rows = [(1, 0, 0, 1.0), (1, 0, 1, 2.0), (1, 1, 0, 1.5), (1, 1, 1, 9.0), (2, 0, 0, 3.0), (2, 1, 0, 1.0), (2, 2, 0, 2.0)]
    df = spark.createDataFrame(rows, "diagram_id long, left_id long, right_id long, distance double")
    assert sorted(map(tuple, assign.optimal_assignment(df).collect())) == [(1, 0, 1), (1, 1, 0), (2, 1, 0)]
    assert sorted(map(tuple, assign.greedy_assignment(df).collect())) == [(1, 0, 0), (1, 1, 1), (2, 1, 0)]


def test_labels_cluster_by_line(spark):
    rows = [(1, 0, 0.0, 0.0, 50.0, 10.0), (1, 1, 2.0, 12.0, 48.0, 22.0), (1, 2, 0.0, 90.0, 50.0, 100.0), (1, 3, 200.0, 0.0, 210.0, 50.0), (1, 4, 212.0, 2.0, 222.0, 48.0)]
    df = spark.createDataFrame(rows, "diagram_id long, label_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.label_id: (r.cluster_id, r.pos) for r in assign.cluster_text_boxes(df).collect()}
    assert got == {3: (0, 0), 4: (0, 1), 0: (1, 0), 1: (1, 1), 2: (2, 0)}


def test_texts(spark):
    cases = {"O": "()", "0": "0", "getO": "get()", "get0: int": "get(): int", "run®": "run()", "a0b:": "a0b:", ")(": ")(", "": ""}
    df = spark.createDataFrame([(t,) for t in cases], "text string").withColumns({"fixed": names.fix_parentheses(F.col("text")), "method": names.is_method(F.col("text")), "name": names.sanitize_name(F.col("text"))})
    assert {r.text: r.fixed for r in df.collect()} == cases
    assert not any(r.method for r in df.collect())
    named = spark.createDataFrame([("9lives",), ("a-b",), ("Straße",), ("List<T>",)], "t string").select(names.sanitize_name(F.col("t")).alias("n"))
    assert [r.n for r in named.collect()] == ["_9lives", "a_b", "Straße", "List<T>"]
    filed = spark.createDataFrame([('a<b>:"/\\|?*\x01 . ',), (". .",)], "t string").select(names.safe_file_name(F.col("t")).alias("n"))
    assert [r.n for r in filed.collect()] == ["a_b_________", "untitled"]


def test_natural_order(spark):
    some = ["img10.png", "img2.png", "IMG1.png", "img02.png", "a.png", "img10b.png"]
    got = sorted(files.natural_order(spark.createDataFrame([(n,) for n in some], "file_name string")).collect(), key=lambda r: r.position)
    assert [r.file_name for r in got] == ["a.png", "IMG1.png", "img02.png", "img2.png", "img10.png", "img10b.png"]


def test_stereotypes(spark):
    df = spark.createDataFrame([("<<entlty>>",), ("zzz",), ("<<Interface>>",), (None,)], "stereotype_text string")
    assert {r.stereotype_text: r.stereotype for r in text.match_stereotype(df).collect()} == {"<<entlty>>": "<<entity>>", "zzz": None, "<<Interface>>": "<<interface>>"}


def test_two_shapes_on_one_line(spark):
    rows = [("Arrow End", "Arrow End", 0.9, 0.1), ("Arrow End", "Triangle End", 0.9, 0.1), ("Triangle End", "Empty Diamond End", 0.5, 0.5), ("Triangle End", "Empty Diamond End", 0.6, 0.5)]
    df = spark.createDataFrame(rows, "end_shape_0 string, end_shape_1 string, shape_score_0 double, shape_score_1 double")
    assert [tuple(r)[:2] for r in diagram.resolve_end_shapes(df).collect()] == [("Empty End", "Empty End"), ("Empty End", "Triangle End"), ("Empty End", "Empty Diamond End"), ("Triangle End", "Empty End")]


def test_empty_diagram_has_its_frame_and_keys_read_back(spark):
    none = spark.createDataFrame([], "diagram_id long, class_index long, name string, stereotype string, attributes array<string>, methods array<string>")
    links = spark.createDataFrame([], "diagram_id long, rel_index long, source string, target string, type string, role_0 string, multiplicity_0 string, role_1 string, multiplicity_1 string, name string")
    out = diagram.to_plantuml(spark.createDataFrame([(5,)], "diagram_id long"), none, links)
    assert [tuple(r) for r in out.collect()] == [(5, "@startuml\n@enduml")]
    (r,) = out.select(diagram.plantuml_key(F.col("plantuml")).alias("k")).collect()
    raw = base64.b64decode(r.k.translate(str.maketrans(diagram.KEY_ALPHABET, diagram.BASE64_ALPHABET)))
    assert zlib.decompressobj(-15).decompress(raw).decode() == "@startuml\n@enduml"


def test_tiles_cover_the_image(spark):
    images = spark.createDataFrame([(1, 1000, 700), (2, 300, 200)], "diagram_id long, width long, height long")
    levels = tiling.tile_ladder(images, "class", 320)
    assert sorted((r.diagram_id, r.level, r.tile_size) for r in levels.collect() if r.tile_size) == [(1, 1, 500)]
    seen = np.zeros((700, 1000), dtype=bool)
    for t in tiling.tile_grid(levels.where("diagram_id = 1 AND level = 1")).collect():
        seen[t.y1 : t.y2, t.x1 : t.x2] = True
    assert seen.all()
    with pytest.raises(ValueError):
        tiling.tile_ladder(images, "other", 320)


def test_sheets_refuse_another_name_and_taken_cells(spark):
    sheet = spark.createDataFrame([(1, "a", "x", None), (2, "b", None, None)], "row_key long, name string, c1 string, c2 string")
    new = lambda name: spark.createDataFrame([(1, name, "new", None)], "row_key long, name string, c1 string, c2 string")
    assert sorted(map(tuple, files.write_eval_rows(sheet, new("a")).collect()))[0] == (1, "a", "new", None)
    with pytest.raises(Exception, match="row 1"):
        files.write_eval_rows(sheet, new("z")).collect()
    with pytest.raises(Exception, match="row 1"):
        files.write_eval_rows(sheet, new("z"), check_name=False).collect()
    assert files.write_eval_rows(sheet, new("z"), check_name=False, overwrite=True).count() == 2


def test_stream_takes_each_input_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    df = spark.createDataFrame([(1, "a")], "diagram_id long, text string")
    for _ in range(2):
        df.write.mode("append").parquet(source)
        stream_extract(spark.readStream.schema(df.schema).parquet(source), lambda b: b, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_pieces_make_each_diagram_once(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    rows = [(i, at, p, 3, [("t", f'{{"diagram_id":{i},"p":{p}}}')] if p else None) for i in range(6) for p in range(3)]
    put = lambda some: spark.createDataFrame(some, PIECE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    fail, taken = [False], []

    def job(diagrams, tables):
        if fail[0]:
            raise RuntimeError("stopped within a batch")
        taken.append(sorted(r.diagram_id for r in diagrams.collect()))
        return diagrams.join(tables["t"], "diagram_id", "left")

    def run():
        stream = spark.readStream.schema(PIECE).parquet(f"{tmp_path}/in")
        stream_extract_pieces(stream, {"t": "diagram_id long, p int"}, job, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()

    put(rows[:7])
    run()
    put(rows[2:11] + [(None, at, 0, 1, None)])
    fail[0] = True
    with pytest.raises(Exception, match="stopped within a batch"):
        run()
    fail[0] = False
    run()
    put(rows[::-1])
    run()
    assert [x for x in taken if x] == [[0, 1], [2], [3, 4, 5]]
    got = sorted((r.diagram_id, r.p) for r in spark.read.parquet(f"{tmp_path}/out").where("p IS NOT NULL").collect())
    assert got == [(i, p) for i in range(6) for p in (1, 2)]


def test_pieces_of_before_1970_count(spark, tmp_path):
    sent = "CASE id % 3 WHEN 0 THEN TIMESTAMP '1970-01-01 00:00:00' WHEN 1 THEN TIMESTAMP '1969-12-31 12:00:00' ELSE TIMESTAMP '1970-01-01 01:00:00' END"
    rows = spark.range(6).selectExpr("id DIV 2 AS diagram_id", f"{sent} AS sent", "CAST(id % 2 AS INT) AS piece", "2 AS n_pieces", "CAST(NULL AS array<struct<table:string,row:string>>) AS payload")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(PIECE).parquet(f"{tmp_path}/in")
    stream_extract_pieces(stream, {}, lambda diagrams, _: diagrams, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(r.diagram_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2]


def test_counts_and_times_of_an_extraction(spark, small):
    with measured() as run:
        boxes, tables = _extracted(spark, small)
    tables = tables | {"boxes": boxes, "got": extraction.extraction_counts(boxes, boxes, tables)}
    db = duckdb.connect()
    for name in ("boxes", "links", "roles", "names", "multiplicities", "class_texts", "classes", "got"):
        db.register(name, tables[name].select("diagram_id", *(["label_id"] if name == "multiplicities" else []), *(c for c in tables[name].columns if name == "got" and c != "diagram_id")).toPandas())
    of = lambda table: f"(SELECT count(*) FROM {table} t WHERE t.diagram_id = d.diagram_id)"
    want = f"SELECT diagram_id, {of('boxes')}, {of('links')}, {of('class_texts')}, {of('roles')} + {of('names')}, {of('multiplicities')} FROM (SELECT DISTINCT diagram_id FROM boxes) d"
    assert sorted(db.execute("SELECT * FROM got").fetchall()) == sorted(db.execute(want).fetchall())
    assert db.execute("SELECT min(n), max(n) FROM (SELECT count(*) AS n FROM multiplicities GROUP BY diagram_id, label_id)").fetchone() == (1, 1)
    steps = results.measured_steps(spark, [run]).orderBy("step_no").collect()
    assert [r.step_no for r in steps] == list(range(1, len(steps) + 1)) and steps[-1].is_total and not any(r.is_total for r in steps[:-1])
    assert steps[-1].seconds >= sum(r.seconds for r in steps[:-1]) and all(r.n_rows is not None for r in steps[:-1])
    rows = {r.step: r.n_rows for r in steps}
    assert rows["links"] == tables["links"].count() and rows["classes"] == tables["classes"].count() and rows["rendered"] == tables["plantuml"].count()
    before = len(run.steps)
    tables["plantuml"].count()
    assert len(run.steps) == before


def test_ranks_of_paths_dont_depend_on_the_order_of_rows(spark):
    rows = [(1, 0, 1, 5, 6, 10.0, n, [(0.0, float(n)), (1.0, x)]) for n in (50, 90, 20) for x in (3.0, 2.0)] + [(1, 0, 2, 5, 6, 10.0, 10, [(0.0, 0.0)])]
    schema = "diagram_id long, start_index long, endpoint_index long, class_a long, class_b long, total_div double, path_len long, path array<struct<x:double,y:double>>"
    got = [sorted(map(str, connections.path_probability(spark.createDataFrame(some, schema)).collect())) for some in (rows, rows[::-1])]
    assert got[0] == got[1]
    best = connections.path_probability(spark.createDataFrame(rows, schema)).where("rank = 1").first()
    assert (best.endpoint_index, best.path_len, best.path[1].y) == (1, 20, 2.0)


def test_reach_and_least_length_follow_the_scale(spark):
    scales = spark.createDataFrame([(1, 2.0), (2, 0.5)], "diagram_id long, scale double")
    boxes = spark.createDataFrame([(d, 0, 0.0, 0.0, 10.0, 10.0) for d in (1, 2)], "diagram_id long, left_id long, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(d, i, x, 5.0) for d in (1, 2) for i, x in enumerate((24.0, 32.0, 69.0, 71.0))], "diagram_id long, right_id long, x double, y double")
    got = assign.assignment_candidates(boxes, points, 30.0, scales).collect()
    assert sorted((r.diagram_id, r.right_id) for r in got) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    lines = points.withColumns({"u": F.col("x"), "v": F.col("y") + 1})
    got = assign.line_candidates(boxes, lines, 30.0, scales).collect()
    assert sorted((r.diagram_id, r.right_id) for r in got) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    links = spark.createDataFrame([(d, i, 0, 1, 7, 7, n) for d in (1, 2) for i, n in enumerate((14, 16, 59, 60))], "diagram_id long, rel_index long, start_index long, endpoint_index long, class_a long, class_b long, path_len long")
    got = connections.final_connections(links, scales=scales)
    assert sorted((r.diagram_id, r.rel_index) for r in got.collect()) == [(1, 3), (2, 1), (2, 2), (2, 3)] and got.columns == links.columns


def test_multiplicities_reach_their_connections(spark):
    boxes = spark.createDataFrame([(1, i, x, 0.0, x + 10, 10.0) for i, x in enumerate((0.0, 100.0, 200.0, 400.0))], "diagram_id long, label_id long, x1 double, y1 double, x2 double, y2 double")
    choices = spark.createDataFrame([(1, 0, "STAR"), (1, 1, "Struck"), (1, 2, "0..*"), (1, 3, "1")], "diagram_id long, label_id long, choice string")
    points = spark.createDataFrame([(1, 0, 15.0, 5.0), (1, 1, 115.0, 5.0), (1, 2, 285.0, 5.0), (1, 3, 600.0, 5.0)], "diagram_id long, endpoint_index long, x double, y double")
    links = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 3, 2)], "diagram_id long, rel_index long, start_index long, endpoint_index long")
    for scale, want in ((2.0, [(0, 0, "*", 0, 0), (2, 2, "0..*", 1, 1)]), (1.0, [(0, 0, "*", 0, 0)])):
        scales = spark.createDataFrame([(1, scale)], "diagram_id long, scale double")
        got = assign.assign_multiplicities(boxes, choices, points, links, scales).collect()
        assert sorted((r.label_id, r.endpoint_index, r.multiplicity, r.rel_index, r.side) for r in got) == want


CROSSING = "diagram_id long, crossing_index long, x double, y double, w double, h double"


def test_rim_of_a_crossing_and_what_touches_it(spark):
    ink = spark.createDataFrame([(1, y, x) for y in range(12) for x in range(12)], "diagram_id long, y long, x long")
    box = spark.createDataFrame([(1, 0, 2.9, 2.2, 4.7, 4.1)], CROSSING)
    rim = {(r.y, r.x) for r in tracing.crossing_border_points(ink, box).collect()}
    assert rim == {(y, x) for y in range(2, 6) for x in range(2, 6) if y in (2, 5) or x in (2, 5)} and len(rim) == 12
    outside = {(r.y, r.x, r.ny, r.nx) for r in tracing.crossing_outside_neighbours(ink, box).collect()}
    assert outside == {(y, x, y + a, x + b) for y, x in rim for a in (-1, 0, 1) for b in (-1, 0, 1) if not (2 <= y + a < 6 and 2 <= x + b < 6)}


def crossed(scale):
    """Two lines that cross, their four ends at four boxes, and a line with a gap between two more, as large
    as the scale says. Returns pixels, boxes, endpoints, crossings and shapes."""
    s = scale
    at = lambda *p: tuple(int(v * s) for v in p)
    lines = [(at(100, 150), at(300, 150)), (at(200, 50), at(200, 250)), (at(100, 400), at(195, 400)), (at(203, 400), at(300, 400))]
    ink = set()
    for (x, y), (u, v) in lines:
        n = max(abs(u - x), abs(v - y))
        ink |= {(round(y + (v - y) * i / n), round(x + (u - x) * i / n)) for i in range(n + 1)}
    boxes = [(0, 100, 100, 100), (300, 100, 100, 100), (150, -50, 100, 100), (150, 250, 100, 100), (0, 350, 100, 100), (300, 350, 100, 100)]
    ends = [p for line in lines for p in line]
    return (
        [(1, y, x) for y, x in sorted(ink)],
        [(1, i, *(float(v * s) for v in b)) for i, b in enumerate(boxes)],
        [(1, i, float(x), float(y)) for i, (x, y) in enumerate(ends)],
        [(1, 0, *(float(v * s) for v in (190, 140, 20, 20)))],
        [(1, 0, *(float(v * s) for v in (292, 145, 8, 10)), "Triangle End", 0.9)],
    )


@pytest.mark.parametrize("scale", [1.0, 1.5])
def test_connections_of_crossing_lines_and_over_a_gap(spark, scale):
    from boxlines.operators import extraction

    pixels, boxes, ends, crossings, shapes = crossed(scale)
    tables = [
        spark.createDataFrame(pixels, "diagram_id long, y long, x long"),
        spark.createDataFrame(boxes, "diagram_id long, class_index long, x double, y double, w double, h double"),
        spark.createDataFrame(ends, "diagram_id long, endpoint_id long, x double, y double"),
        spark.createDataFrame(crossings, CROSSING),
        spark.createDataFrame(shapes, "diagram_id long, shape_index long, x double, y double, w double, h double, label string, score double"),
    ]
    links, told = extraction.evaluate_connections(*tables)
    got = sorted((r.class_a, r.class_b, r.end_shape_0, r.end_shape_1) for r in links.collect())
    assert got == [(0, 1, "Empty End", "Triangle End"), (2, 3, "Empty End", "Empty End"), (4, 5, "Empty End", "Empty End")]
    by = {(r.class_a, r.class_b): r for r in links.collect()}
    straight = by[0, 1]  # from the end to the crossing, to its centre, out of it, and on to the other end
    half = 90 * scale
    assert straight.path_len == len(straight.path) and 2 * half <= straight.path_len <= 2 * half + 8
    assert {p.y for p in straight.path} <= {150 * scale, int(150 * scale)} | {float(int(140 * scale) + int(20 * scale) / 2)}
    assert by[4, 5].path_len == len(by[4, 5].path) >= 190 * scale
    labels = [(1, 0, "Relationship label", 110.0, 120.0, 150.0, 140.0, 0.9), (1, 1, "Multiplicity", 270.0, 120.0, 280.0, 130.0, 0.9), (1, 2, "Relationship label", 180.0, 405.0, 220.0, 415.0, 0.9)]
    labels = spark.createDataFrame([(a, b, c, *(v * scale for v in d), e) for a, b, c, *d, e in labels], "diagram_id long, label_id long, kind string, x1 double, y1 double, x2 double, y2 double, score double")
    read = spark.createDataFrame([(1, 0, 0.9, "owner"), (1, 2, 0.8, "uses")], "diagram_id long, label_id long, score double, text string")
    choices = spark.createDataFrame([(1, 1, "STAR")], "diagram_id long, label_id long, choice string")
    texts = spark.createDataFrame([(1, i, 0, "Name", 0.9, f"C{i}") for i in range(6)], "diagram_id long, class_index long, pos long, label string, score double, text string")
    (out,) = extraction.extract_diagrams(spark.createDataFrame([(1,)], "diagram_id long"), tables[1], texts, tables[0], *tables[2:], labels, read, choices).collect()
    lines = out.plantuml.split("\n")
    assert '"C0" "owner" --|> "*" "C1"' in lines and '"C2" -- "C3"' in lines and '"C4" -- "C5" : "uses"' in lines


def test_equal_optima_take_the_first_right_ids(spark):
    rng = np.random.default_rng(2)
    for n, m in ((2, 3), (3, 4), (4, 5), (3, 3)):
        for _ in range(30):
            cost = rng.integers(0, 3, (n, m)).astype(float)
            want = min((round(sum(cost[i, j] for i, j in enumerate(p)), 9), p) for p in permutations(range(m), n))[1]
            assert assign.optimal([(cost[i, j], i, j) for i in range(n) for j in range(m)]) == list(enumerate(want))
    eight = [(1.0, i, j) for i in range(8) for j in range(9)]
    assert assign.optimal(eight) == [(i, i) for i in range(8)]


def test_small_diagrams_are_tried_and_agree_with_prices(monkeypatch):
    rnd = random.Random(6)
    cases = [[(float(rnd.choice([rnd.randrange(4), rnd.random()])), a, rnd.randrange(5)) for a in range(rnd.randint(1, 5)) for _ in range(rnd.randint(1, 3))] for _ in range(400)]
    priced = assign._priced
    monkeypatch.setattr(assign, "_priced", None)
    tried = [assign.optimal(c) for c in cases]
    monkeypatch.setattr(assign, "_priced", priced)
    monkeypatch.setattr(assign, "TRIALS", 0)
    assert tried == [assign.optimal(c) for c in cases]


def test_steps_are_rewritten_as_points_are(spark):
    """Connections with the steps of their paths come to the same points as connections with the points themselves."""
    rnd = random.Random(5)
    edges = [(d, e, [(float(rnd.randrange(90)), rnd.randrange(90) + 0.5) for _ in range(rnd.randint(1, 4))]) for d in range(6) for e in range(9)]
    known = {(d, e): p for d, e, p in edges}
    ends = [(d, i, rnd.choice([None, 0, 1, 2]), rnd.choice(["Empty End", "Arrow End"]), 0.5, float(10 * i), 3.0) for d in range(6) for i in range(10)]
    links, gaps = [], [(d, a, a + 1) for d in range(6) for a in (1, 4, 8)]
    for d in range(6):
        for rel in range(7):
            steps = [rnd.choice([-1, 1]) * (e + 1) for e in rnd.sample(range(9), rnd.randint(1, 3))]
            a, b = rnd.sample(range(10), 2)
            links.append((d, rel, a, b, rnd.randrange(3), rnd.randrange(3), "Empty End", "Arrow End", 1.0, 0.5, 9, steps, [p for s in steps for p in known[d, abs(s) - 1][:: 1 if s > 0 else -1]]))
    links = spark.createDataFrame(links, "diagram_id long, rel_index long, start_index long, endpoint_index long, class_a long, class_b long, end_shape_0 string, end_shape_1 string, shape_score_0 double, shape_score_1 double, path_len long, steps array<int>, path array<struct<x:double,y:double>>")
    ends = spark.createDataFrame(ends, "diagram_id long, endpoint_index long, class_index long, end_shape string, shape_score double, x double, y double")
    gaps = spark.createDataFrame(gaps, "diagram_id long, a long, b long")
    edges = spark.createDataFrame(edges, "diagram_id long, edge int, path array<struct<x:double,y:double>>")
    want = connections.rewrite_connections(links.drop("steps"), ends, gaps)
    stepped = connections.rewrite_connections(links.drop("path"), ends, gaps)
    got = tracing.with_points(stepped, edges, ends).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.where("size(path) > 6").count() > 3
    assert stepped.where("exists(steps, s -> abs(s) >= 1L << 40)").count() > 0
    tied = spark.createDataFrame([(1, 0, 1, n, 5, 6, 10.0, x) for n in (20, 30) for x in range(2)], "diagram_id long, start_index long, endpoint_index long, path_len long, class_a long, class_b long, total_div double, edge int")
    first = connections.first_paths(tied, spark.createDataFrame([(1, 4)], "diagram_id long, n_endpoints long")).collect()
    assert sorted((r.path_len, r.edge, r.n_first) for r in first) == [(20, 0, 2), (20, 1, 2)]


def test_lines_that_are_near_no_box_are_not_cut_into_segments(spark):
    """The candidates stay the same; only the line whose bounds come near a box is cut into its steps."""
    box = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (2, 0, 0.0, 0.0, 10.0, 10.0)], "diagram_id long, left_id long, x1 double, y1 double, x2 double, y2 double")
    rows = [(1, 0, [(float(i), 18.0) for i in range(40)]), (1, 1, [(float(i), 400.0) for i in range(300)]), (1, 2, None), (2, 3, [(5.0, 5.0)])]
    lines = spark.createDataFrame(rows, "diagram_id long, right_id long, path array<struct<x:double,y:double>>")
    cut = assign.near_segments(box, lines, 20.0)
    assert sorted((r.diagram_id, r.right_id, r.x, r.u) for r in cut.collect()) == [*((1, 0, float(i), float(i + 1)) for i in range(39)), (2, 3, 5.0, 5.0)]
    found = assign.line_candidates(box, cut, 20.0).collect()
    assert sorted((r.diagram_id, r.right_id, r.distance) for r in found) == [(1, 0, 8.0), (2, 3, 0.0)]


def test_pieces_of_a_stream_are_written_where_they_arrive(spark, small):
    """They were written as a table first, and then copied twice."""
    import glob

    from boxlines.jobs import queries
    from boxlines.operators.stages import shared_dir

    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/tables/pieces-*"))
    assert queries.QUERIES["a6_stream_pieces"](spark, small).count() == 15
    assert set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/tables/pieces-*")) == before
