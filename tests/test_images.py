"""Rasters, thinning and tracing on drawn pictures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlines.functions import raster
from boxlines.jobs.queries import _sums
from boxlines.operators import files, images, tracing
from boxlines.sources.pictures import PictureWriter, Written, png, write_pictures


def rasters(spark, *pictures):
    rows = [(i, p.shape[1], p.shape[0], p.shape[2], p.tobytes()) for i, p in enumerate(pictures)]
    return spark.createDataFrame(rows, images.IMAGE)


def test_normalising():
    gray, rgba = np.full((2, 1, 1), 30, np.uint8), np.array([[[10, 20, 30, 0], [10, 20, 30, 128]]], np.uint8)
    assert raster.gray_to_bgr(gray).tolist() == [[[30] * 3], [[30] * 3]]
    assert raster.flatten_alpha(rgba).tolist() == [[[255] * 3, [132, 137, 142]]]
    out = raster.preprocess(gray)
    assert out.shape == (22, 21, 3) and out[10, 10].tolist() == [225] * 3 and out[0, 0, 0] == 255


def test_masks_and_marks():
    ring = [(1.0, 1.0), (5.0, 1.0), (5.0, 5.0), (1.0, 5.0)]
    mask = raster.polygon_mask((8, 8), [ring, [(2.5, 2.5), (3.5, 2.5), (3.5, 3.5), (2.5, 3.5)]])
    assert mask[2, 2] and not mask[3, 3] and not mask[6, 6]  # the inner ring is a hole
    image = np.full((8, 8, 3), 255, np.uint8)
    kept = raster.keep_only(image, mask)
    assert kept[2, 2].tolist() == [220] * 3 and kept[0, 0].tolist() == [255] * 3
    assert raster.blend(image, mask, (0, 0, 0))[2, 2, 0] == 178
    assert raster.outline(raster.box_mask((9, 9), 1, 1, 8, 8), 1).sum() == 24


def test_thinning_keeps_lines_connected():
    ink = np.zeros((30, 60), bool)
    ink[10:15, 5:55] = True
    ink[5:25, 28:32] = True
    thinned = raster.thin(ink)
    assert 0 < thinned.sum() < ink.sum() / 3 and (thinned <= ink).all()
    spots = set(zip(*np.nonzero(thinned), strict=True))
    todo, seen = [next(iter(spots))], set()
    while todo:
        y, x = todo.pop()
        if (y, x) in spots and (y, x) not in seen:
            seen.add((y, x))
            todo += [(y + a, x + b) for a, b in tracing.STEPS]
    assert seen == spots
    assert raster.close_ink(np.eye(1, 9, 3, dtype=bool) | np.eye(1, 9, 5, dtype=bool), 2)[0, 4]


def test_a_drawn_line_is_traced(spark):
    picture = np.full((40, 100, 3), 255, np.uint8)
    picture[19:22, 10:90] = 0
    lines = images.skeletonize(rasters(spark, picture), spark.createDataFrame([(0, 1.0)], "diagram_id long, scale double"))
    ends = spark.createDataFrame([(0, 0, 8.0, 20.0), (0, 1, 92.0, 20.0)], "diagram_id long, endpoint_index long, x double, y double")
    (edge,) = tracing.trace_edges(lines, tracing.snap_endpoints(ends, lines)).collect()
    assert (edge.a, edge.b) == ("e0", "e1") and len(edge.path) > 70
    nodes = spark.createDataFrame([(0, "e0", "endpoint", 0.0, 0.0), (0, "c0", "crossing", 5.0, 0.0), (0, "e2", "endpoint", 10.0, 0.0), (0, "e3", "endpoint", 5.0, 5.0)], "diagram_id long, node string, kind string, x double, y double")
    links = spark.createDataFrame([(0, a, b, [(0.0, 0.0), (1.0, 1.0)]) for a, b in (("e0", "c0"), ("c0", "e2"), ("c0", "e3"))], "diagram_id long, a string, b string, path array<struct<x:double,y:double>>")
    got = {(r.start_index, r.endpoint_index): r.total_div for r in tracing.enumerate_paths(nodes, links).collect()}
    assert got[(0, 2)] == pytest.approx(0) and got[(0, 3)] == pytest.approx(90) and len(got) == 6


def test_crossing_boxes_are_drawn_apart(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 8.0, 0.0, 10.0, 10.0), (1, 2, 50.0, 50.0, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "diagram_id long, crossing_index long, x double, y double, w double, h double")
    got = {r.crossing_index: (r.x, r.w) for r in tracing.split_overlapping_crossings(df).collect()}
    assert got == {0: (0.0, 9.0), 1: (9.0, 9.0), 2: (50.0, 4.0)}


def test_folder_of_pictures(spark, tmp_path):
    import struct
    import zlib

    def png(pixels):
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        raw = b"".join(b"\0" + row.tobytes() for row in pixels)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    (tmp_path / "one.b.png").write_bytes(png(np.full((3, 5, 3), 7, np.uint8)))
    (tmp_path / "two.txt").write_text("no picture")
    (row,) = files.read_images(spark, str(tmp_path)).withColumn("id", F.lit(4)).collect()
    assert (row.file_name, row.stem, row.image.width, row.image.height) == ("one.b.png", "one.b", 5, 3)
    out = str(tmp_path / "out")
    for some in ([(i, "first") for i in range(200)], [(i, "again") for i in range(150, 250)]):
        files.write_plantuml(spark.createDataFrame(some, "diagram_id long, plantuml string"), out)
    got = {r.diagram: r.plantuml for r in files.read_plantuml(spark, out).collect()}
    assert got == {str(i): "first" if i < 150 else "again" for i in range(250)} and files.read_plantuml(spark, out).count() == 250


def test_texts_are_appended_and_brought_together(spark, tmp_path):
    out, texts = f"file://{tmp_path}/out", lambda some: spark.createDataFrame(some, "diagram_id long, plantuml string")
    size = lambda: sum(f.stat().st_size for f in tmp_path.rglob("part-*"))
    assert files.read_plantuml(spark, out).count() == 0
    files.write_plantuml(texts([(i, f"{i} " * 2000) for i in range(300)]), out)
    before = size()
    files.write_plantuml(texts([(7, "new"), (7, "a"), (999, "more")]), out)
    assert size() - before < 0.2 * before  # a small run writes little, whatever is there
    with pytest.raises(Exception, match="no text"):
        files.write_plantuml(texts([(i, "half") for i in range(9)]).withColumn("plantuml", F.when(F.col("diagram_id") == 8, F.raise_error(F.lit("no text")).cast("string")).otherwise(F.col("plantuml"))), out)
    want = {str(i): f"{i} " * 2000 for i in range(300)} | {"7": "new", "999": "more"}
    got = lambda: {r.diagram: r.plantuml for r in files.read_plantuml(spark, out).collect()}
    assert got() == want
    files.compact_plantuml(spark, out)
    files.compact_plantuml(spark, out)
    assert got() == want
    files.write_plantuml(texts([(7, "newest")]), out)
    assert got() == want | {"7": "newest"}


def plain_follow(spots, starts, counts, barred):
    """One source's way, a pixel at a time; a pixel that waits is told anew where it was last touched from."""
    came, done, todo = {}, set(), list(starts)
    while todo:
        here = todo.pop(0)
        if here in done or here == barred:
            continue
        done.add(here)
        if counts(here):
            path = [here]
            while path[-1] in came:
                path.append(came[path[-1]])
            return path[::-1]
        for dy, dx in tracing.STEPS:
            there = (here[0] + dy, here[1] + dx)
            if there in spots and there not in done and there != barred:
                came[there] = here
                todo.append(there)
    return []


@pytest.mark.parametrize("wave", [1 << 24, 300])
def test_waves_follow_as_a_pixel_at_a_time_does(monkeypatch, wave):
    monkeypatch.setattr(tracing, "WAVE", wave)
    rnd = np.random.default_rng(11)
    lines, stops, groups, sources, want = [], [], [], [], []
    for d in range(60):
        spots = {(int(y), int(x)) for y, x in rnd.integers(0, 14, size=(int(rnd.choice([1, 20, 90])), 2))}
        of = tracing._Lines(list(spots))
        told = rnd.permutation(len(of.points))[:4]
        at = np.full(len(of.points), -1, dtype=np.int64)
        at[told] = np.arange(len(told))
        group = rnd.integers(-1, 2, size=len(told))
        for own in range(len(told)):
            starts = [int(told[own])] if own % 2 else [int(i) for i in rnd.integers(0, len(of.points), size=3)]
            barred = -1 if own % 2 else int(told[own])
            sources.append(tracing._Source(d, own, int(group[own]), starts, barred))
            number = {p: int(at[i]) for i, p in enumerate(of.points)}
            counts = lambda p, own=own, group=group, number=number: number[p] >= 0 and number[p] != own and not (group[own] >= 0 and group[number[p]] == group[own])
            want.append(plain_follow(spots, [of.points[i] for i in starts], counts, of.points[barred] if barred >= 0 else None))
        lines.append(of)
        stops.append(at)
        groups.append(group)
    got = tracing.follow(lines, stops, groups, sources)
    assert [[lines[s.lines].points[i] for i in path] for s, path in zip(sources, got, strict=True)] == want


def test_every_path_of_a_ladder_comes_once(spark):
    """Six crossings in a row with two ways from each to the next: 2 ** 5 paths from end to end, and back."""
    nodes = [(0, "e0", "endpoint", 0.0, 0.0), (0, "e1", "endpoint", 60.0, 0.0), *((0, f"c{i}", "crossing", 10.0 * i + 5, 0.0) for i in range(6))]
    ties = [("e0", "c0"), ("c5", "e1")]
    for i in range(5):
        for side, y in (("u", 5.0), ("v", -5.0)):
            nodes.append((0, f"b{i}{side}", "border", 10.0 * i + 10, y))
            ties += [(f"c{i}", f"b{i}{side}"), (f"b{i}{side}", f"c{i + 1}")]
    nodes = spark.createDataFrame(nodes, "diagram_id long, node string, kind string, x double, y double")
    edges = spark.createDataFrame([(0, a, b, [(0.0, 0.0)]) for a, b in ties], "diagram_id long, a string, b string, path array<struct<x:double,y:double>>")
    got = tracing.enumerate_paths(nodes, edges).collect()
    whole = [r for r in got if len(r.nodes) == 13]
    assert len(got) == len(whole) == 64 and len({tuple(r.nodes) for r in got}) == 64 and all(len(r.path) == 12 for r in got)
    assert len({r.total_div for r in whole}) > 1
    assert tracing.enumerate_paths(nodes, edges, 5).count() == 0 and tracing.enumerate_paths(nodes.limit(0), edges).count() == 0


def pngs(path):
    """Pictures that a reader sees: tasks of a failed run may still write below _temporary."""
    return sorted(f.name for f in path.rglob("*.png") if "_temporary" not in f.parts) if path.exists() else []


def test_written_pictures_read_back(spark, tmp_path):
    rng = np.random.default_rng(3)
    shapes = [(1, 1, 1), (7, 5, 3), (4, 9, 4), (30, 20, 3)]
    pictures = [rng.integers(1, 256, size=s).astype(np.uint8) for s in shapes]
    named = rasters(spark, *pictures).withColumn("file_name", F.concat(F.lit("p"), F.col("diagram_id").cast("string"), F.lit(".png"))).withColumn("more", F.lit(1))
    out = tmp_path / "out"
    write_pictures(named.repartition(3), f"file://{out}")
    write_pictures(named.repartition(2), f"file://{out}", "overwrite")  # in place of the first run
    assert pngs(out) == ["p0.png", "p1.png", "p2.png", "p3.png"] and not [x for x in (out / "_temporary").iterdir()]  # both ended well
    for r in files.read_images(spark, str(out)).collect():
        image = pictures[int(r.stem[1:])]
        assert (r.image.height, r.image.width, r.image.nChannels) == image.shape
        assert np.frombuffer(r.image.data, np.uint8).tolist() == image.reshape(-1).tolist()
    assert sorted(tuple(r) for r in files.list_images(spark, str(out)).collect()) == [(f"p{i}.png", f"p{i}") for i in range(4)]


def test_a_failed_run_leaves_no_picture(spark, tmp_path):
    good = rasters(spark, *[np.zeros((2, 2, 3), np.uint8)] * 4).withColumn("file_name", F.concat(F.col("diagram_id").cast("string"), F.lit(".png")))
    out = tmp_path / "out"
    with pytest.raises(ValueError, match="several pictures"):
        write_pictures(good.withColumn("file_name", F.lit("same.png")), f"file://{out}")
    short = F.when(F.col("diagram_id") == 3, F.substring("data", 1, 5)).otherwise(F.col("data"))
    with pytest.raises(Exception, match="reshape"):
        write_pictures(good.withColumn("data", short).repartition(4, "diagram_id"), f"file://{out}")
    assert pngs(out) == []
    write_pictures(good.limit(0), f"file://{out}")
    assert pngs(out) == []


def test_attempts_that_were_not_committed_go(tmp_path):
    writer = PictureWriter(f"file://{tmp_path}", overwrite=False)
    for folder in ("part-0-1", "part-0-2"):
        (tmp_path / "_temporary" / writer.run / folder).mkdir(parents=True)
        (tmp_path / "_temporary" / writer.run / folder / "a.png").write_bytes(png(np.zeros((1, 1, 1), np.uint8)))
    writer.commit([Written("part-0-2", 1), None])
    assert [str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*.png")] == [f"{writer.run}/part-0-2/a.png"]


def test_a_folder_is_prepared(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    white = np.full((12, 12, 3), 255, np.uint8)
    named = rasters(spark, white, white, white[..., :1]).withColumn("file_name", F.concat(F.lit("IMG."), F.col("diagram_id").cast("string"), F.lit(".png")))
    write_pictures(named, f"file://{source}")
    some = spark.createDataFrame([("IMG.0.png", "Class", 0, 0, 8, 8), ("IMG.0.png", "Struck Class", 4, 4, 12, 12), ("IMG.0.png", "Note", 8, 0, 12, 4), ("IMG.1.png", "line", 0, 0, 2, 2)], "name string, label string, x1 long, y1 long, x2 long, y2 long")
    regions = some.select(F.xxhash64("name").alias("diagram_id"), "label", "x1", "y1", "x2", "y2", F.lit(None).cast("array<array<struct<x:double,y:double>>>").alias("rings"))
    images.prepare_folder(spark, f"file://{source}", f"file://{target}", lambda _: regions, "mark")
    got = {r.stem: np.frombuffer(r.image.data, np.uint8).reshape(12, 12, 3) for r in files.read_images(spark, str(target)).collect()}
    assert sorted(got) == ["IMG.0", "IMG.1", "IMG.2"]
    assert got["IMG.0"][1, 1].tolist() == [178, 255, 178] and got["IMG.0"][10, 10].tolist() == [178, 178, 255] and got["IMG.0"][2, 10].tolist() == [255] * 3
    assert got["IMG.0"][5, 5].tolist() == [125, 178, 201]  # struck classes come after classes
    assert got["IMG.1"][1, 1].tolist() == [255, 178, 178] and (got["IMG.2"] == 255).all()
    with pytest.raises(ValueError, match="unknown mode"):
        images.prepare_images(named, regions, "paint")


def test_sums_of_large_rasters_take_one_pass(spark):
    data = bytes(i % 251 for i in range(300 * 200 * 3))
    one = _sums(spark.createDataFrame([(1, 300, 200, 3, data), (2, 1, 1, 1, bytes([7])), (3, 0, 0, 3, b"")], images.IMAGE))
    assert "hex(" not in one._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in one.collect()) == [(1, 300, 200, 3, sum(data)), (2, 1, 1, 1, 7), (3, 0, 0, 3, 0)]


def test_small_pictures_are_read_and_written_by_few_tasks_and_more_than_one(spark, tmp_path):
    plain = spark.range(0, 96, 1, 1).selectExpr("concat('p', id, '.png') AS file_name", "2 AS width", "1 AS height", "1 AS channels", "unhex('10ff') AS data")
    write_pictures(plain, f"file://{tmp_path}/in", dealt=8)
    assert len({p.parent for p in tmp_path.glob("in/run-*/*/*.png")}) > 4
    assert len(list(tmp_path.glob("in/run-*/*/*.png"))) == 96
    found = files.read_images(spark, f"file://{tmp_path}/in")
    assert found.count() == 96 and found.rdd.getNumPartitions() <= 4  # 32 pictures a task, whatever their size, before


def test_folders_of_several_kinds_from_one_reading(spark, tmp_path, monkeypatch):
    reads, read = [], files.read_images
    monkeypatch.setattr(files, "read_images", lambda s, p: reads.append(p) or read(s, p))
    plain = spark.range(5).selectExpr("concat('p', id, '.png') AS file_name", "4 AS width", "4 AS height", "1 AS channels", "unhex(repeat('40', 16)) AS data")
    write_pictures(plain, f"file://{tmp_path}/in")
    regions = lambda rasters: rasters.selectExpr("diagram_id", "'Class' AS label", "0L AS x1", "0L AS y1", "2L AS x2", "2L AS y2", "CAST(NULL AS array<array<struct<x:double,y:double>>>) AS rings")
    jobs = [(f"file://{tmp_path}/{mode}", mode, ("classes",)) for mode in ("mark", "mark_with_border", "remove")]
    images.prepare_folders(spark, f"file://{tmp_path}/in", regions, jobs)
    assert len(reads) == 1
    for target, mode, kinds in jobs:
        images.prepare_folder(spark, f"file://{tmp_path}/in", f"{target}-alone", regions, mode, kinds)
        one, alone = (sorted((r.file_name, bytes(r.image.data)) for r in read(spark, p).collect()) for p in (target, f"{target}-alone"))
        assert one == alone and len(one) == 5


def test_pixels_come_to_the_line_graph_once(spark):
    """One shuffle for pixels, ends and crossings, also where pixels are drawn in the task; ends are snapped and border
    points found as by the operators of their own."""
    rnd = np.random.default_rng(3)
    spots = [(d, int(y), int(x)) for d in range(4) for y, x in {tuple(p) for p in rnd.integers(0, 30, size=(260, 2))}]
    pixels = spark.createDataFrame(spots, "diagram_id long, y long, x long")
    ends = spark.createDataFrame([(d, i, float(rnd.integers(0, 60)) / 2, float(rnd.integers(-9, 90)) / 2) for d in range(5) for i in range(12)], "diagram_id long, endpoint_index long, x double, y double")
    boxes = spark.createDataFrame([(d, k, float(7 * k), float(rnd.integers(0, 20)), 5.5, 6.0) for d in range(3) for k in range(4)], "diagram_id long, crossing_index long, x double, y double, w double, h double")
    told = lambda df: sorted((r.diagram_id, r.a, r.b, [tuple(p) for p in r.path]) for r in df.collect())
    got = told(tracing.trace_edges(pixels, ends, boxes))
    assert got == told(tracing.trace_edges(pixels, tracing.snap_endpoints(ends, pixels), boxes))
    rim = sorted((r.diagram_id, r.crossing_index, float(r.x), float(r.y)) for r in tracing.crossing_border_points(pixels, boxes).collect())
    assert rim == sorted((d, int(b[1:]), *path[0]) for d, a, b, path in got if b[0] == "c") and len(rim) > 30
    drawn = tracing.trace_edges(tracing.Drawn(pixels, ("y", "x"), lambda rows: np.array([y * (1 << 32) + x for y, x in rows], dtype=np.int64)), ends, boxes)
    assert told(drawn) == got and drawn._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_paths_are_walked_in_few_rounds_and_left_open_ones_dealt_anew(spark, monkeypatch):
    """A round an edge before; with three steps a round the same paths come in many."""
    nodes, ties = [(d, f"e{i}", "endpoint", 70.0 * i, 0.0) for d in range(3) for i in (0, 1)], [("e0", "c0"), ("c4", "e1")]
    nodes += [(d, f"{k}{i}", kind, 10.0 * i + x, y) for d in range(3) for i in range(5) for k, kind, x, y in (("c", "crossing", 5.0, 0.0), ("b1", "border", 10.0, 5.0), ("b2", "border", 10.0, -5.0))]
    ties += [t for i in range(4) for b in ("b1", "b2") for t in ((f"c{i}", f"{b}{i}"), (f"{b}{i}", f"c{i + 1}"))]
    nodes = spark.createDataFrame(nodes, "diagram_id long, node string, kind string, x double, y double")
    edges = spark.createDataFrame([(d, k, a, b, [(float(k), float(i)) for i in range(k + 1)]) for d in range(3) for k, (a, b) in enumerate(ties)], "diagram_id long, edge int, a string, b string, path array<struct<x:double,y:double>>")
    seen, written = [], tracing.written
    monkeypatch.setattr(tracing, "written", lambda df, name: seen.append(name) or written(df, name))
    told = lambda df: sorted(map(tuple, df.select("diagram_id", "start_index", "endpoint_index", "total_div", "steps", "path_len").collect()))
    whole = told(tracing.enumerate_routes(nodes, edges))
    assert len(whole) == 3 * 32 == len(set(map(str, whole))) and len(seen) == 1
    assert told(tracing.enumerate_routes(nodes, edges, most_steps=3)) == whole and len(seen) > 4
    pointed = tracing.with_points(tracing.enumerate_routes(nodes, edges), edges).collect()
    assert all(r.path_len == len(r.path) == sum(abs(s) for s in r.steps) for r in pointed) and len(pointed) == 96
    assert all([p.y for p in r.path[: abs(r.steps[0])]] == sorted([p.y for p in r.path[: abs(r.steps[0])]], reverse=r.steps[0] < 0) for r in pointed)
    full = tracing.enumerate_paths(nodes, edges).collect()
    assert sorted((r.diagram_id, r.start_index, r.path) for r in full) == sorted((r.diagram_id, r.start_index, r.path) for r in pointed)
