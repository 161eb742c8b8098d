"""Joins by grid cells against all pairs."""

import math
import random
import time

from pyspark.sql import functions as F

from boxlines.functions import geometry
from boxlines.functions import outlines as shapes
from boxlines.operators import connections, grid, stages
from boxlines.operators.grid import box_pairs, nearest_points
from boxlines.operators.grouped import per_batch
from boxlines.operators.tracing import snap_endpoints

BOX = "diagram_id long, {0} long, {0}x1 double, {0}y1 double, {0}x2 double, {0}y2 double"


def sides(name):
    return tuple(F.col(f"{name}{s}") for s in ("x1", "y1", "x2", "y2"))


def test_boxes_meet_once(spark):
    rnd = random.Random(7)

    def some(n):
        out = []
        for i in range(n):
            x, y, size = rnd.randrange(-40, 40), rnd.randrange(-40, 40), rnd.choice([0, 1, 5, 20, 400])
            out.append((i % 3, i, float(x), float(y), float(x + rnd.randrange(size + 1)), float(y + rnd.randrange(size + 1))))
        return out + [(0, 1000, None, 0.0, 1.0, 1.0), (5, 1001, 0.0, 0.0, 1.0, 1.0)]

    a, b = some(120), some(150)[:-1]
    got = box_pairs(spark.createDataFrame(a, BOX.format("a")), spark.createDataFrame(b, BOX.format("b")), sides("a"), sides("b"))
    assert got.columns == ["diagram_id", *(f"{n}{s}" for n in "ab" for s in ("", "x1", "y1", "x2", "y2"))]
    want = sorted((p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and None not in p and None not in q and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5])
    assert sorted((r.diagram_id, r.a, r.b) for r in got.collect()) == want and want


def test_points_alone_meet_where_they_agree(spark):
    rows = [(1, i, float(i % 4), 0.0, float(i % 4), 0.0) for i in range(12)]
    df = spark.createDataFrame(rows, BOX.format("a"))
    got = box_pairs(df, df.toDF("diagram_id", *(f"b{c[1:]}" for c in df.columns[1:])), sides("a"), sides("b"))
    assert got.count() == 4 * 9


def test_nearest_points_of_any_spread(spark):
    rnd = random.Random(8)
    rows = [(d, i, rnd.choice([rnd.random(), rnd.randrange(10), 10.0 ** rnd.randrange(6)]) + 0.0, rnd.random() * rnd.choice([1, 1e4])) for d in range(8) for i in range([1, 2, 3, 60, 200, 5, 9, 30][d])]
    rows += [(9, i, 1.5, 2.5) for i in range(5)] + [(10, i, float(i), 0.0) for i in range(20)]
    want = []
    for d, i, x, y in rows:
        others = [(math.sqrt((x - u) ** 2 + (y - v) ** 2), j) for e, j, u, v in rows if e == d and j != i]
        if others:
            want.append((d, i, min(others)[1]))
    df = spark.createDataFrame(rows, "diagram_id long, p long, x double, y double")
    assert sorted((r.diagram_id, r.p, r.other_id) for r in nearest_points(df, "p").collect()) == sorted(want)


def test_work_follows_the_boxes(spark):
    """Boxes side by side: what is compared grows with the boxes, not with their pairs."""
    for n in (1_000, 4_000):
        df = spark.range(n).select(F.lit(1).cast("long").alias("diagram_id"), F.col("id").alias("a"), *(((F.col("id") * 10) + k).cast("double").alias(f"a{s}") for s, k in (("x1", 0), ("y1", 0), ("x2", 10), ("y2", 10))))
        df = df.withColumn("ay1", F.lit(0.0)).withColumn("ay2", F.lit(10.0))
        other = df.toDF("diagram_id", *(f"b{c[1:]}" for c in df.columns[1:]))
        assert box_pairs(df, other, sides("a"), sides("b")).count() == 3 * n - 2
        assert "diagram_id" in (plan := box_pairs(df, other, sides("a"), sides("b"))._jdf.queryExecution().optimizedPlan().toString()) and "__cx" in plan


def test_what_is_asked_of_nine_cells_is_not_broadcast(spark, monkeypatch):
    plans, written = [], grid.written
    monkeypatch.setattr(grid, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    rows = [(d, i, float(i * 7 % 50), float(i * 11 % 50)) for d in range(3) for i in range(40)]
    assert nearest_points(spark.createDataFrame(rows, "diagram_id long, i long, x double, y double"), "i").count() == 120
    assert len(plans) > 2 and not [p for p in plans if "Broadcast" in p]


def test_snapping_deals_out_both_sides(spark):
    ends = spark.createDataFrame([(1, i, float(i * 7 % 50), float(i * 11 % 50)) for i in range(40)], "diagram_id long, endpoint_index long, x double, y double")
    pixels = spark.createDataFrame([(1, i, i) for i in range(50)], "diagram_id long, y long, x long")
    found = snap_endpoints(grid.written(ends, "ends"), grid.written(pixels, "pixels"))
    assert found.count() and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_python_gets_bounded_batches_of_groups(spark):
    rows = spark.range(0, 1_000_000, 1, 4).selectExpr("id % 2000 AS diagram_id", "id AS a", "id * 0.5D AS b", "id * 2 AS c").coalesce(1)
    calls = per_batch([(rows, ("a", "b", "c"))], ("diagram_id",), lambda groups: [(k[0], sum(len(r) for _, r in groups)) for k, _ in groups], "n long")
    most, groups = calls.agg(F.max("n"), F.count("*")).first()
    assert groups == 2000 and most < 400_000


def test_tables_that_pack_well_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(stages, "BROADCAST_BYTES", 1 << 10)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        rows = grid.written(spark.range(20_000).selectExpr("id AS diagram_id", "1 AS a"), "packed")
        assert "Broadcast" not in rows.join(rows.withColumnRenamed("a", "b"), "diagram_id")._jdf.queryExecution().executedPlan().toString()
        for off in ("-1", "512b"):  # a narrower bound of the caller's stays
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", off)
            assert stages.bounded_broadcasts(rows) is rows and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == off
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_partitions_of_connections_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(stages, "PART_BYTES", 256 << 10)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        paths = spark.range(0, 300_000, 1, 4).selectExpr("id % 80000 AS diagram_id", "id % 7 AS start_index", "id % 5 AS endpoint_index", "id % 3 AS class_a", "id % 2 AS class_b", "rand(1) AS total_div", "id AS path_len")
        ranked = connections.path_probability(paths).select("*", F.spark_partition_id().alias("part")).where("rank > 0")
        assert ranked.agg(F.max("part")).first()[0] > 8
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)


def test_midpoint_of_a_long_path_is_worked_out_once(spark):
    """Half the length is not summed anew for each step: a path of 20,000 steps takes no 400 million."""
    path = "transform(sequence(0, id), i -> struct(CAST(i AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y))"
    began = time.monotonic()
    got = spark.createDataFrame([(0,), (1,), (20_000,)], "id long").selectExpr("id", f"{path} AS path").select("id", geometry.path_midpoint(F.col("path")).alias("m")).collect()
    assert {r["id"]: r["m"]["x"] for r in got} == {0: 0.0, 1: 0.5, 20_000: 10_000.0}
    assert time.monotonic() - began < 10


def test_a_worker_gets_little_at_once(spark):
    """Groups of 16 MB in all come to Python in many calls, each of little."""
    rows = spark.range(0, 400_000, 1, 1).selectExpr("id % 4000 AS diagram_id", "id AS a", "CAST(id AS DOUBLE) AS x", "CAST(id AS DOUBLE) AS y", "CAST(id AS DOUBLE) AS z")
    calls = per_batch([(rows, ("a", "x", "y", "z"))], ("diagram_id",), lambda groups: [(*groups[0][0], sum(len(r) for _, r in groups))], "n long")
    most, total = calls.agg(F.max("n"), F.sum("n")).first()
    assert total == 400_000 and most < 60_000


def test_what_is_read_from_files_is_bounded(spark):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128MB")
        stages.bounded_parts(spark.range(1))
        assert int(spark.conf.get("spark.sql.files.maxPartitionBytes")) == stages.PART_BYTES
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1MB")  # a narrower bound of the caller's stays
        stages.bounded_parts(spark.range(1))
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "1MB"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_outlines_are_worked_out_so_many_at_a_time(monkeypatch):
    square = lambda x: [(x, 0.0), (x + 2, 0.0), (x + 2, 2.0), (x, 2.0)]
    pairs = [([square(float(i))], [square(i + i % 3 / 2)]) for i in range(50)]
    whole, seen, pieces = shapes.shared_areas(pairs), [], shapes._pieces
    monkeypatch.setattr(shapes, "_GROUPS", 7)
    monkeypatch.setattr(shapes, "_pieces", lambda edges, of, n: (seen.append(n), pieces(edges, of, n))[1])
    assert shapes.shared_areas(pairs) == whole and max(seen) == 7 and len(seen) == 8


def test_plans_of_an_extraction_stay_short(spark, small, monkeypatch):
    """What box_pairs and the line graph take in several times is written before: the driver's memory follows the
    plans, which had up to 339 nodes (paired endpoints) and 146 (edges)."""
    from boxlines.jobs import queries
    from boxlines.operators import assign, endpoints, extraction, stages, tracing

    sizes: dict[str, int] = {}

    def seen(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        sizes[name] = max(sizes.get(name, 0), plan.count("\n"))
        return stages.written(df, name)

    for module in (assign, endpoints, extraction, grid, tracing):
        monkeypatch.setattr(module, "written", seen, raising=False)
    queries.QUERIES["l10_extract_diagrams"](spark, small)
    assert {"attachment", "edges", "roles", "names", "multiplicities", "named"} <= sizes.keys()
    assert {name: n for name, n in sizes.items() if n > 85} == {}
