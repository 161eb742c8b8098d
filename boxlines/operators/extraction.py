"""The composed flow: from boxes, line ends, pixels and labels to connections, and on to PlantUML."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import assign, connections, diagram, endpoints as ends_, regions, results, text, tracing
from .stages import written


def evaluate_connections(pixels: DataFrame | tracing.Drawn, boxes: DataFrame, endpoints: DataFrame, crossings: DataFrame, shapes: DataFrame, scales: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(connections, ends) of the diagrams that have class boxes and more than two endpoints.

    pixels: (diagram_id, y, x) of thinned lines, or Drawn; boxes: (diagram_id, class_index, x, y, w, h); endpoints:
    (diagram_id, endpoint_id, x, y); crossings: (diagram_id, crossing_index, x, y, w, h); shapes:
    (diagram_id, shape_index, x, y, w, h, label, score). Endpoints are thinned out and attached, and numbered
    in that order; lines are traced between them, the best path of each is taken, and connections that share
    an endpoint or end in a gap are put together. Every distance is scaled by the diagram's class boxes (scales:
    theirs, if they are there already).
    connections: as rewrite_connections gives them; ends: (diagram_id, endpoint_index, class_index,
    end_shape, shape_score, x, y). What is used several times is written once, to the shared folder: plans that
    hold it as often instead take the driver's memory, however small the tables are."""
    scales = written(regions.scale_factor(boxes), "scales") if scales is None else scales
    raw = endpoints.groupBy("diagram_id").agg(F.count("*").alias("n_endpoints"))
    thinned = written(ends_.dedupe_endpoints(endpoints, boxes, scales), "endpoints")
    near = written(ends_.attachment(thinned, boxes, scales), "attachment")
    attached = ends_.attach_endpoints(thinned, boxes, scales, near).withColumnRenamed("position", "endpoint_index")
    kept = written(thinned.join(attached, ["diagram_id", "endpoint_id"]), "attached")
    shaped = ends_.end_shape_mapping(kept.select("diagram_id", "endpoint_id", "x", "y"), shapes, scales)
    ends = written(kept.join(shaped, ["diagram_id", "endpoint_id"]), "ends")
    number = lambda c: ends.select("diagram_id", F.col("endpoint_id").alias(c), F.col("endpoint_index").alias(f"{c}_index"))
    gaps = ends_.gap_pairs(thinned, boxes, scales, near).join(number("a"), ["diagram_id", "a"]).join(number("b"), ["diagram_id", "b"])
    gaps = gaps.select("diagram_id", F.col("a_index").alias("a"), F.col("b_index").alias("b"))

    split = written(tracing.split_overlapping_crossings(crossings), "crossings")
    edges = written(tracing.trace_edges(pixels, ends.select("diagram_id", "endpoint_index", "x", "y"), split), "edges")
    routes = tracing.enumerate_routes(tracing.graph_nodes(ends, edges), edges)
    for at, side in (("start_index", "a"), ("endpoint_index", "b")):
        told = ends.select("diagram_id", F.col("endpoint_index").alias(at), F.col("class_index").alias(f"class_{side}"), F.col("end_shape").alias(f"end_shape_{int(side == 'b')}"), F.col("shape_score").alias(f"shape_score_{int(side == 'b')}"))
        routes = routes.join(told, ["diagram_id", at])
    first = written(connections.first_paths(routes, raw, scales), "first_paths")
    alone, tied = first.where("n_first = 1"), first.where("n_first > 1")
    if not tied.isEmpty():  # points, which decide, are many
        pointed = tracing.with_points(tied, edges.join(tied.select("diagram_id").distinct(), "diagram_id", "left_semi"))
        by = F.row_number().over(Window.partitionBy("diagram_id", "start_index").orderBy("path"))
        alone = alone.unionByName(pointed.withColumn("__at", by).where("__at = 1").drop("__at", "path"))
    best = written(connections.dedupe_undirected(alone.drop("n_first")), "best")
    many = raw.where("n_endpoints > 2").select("diagram_id")
    ends = ends.join(many, "diagram_id", "left_semi").select("diagram_id", "endpoint_index", "class_index", "end_shape", "shape_score", "x", "y")
    rewritten = connections.rewrite_connections(best, ends, gaps.join(many, "diagram_id", "left_semi"))
    return tracing.with_points(connections.final_connections(rewritten, scales=scales), edges, ends).drop("steps"), ends


def assign_labels(links: DataFrame, ends: DataFrame, labels: DataFrame, scales: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(clusters, roles, names, multiplicities) of labels (diagram_id, label_id, kind, x1 .. y2): text boxes
    with their clusters and places; clusters with the endpoints, or else the connections, whose they are; and
    multiplicity boxes with their endpoints, not decoded yet."""
    used = written(connections.connection_endpoints(links).join(ends.select("diagram_id", "endpoint_index", "x", "y"), ["diagram_id", "endpoint_index"]), "used")
    texts = labels.where("kind = 'Relationship label'")
    clusters = written(assign.cluster_text_boxes(texts), "clusters")
    bounds = assign.cluster_bounds(clusters, texts).withColumnRenamed("cluster_id", "left_id")
    roles = written(assign.optimal_assignment(assign.assignment_candidates(bounds, used.withColumnRenamed("endpoint_index", "right_id"), 30.0, scales)), "roles")
    free = bounds.join(roles.select("diagram_id", "left_id"), ["diagram_id", "left_id"], "left_anti")
    free = written(free, "free")
    lines = links.select("diagram_id", F.col("rel_index").alias("right_id"), "path")
    segments = written(assign.near_segments(free, lines, 20.0, scales), "segments")
    names = written(assign.optimal_assignment(assign.line_candidates(free, segments, 20.0, scales)), "names")
    multiplicities = written(assign.multiplicity_pairs(labels.where("kind = 'Multiplicity'"), used, scales), "multiplicities")
    ids = lambda df, target: df.select("diagram_id", F.col("left_id").alias("cluster_id"), F.col("right_id").alias(target))
    return clusters, ids(roles, "endpoint_index"), ids(names, "rel_index"), multiplicities


def _read(clusters: DataFrame, assigned: DataFrame, target: str, label_texts: DataFrame) -> DataFrame:
    """(diagram_id, target, text): the texts of an assigned cluster, in its order."""
    placed = clusters.join(label_texts, ["diagram_id", "label_id"]).select("diagram_id", "cluster_id", "pos", "score", "text")
    rows = text.label_text_rows(assigned.withColumnRenamed(target, "target_id"), placed)
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), " ")
    return rows.groupBy("diagram_id", F.col("target_id").alias(target)).agg(told.alias("text"))


def extract_tables(diagrams: DataFrame, boxes: DataFrame, class_texts: DataFrame, pixels: DataFrame | tracing.Drawn, endpoints: DataFrame, crossings: DataFrame, shapes: DataFrame, labels: DataFrame, label_texts: DataFrame, choices: DataFrame) -> dict[str, DataFrame]:
    """An extraction's tables by name, from detection tables: the connections (links) and their ends, clusters
    of labels, roles and names, multiplicity boxes with their endpoints, texts of classes, classes,
    relationships, and the rendered texts (plantuml). label_texts: (diagram_id, label_id, score, text), the
    label boxes as read; choices: (diagram_id, label_id, choice)."""
    scales = written(regions.scale_factor(boxes), "scales")
    links, ends = evaluate_connections(pixels, boxes, endpoints, crossings, shapes, scales)
    links, ends = written(links, "links"), written(ends, "line_ends")
    clusters, roles, names, pairs = assign_labels(links, ends, labels, scales)
    multiplicities = assign.decode_pairs(pairs, choices, links)
    key = ["diagram_id", "rel_index"]
    side = lambda df, column, out: df.groupBy(*key).agg(*(F.max(F.when(F.col("side") == i, F.col(column))).alias(f"{out}_{i}") for i in (0, 1)))
    role_texts = written(side(connections.attach_to_connection(_read(clusters, roles, "endpoint_index", label_texts), links), "text", "role"), "role_texts")
    name_texts = written(_read(clusters, names, "rel_index", label_texts).withColumnRenamed("text", "name"), "name_texts")
    named = links.select(*key, F.col("class_a").alias("class_index_0"), F.col("class_b").alias("class_index_1"), "end_shape_0", "end_shape_1", "shape_score_0", "shape_score_1")
    named = named.join(role_texts, key, "left").join(side(multiplicities, "multiplicity", "multiplicity"), key, "left").join(name_texts, key, "left")
    shown = boxes.select("diagram_id", "class_index").hint("merge")  # all boxes: Spark takes them for small
    classes = written(text.build_classes(class_texts).join(shown, ["diagram_id", "class_index"], "left_semi"), "classes")
    relationships = written(diagram.build_relationships(written(named, "named"), classes), "relationships")
    rendered = written(diagram.to_plantuml(diagrams, classes, relationships), "rendered")
    told = text.class_text_rows(class_texts).join(shown, ["diagram_id", "class_index"], "left_semi")
    return {"links": links, "ends": ends, "clusters": clusters, "roles": roles, "names": names, "multiplicities": pairs, "class_texts": told, "classes": classes, "relationships": relationships, "plantuml": rendered}


def extract_diagrams(diagrams: DataFrame, boxes: DataFrame, class_texts: DataFrame, pixels: DataFrame | tracing.Drawn, endpoints: DataFrame, crossings: DataFrame, shapes: DataFrame, labels: DataFrame, label_texts: DataFrame, choices: DataFrame) -> DataFrame:
    """(diagram_id, plantuml) from detection tables, see extract_tables."""
    return extract_tables(diagrams, boxes, class_texts, pixels, endpoints, crossings, shapes, labels, label_texts, choices)["plantuml"]


def extraction_counts(diagrams: DataFrame, boxes: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(diagram_id, n_classes, n_relationships, n_class_texts, n_labels, n_multiplicities) of an extraction:
    class boxes, connections, texts of classes, clusters with a role or a name, and multiplicity boxes that
    have an endpoint, whatever they are read as."""
    labels = tables["roles"].select("diagram_id").unionAll(tables["names"].select("diagram_id"))
    return results.diagram_counts(diagrams, classes=boxes, relationships=tables["links"], class_texts=tables["class_texts"], labels=labels, multiplicities=tables["multiplicities"])
