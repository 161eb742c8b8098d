"""Resolved connections to oriented relationships, and classes and relationships to PlantUML text.

Null roles, multiplicities and names count as empty. A diagram without classes or relationships still gives
its frame; relationships of classes that are not there are left out."""

from __future__ import annotations

import base64
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_quotes

EMPTY, ARROW = "Empty End", "Arrow End"

# fixed values: the sign of each end shape
SIGNS = {"Empty End": "--", "Arrow End": "-->", "Triangle End": "--|>", "Empty Diamond End": "--o", "Filled Diamond End": "--*"}

# fixed values: the alphabet of diagram keys, and that of base64 in the same order of values
KEY_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"
BASE64_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def resolve_end_shapes(connections: DataFrame) -> DataFrame:
    """At most one end keeps its shape: of two arrows none, an arrow yields to another shape, and of two
    others the higher score stays, the second end's on a tie."""
    a, b = F.col("end_shape_0"), F.col("end_shape_1")
    both = (a != EMPTY) & (b != EMPTY)
    first = (a == ARROW) | (b != ARROW) & ~(F.col("shape_score_0") > F.col("shape_score_1"))
    second = (b == ARROW) | (a != ARROW) & (F.col("shape_score_0") > F.col("shape_score_1"))
    return connections.withColumns({"end_shape_0": F.when(both & first, EMPTY).otherwise(a), "end_shape_1": F.when(both & second, EMPTY).otherwise(b)})


_SIDED = ("class_index", "end_shape", "multiplicity", "role")


def orient_relationship(connections: DataFrame) -> DataFrame:
    """Swaps the sides of connections which have a shape on the first end only."""
    swap = (F.col("end_shape_0") != EMPTY) & (F.col("end_shape_1") == EMPTY)
    sided = {f"{c}_{i}": F.when(swap, F.col(f"{c}_{1 - i}")).otherwise(F.col(f"{c}_{i}")) for c in _SIDED for i in (0, 1)}
    return connections.withColumns(sided)


def relationship_type(shape: Column) -> Column:
    """The sign of an end shape; a shape outside the vocabulary has none."""
    out = F.lit(None).cast("string")
    for name, sign in SIGNS.items():
        out = F.when(shape == name, sign).otherwise(out)
    return out


def build_relationships(connections: DataFrame, classes: DataFrame) -> DataFrame:
    """Oriented relationships with the names of both classes, by two lookups on (diagram, class)."""
    ready = orient_relationship(resolve_end_shapes(connections)).withColumn("type", relationship_type(F.col("end_shape_1")))
    named = lambda i: classes.select("diagram_id", F.col("class_index").alias(f"class_index_{i}"), F.col("name").alias(n))
    for i, n in ((0, "source"), (1, "target")):
        ready = ready.join(named(i), ["diagram_id", f"class_index_{i}"])
    return ready


def render_class_block(name: Column, stereotype: Column, attributes: Column, methods: Column) -> Column:
    """`class "name" <<stereotype>> {`, a tab before each member, `}`."""
    head = F.concat(F.lit('class "'), escape_quotes(name), F.lit('"'), F.coalesce(F.concat(F.lit(" "), stereotype), F.lit("")), F.lit(" {"))
    members = F.transform(F.concat(attributes, methods), lambda m: F.concat(F.lit("\t"), m))
    return F.array_join(F.concat(F.array(head), members, F.array(F.lit("}"))), "\n")


def render_relationship(source: Column, target: Column, type_: Column, role_0: Column, mult_0: Column, role_1: Column, mult_1: Column, name: Column) -> Column:
    """`"source" "role mult" --> "role mult" "target" : "name"`; empty parts are left out."""
    quoted = lambda text: F.concat(F.lit('"'), escape_quotes(text), F.lit('"'))

    def side(role: Column, mult: Column) -> Column:
        parts = F.filter(F.array(F.coalesce(role, F.lit("")), F.coalesce(mult, F.lit(""))), lambda x: x != "")
        return F.when(F.size(parts) > 0, quoted(F.array_join(parts, " ")))

    label = F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(": "), quoted(name)))
    return F.concat_ws(" ", quoted(source), side(role_0, mult_0), type_, side(role_1, mult_1), quoted(target), label)


def to_plantuml(diagrams: DataFrame, classes: DataFrame, relationships: DataFrame) -> DataFrame:
    """(diagram_id, plantuml): one text a diagram. Lines are gathered once, ordered by kind and index."""
    of_class = classes.select("diagram_id", F.lit(0).alias("kind"), F.col("class_index").cast("long").alias("at"), render_class_block(F.col("name"), F.col("stereotype"), F.col("attributes"), F.col("methods")).alias("line"))
    cols = [F.col(c) for c in ("source", "target", "type", "role_0", "multiplicity_0", "role_1", "multiplicity_1", "name")]
    of_link = relationships.select("diagram_id", F.lit(1).alias("kind"), F.col("rel_index").cast("long").alias("at"), render_relationship(*cols).alias("line"))
    lines = of_class.unionByName(of_link).groupBy("diagram_id").agg(F.array_sort(F.collect_list(F.struct("kind", "at", "line"))).alias("lines"))
    told = F.coalesce(F.transform("lines", lambda r: r["line"]), F.array().cast("array<string>"))
    frame = F.array_join(F.concat(F.array(F.lit("@startuml")), told, F.array(F.lit("@enduml"))), "\n")
    return diagrams.select("diagram_id").distinct().join(lines, "diagram_id", "left").select("diagram_id", frame.alias("plantuml"))


def plantuml_key(text: Column) -> Column:
    """The key under which renderers take a text: raw deflate of its UTF-8 in a 6-bit alphabet, padded with
    zero bits to whole groups of three bytes."""
    table = str.maketrans(BASE64_ALPHABET, KEY_ALPHABET)

    @F.pandas_udf("string")
    def keyed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            raw = zlib.compress(text.encode("utf-8"))[2:-4]
            return base64.b64encode(raw + bytes(-len(raw) % 3)).decode("ascii").translate(table)

        return texts.map(one)

    return keyed(text)
