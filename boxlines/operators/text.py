"""Texts of classes and labels: from scored boxes to names, stereotypes and members.

Rows are keyed by (diagram_id, class_index) and ordered by pos. Rows with null keys form a group of their
own; empty tables give empty tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fix_parentheses, is_method, sanitize_name

KEY = ["diagram_id", "class_index"]
MIN_SCORE = 0.5

# fixed values: the stereotypes that a class can have
STEREOTYPES = (
    "<<interface>>",
    "<<abstract>>",
    "<<enumeration>>",
    "<<exception>>",
    "<<entity>>",
    "<<boundary>>",
    "<<control>>",
    "<<service>>",
    "<<microservice>>",
    "<<database>>",
    "<<utility>>",
    "<<Java Class>>",
    "<<actor>>",
    "<<stereotype>>",
)


def class_text_rows(texts: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Keeps rows of score min_score or more with a label that makes part of a class."""
    kept = texts.where((F.col("score") >= min_score) & F.col("label").isin("Stereotype", "Name", "Property"))
    return kept.withColumnRenamed("label", "text_type")


def name_fallback(rows: DataFrame) -> DataFrame:
    """In a class without a name the first row becomes the name."""
    by = Window.partitionBy(*KEY)
    named = F.max((F.col("text_type") == "Name").cast("int")).over(by)
    first = F.row_number().over(by.orderBy("pos"))
    return rows.withColumn("__named", named).withColumn("__first", first).withColumn("text_type", F.when((F.col("__named") == 0) & (F.col("__first") == 1), "Name").otherwise(F.col("text_type"))).drop("__named", "__first")


def ordered_text(text: Column, pos: Column, when: Column, sep: str = " ") -> Column:
    """An aggregate: the texts of the rows where `when` holds, in order, joined; null if there is none."""
    rows = F.array_sort(F.collect_list(F.when(when, F.struct(pos.alias("pos"), text.alias("text")))))
    return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda r: r["text"]), sep))


def join_texts(rows: DataFrame) -> DataFrame:
    """(diagram_id, class_index, name): the name's texts joined; `Unknown` for classes without any."""
    name = ordered_text(F.col("text"), F.col("pos"), F.col("text_type") == "Name")
    return rows.groupBy(*KEY).agg(F.coalesce(name, F.lit("Unknown")).alias("name"))


def pick_stereotype(rows: DataFrame) -> DataFrame:
    """(diagram_id, class_index, stereotype_text) of the stereotype row with the least score."""
    some = rows.where("text_type = 'Stereotype'")
    return some.groupBy(*KEY).agg(F.min_by("text", F.struct("score", "pos")).alias("stereotype_text"))


@lru_cache(maxsize=1 << 16)
def _most_alike(text: str) -> str | None:
    ratio, at = max((SequenceMatcher(None, text.lower(), s.lower()).ratio(), -i) for i, s in enumerate(STEREOTYPES))
    return STEREOTYPES[-at] if ratio > 0.5 else None


def stereotype_of(text: Column) -> Column:
    """The most alike of STEREOTYPES, if more than half alike; null for null. Worked out where the text is, as
    a join on it would bring all nulls to one task; a worker remembers what it has seen."""

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _most_alike(t))

    return found(text)


def match_stereotype(texts: DataFrame, column: str = "stereotype_text") -> DataFrame:
    """(column, stereotype) by stereotype_of, for each distinct text."""
    return texts.select(column).where(F.col(column).isNotNull()).distinct().withColumn("stereotype", stereotype_of(F.col(column)))


def split_members(rows: DataFrame) -> DataFrame:
    """Property rows with repaired text and whether each is a method: from the first that looks like one on,
    all are. Empty texts go."""
    some = rows.where("text_type = 'Property' AND text <> ''").withColumn("text", fix_parentheses(F.col("text")))
    upto = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return some.withColumn("is_method", F.max(is_method(F.col("text"))).over(upto))


def build_classes(texts: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """One row a class: name, stereotype, attributes and methods. One shuffle, by class."""
    rows = name_fallback(class_text_rows(texts, min_score)).withColumn("text", F.when(F.col("text_type") == "Property", fix_parentheses(F.col("text"))).otherwise(F.col("text")))
    upto = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    member = (F.col("text_type") == "Property") & (F.col("text") != "")
    rows = rows.withColumn("__member", member).withColumn("__method", F.max(F.col("__member") & is_method(F.col("text"))).over(upto))
    listed = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("pos", "text")))), lambda r: r["text"])
    classes = rows.groupBy(*KEY).agg(
        sanitize_name(F.coalesce(ordered_text(F.col("text"), F.col("pos"), F.col("text_type") == "Name"), F.lit("Unknown"))).alias("name"),
        F.min_by("text", F.when(F.col("text_type") == "Stereotype", F.struct("score", "pos"))).alias("stereotype_text"),
        listed(F.col("__member") & ~F.col("__method")).alias("attributes"),
        listed(F.col("__member") & F.col("__method")).alias("methods"),
    )
    return classes.withColumn("stereotype", stereotype_of(F.col("stereotype_text"))).drop("stereotype_text")


def label_text_rows(assigned: DataFrame, texts: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Texts of the label boxes of each assigned cluster, in its order; assigned: (diagram_id, cluster_id,
    target_id), texts: (diagram_id, cluster_id, pos, score, text)."""
    return assigned.join(texts.where(F.col("score") >= min_score), ["diagram_id", "cluster_id"]).select("diagram_id", "target_id", "pos", "score", "text")


def ocr_batches(crops: DataFrame, load: Callable[[], Callable[[pd.DataFrame], list[str]]], size: int = 5) -> DataFrame:
    """Adds text: a reader, loaded once in a worker, is given `size` crops at a time. Crops are spread over
    the partitions first, as images hold very different numbers of them."""
    source = crops.drop("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = load()
        for batch in batches:
            texts = [t for a in range(0, len(batch), size) for t in read(batch.iloc[a : a + size])]
            yield batch.assign(text=texts)

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.repartition("diagram_id", "region_id").mapInPandas(run, f"{columns}, text string")
