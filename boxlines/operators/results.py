"""Counts, evaluation rows and timings, a row a diagram or step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stages import Steps

#: Columns of an evaluation row, and those which are filled by counts.
EVALUATION_COLUMNS = 30
COUNT_COLUMNS = {1: "diagram_name", 3: "n_classes", 8: "n_relationships", 13: "n_class_texts", 20: "n_labels", 26: "n_multiplicities"}


def diagram_counts(diagrams: DataFrame, **tables: DataFrame) -> DataFrame:
    """diagram_id and n_<name> for each table, 0 where a diagram has no rows in it."""
    out = diagrams.select("diagram_id").distinct()
    for name, table in tables.items():
        out = out.join(table.groupBy("diagram_id").agg(F.count("*").alias(f"n_{name}")), "diagram_id", "left")
    return out.select("diagram_id", *(F.coalesce(f"n_{n}", F.lit(0)).cast("long").alias(f"n_{n}") for n in tables))


def evaluation_row(counts: DataFrame) -> DataFrame:
    """c1 to c30 with the counts in their columns and nulls, to be filled by hand, in the others."""
    cols = [F.col(COUNT_COLUMNS[i]).cast("string").alias(f"c{i}") if i in COUNT_COLUMNS else F.lit(None).cast("string").alias(f"c{i}") for i in range(1, EVALUATION_COLUMNS + 1)]
    return counts.select(*cols)


def step_durations(steps: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Steps in order and a Total row for each run. steps: (diagram_id, run_index, step, seconds) ordered by
    step_no; totals: measured ones, the sum of the steps standing in where one is missing."""
    key = ["diagram_id", "run_index"]
    summed = steps.groupBy(*key).agg(F.max("step_no").alias("step_no"), F.sum("seconds").alias("summed"))
    if totals is not None:
        summed = summed.join(totals.withColumnRenamed("seconds", "measured"), key, "left").withColumn("summed", F.coalesce("measured", "summed"))
    total = summed.select(*key, (F.col("step_no") + 1).cast("long").alias("step_no"), F.lit("Total").alias("step"), F.col("summed").alias("seconds"), F.lit(True).alias("is_total"))
    return steps.select(*key, F.col("step_no").cast("long").alias("step_no"), "step", "seconds", F.lit(False).alias("is_total")).unionByName(total)


def measured_steps(spark: SparkSession, runs: list[Steps]) -> DataFrame:
    """(run_index, step_no, step, seconds, n_rows, is_total) of measured runs: a row a table written, in order,
    and for each run its own time."""
    rows = [(i, k, name, seconds, n, False) for i, run in enumerate(runs) for k, (name, seconds, n) in enumerate(run.steps, 1)]
    rows += [(i, len(run.steps) + 1, "Total", run.total, None, True) for i, run in enumerate(runs)]
    return spark.createDataFrame(rows, "run_index long, step_no long, step string, seconds double, n_rows long, is_total boolean")


def numbered_steps(steps: DataFrame) -> DataFrame:
    """Adds step_no by name within each run."""
    return steps.withColumn("step_no", F.row_number().over(Window.partitionBy("diagram_id", "run_index").orderBy("step")))


def run_times(runs: DataFrame, n_runs: int = 5) -> DataFrame:
    """(diagram_id, run_0 .. run_4): the seconds of each run in a column."""
    wide = runs.groupBy("diagram_id").pivot("run_index", list(range(n_runs))).agg(F.first("seconds"))
    return wide.select("diagram_id", *(F.col(str(i)).alias(f"run_{i}") for i in range(n_runs)))
