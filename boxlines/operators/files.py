"""Image files, resuming, evaluation sheets and text output."""

from __future__ import annotations

import uuid

from pyarrow.fs import FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key
from .stages import written

_PICTURES = "*.{png,jpg,jpeg}"

#: Bytes that opening a picture counts as when pictures are dealt to tasks. By Spark's own 4 MB a task has 32 small
#: pictures, and starting it takes longer than reading them.
OPEN_BYTES = 64 << 10


def _pictures(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The folder's pictures and those below it; bounds what its session counts for opening a file."""
    spark.conf.set("spark.sql.files.openCostInBytes", str(OPEN_BYTES))
    return spark.read.format(kind).option("pathGlobFilter", _PICTURES).option("recursiveFileLookup", "true").load(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, stem, image) of the pictures in the folder and below it, decoded to rasters."""
    images = _pictures(spark, "image", path)
    name = F.regexp_extract(F.col("image.origin"), r"([^/]+)$", 1)
    return images.select(name.alias("file_name"), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1).alias("stem"), "image")


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, stem) of the pictures in the folder and below it, which are not read."""
    found = _pictures(spark, "binaryFile", path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return found.select(name.alias("file_name"), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1).alias("stem"))


def natural_order(files: DataFrame, column: str = "file_name") -> DataFrame:
    """Adds position (from 1) in natural order. Rows are dealt by range of the key and numbered in each
    range; a range's first number comes from the sizes of those before it."""
    keyed = files.withColumn("__key", natural_key(F.col(column)))
    order = ["__key", column]
    # written once: both branches below must see the same ranges
    ranged = written(keyed.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged").withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    before = ranged.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(before), "__part").withColumn("position", (F.col("__at") + F.col("__before")).cast("long")).drop("__key", "__part", "__at", "__before")


def skip_processed(todo: DataFrame, done: DataFrame, key: str = "stem") -> DataFrame:
    """What has no output yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def skip_first(files: DataFrame, n: int = 8, column: str = "file_name") -> DataFrame:
    """All but the first n in natural order."""
    return natural_order(files, column).where(F.col("position") > n)


_RUNS = "run string, number long, whole boolean"


def _runs(spark: SparkSession, path: str) -> list[Row]:
    """The runs that count, oldest first: those that ended, from the last one that holds all texts on."""
    try:
        ended = spark.read.schema(_RUNS).parquet(f"{path}/runs").orderBy("number", "run").collect()  # a row a run
    except AnalysisException:  # the first run
        return []
    whole = [i for i, r in enumerate(ended) if r.whole]
    return ended[whole[-1] :] if whole else ended


def _write_run(rows: DataFrame, path: str, whole: bool) -> str:
    """Rows (diagram, plantuml) as a run of its own. What makes it count is one row, written when it ended."""
    spark, run = rows.sparkSession, uuid.uuid4().hex
    before = _runs(spark, path)
    rows.write.parquet(f"{path}/rows/run={run}")
    ended = spark.createDataFrame([(run, before[-1].number + 1 if before else 0, whole)], _RUNS).coalesce(1)
    ended.write.mode("append").parquet(f"{path}/runs")
    return run


def write_plantuml(diagrams: DataFrame, path: str, name: str = "diagram_id") -> None:
    """The texts (name, plantuml) as a further run of the table at path: what is written follows this run's
    rows, whatever the table holds. A run that fails doesn't count; see read_plantuml."""
    _write_run(diagrams.select(F.col(name).cast("string").alias("diagram"), "plantuml"), path, whole=False)


def read_plantuml(spark: SparkSession, path: str) -> DataFrame:
    """(diagram, plantuml) of the table at path: each diagram's text from the newest run that has it; of
    several in one run, the greatest."""
    runs = _runs(spark, path)
    if not runs:
        return spark.createDataFrame([], "diagram string, plantuml string")
    schema = "diagram string, plantuml string, run string"
    rows = spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/run={r.run}" for r in runs))
    place = F.create_map(*(F.lit(x) for k, r in enumerate(runs) for x in (r.run, k)))
    return rows.groupBy("diagram").agg(F.max(F.struct(place[F.col("run")].alias("at"), "plantuml")).alias("newest")).select("diagram", "newest.plantuml")


def compact_plantuml(spark: SparkSession, path: str, drop: bool = True) -> None:
    """Brings the runs together into one that holds all texts; `drop` removes what it takes the place of, which
    readers that began earlier may still need."""
    before = _runs(spark, path)
    if len(before) < 2:
        return
    run = _write_run(read_plantuml(spark, path), path, whole=True)
    if drop:
        files, top = FileSystem.from_uri(path)
        for r in before:
            if r.run != run:
                files.delete_dir(f"{top}/rows/run={r.run}")


def write_eval_rows(sheet: DataFrame, updates: DataFrame, check_name: bool = True, overwrite: bool = False) -> DataFrame:
    """The sheet (row_key, name, values ...) with the values that updates have. A row whose name differs, or,
    with the check off, whose cell is taken, fails the job; null values leave cells alone."""
    values = [c for c in updates.columns if c not in ("row_key", "name")]
    new = updates.select("row_key", F.col("name").alias("__name"), *(F.col(c).alias(f"__{c}") for c in values))
    joined = sheet.join(new, "row_key", "left")
    hit = F.col("__name").isNotNull()
    if check_name:
        wrong = hit & ~F.col("name").eqNullSafe(F.col("__name"))
    else:
        taken = F.lit(False)
        for c in values:
            taken = taken | (F.col(c).isNotNull() & F.col(f"__{c}").isNotNull())
        wrong = hit & taken & ~F.lit(overwrite)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("row "), F.col("row_key").cast("string"), F.lit(" is not free for "), F.col("__name"))).cast("string")).otherwise(F.col("name"))
    return joined.select(*(checked.alias("name") if c == "name" else F.coalesce(f"__{c}", c).alias(c) if c in values else F.col(c) for c in sheet.columns))
