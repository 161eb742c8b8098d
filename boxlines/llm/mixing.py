"""Mixing sources to target weights, with DataFrame functions alone.

Words are counted per document and summed per source. Sources in code point order, null last, take the
weights in turn; targets share all words by weight, stop at `cap` times a source's words, and what is over
is shared anew until none is above. A document's rate is its source's target over its words: it is emitted
floor(rate) times, plus once more where a draw seeded by its id falls below the fraction.

Edge cases: a null text has size 0; a null source is a source of its own; sources without words have target
0 and their documents are not taken; rows with equal ids draw alike, rows with a null id draw by their text;
an empty table gives an empty table; `plan` replaces columns of the input that clash with computed ones,
`mix` returns all columns as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, quoted, renamed, salted, spread, stored

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def size_of(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of md5 over seed and id."""
    name = F.coalesce(doc_id.cast("string"), text.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(key, source, source_size long, n_docs long, target double), a row a source, from (source, size)."""
    sums = sized.groupBy(_key(F.col("source")).alias("key"), F.col("source").cast("string").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # numbered by range: a partition's own numbers, and the rows of the partitions before it
    order = [F.col("source").isNull(), F.col("source")]
    ranged = stored(sums.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    before = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("before")
    turns = F.array(*map(F.lit, weights))
    weighed = stored(
        ranged.join(F.broadcast(before), "part").select("key", "source", "source_size", "n_docs", F.element_at(turns, (F.pmod(at, F.lit(len(weights))) + 1).cast("int")).cast("long").alias("weight"), (F.col("source_size") * cap).alias("most")),
        "weighed",
    )
    level, stopped = 0.0, -1
    while True:  # a scalar a round; each round stops more sources at their cap, or is the last
        above = F.col("most") < F.col("weight") * F.lit(level)
        row = weighed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("open"),
            F.count(F.when(above, 1)).alias("n"),
        ).first()
        if row.n == stopped or not row.open:
            break
        stopped, level = row.n, float(row.total - row.capped) / float(row.open)
    share = F.col("weight") * F.lit(level)
    return weighed.select("key", "source", "source_size", "n_docs", F.when(share > F.col("most"), F.col("most").cast("double")).otherwise(share).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The rows of docs (doc_id, source, text, ...) with size, source_size, target and copies."""
    kept, columns = renamed(docs, ("doc_id", "source", "text"), ("size", "source_size", "target", "copies"))
    sized = kept.withColumn("size", size_of(F.col("text"))).withColumn("__draw", draw(F.col("doc_id"), F.col("text"), seed))
    targets = source_targets(sized.select("source", "size"), weights, cap)
    targets = stored(targets.select(F.col("key").alias("__key"), F.xxhash64("key").alias("__hash"), "source_size", "n_docs", "target"), "targets")
    # where the targets cannot be broadcast, the documents of a hot source are dealt to parts
    hot = hot_keys(stored(targets.groupBy("__hash").agg(F.sum("n_docs").alias("n")), "source_rows"), "__hash")
    keyed = sized.withColumn("__key", _key(F.col("source"))).withColumn("__hash", F.xxhash64("__key"))
    keyed = salted(keyed, hot, ["__hash"], ["doc_id", "size"])
    # stored, so that its size is known and no text moves where it is small
    parts = stored(spread(targets.drop("n_docs"), hot, ["__hash"]), "parts")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(F.col("__draw") < rate - F.floor(rate), 1).otherwise(0)
    return keyed.join(parts, ["__hash", "__key", "__salt"]).withColumn("copies", copies.cast("long")).select(*columns, "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs."""
    rows = docs.select("doc_id", "source", "text", F.struct(*quoted(docs.columns)).alias("__row"))
    planned = plan(rows, weights, cap, seed).where("copies > 0")
    return planned.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__row.*")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken, a row a document."""
    return plan(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM s),
r AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
             sum(source_size) OVER () AS total FROM w),
l AS (SELECT max(CAST(total - capped AS DOUBLE) / CAST(open AS DOUBLE)) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN weight * level > most THEN CAST(most AS DOUBLE) ELSE weight * level END AS target FROM w, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
             CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), d.text, '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p
"""
