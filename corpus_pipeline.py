"""The corpus pipeline: five text operators in turn, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlines.llm import bpe, jaccard, langid, line_runs, mixing
from boxlines.llm.common import stored
from boxlines.llm.queries import PIECES, RANKS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Posterior below which no language is believed.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones among them) and those of which no language is half
    believed; `lang` becomes the predicted language. Rows that share an id, or have none, are rows of their
    own; an empty table stays one."""
    found = langid.identify(docs, public_tokenizers.path(PIECES)).where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes chunks of lines, and runs of lines of 50 words, that stand elsewhere already; texts of which
    nothing is left go. Null texts go, texts without a repeated line stay as they are, empty ones too."""
    found = line_runs.dedup(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    # a filter on the text would be pushed below, and there put the text together a second time, inlined
    held = found.withColumn("__left", F.when(left, F.array("text")).otherwise(F.array().cast("array<string>")))
    held = held.select(*(c for c in COLUMNS if c not in ("text", "n_chars")), F.explode_outer("__left").alias("text")).where("text IS NOT NULL")
    return held.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, and all rows without id; of rows that share an id,
    every different text; null and empty texts are like no other. An empty table stays one."""
    return jaccard.keep_one(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks; those without a word as often as others of
    their source, a null source being one like others. An empty table stays one."""
    return mixing.mix(docs).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts, a row each; `ids` are little-endian unsigned 32-bit integers, none for a null or
    empty text. An empty table stays one."""
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_chunks),
    ("ngram_jaccard_join", near_copies),
    ("mixing", mixture),
    ("byte_bpe", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each but the last written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
