"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, fingerprints, jaccard, katz, langid, line_dedup, line_runs, lloyd, mixing, pii, secret_scan, topk, trie

PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_50k.tiktoken"
#: Of the query alone; whoever keeps real pseudonyms brings a secret one.
PII_KEY = "key of the registered query"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_documents(spark, sf_dir).select("doc_id", "text"))


def op3_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.dedup(_documents(spark, sf_dir).select("doc_id", "text"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared_with_next(_documents(spark, sf_dir))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_documents(spark, sf_dir))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digests(_documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digests(_documents(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(_documents(spark, sf_dir))


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.digests(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_hostile(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_katz": op2_katz,
    "op3_line_dedup": op3_line_dedup,
    "op3_line_runs": op3_line_runs,
    "op4_fingerprints": op4_fingerprints,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_top_k": op6_top_k,
    "op7_language_id": op7_language_id,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_secret_scan": op10_secret_scan,
    "op11_dual_tree_lloyd": op11_dual_tree_lloyd,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_chat_format": op13_chat_format,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": line_dedup.SQL,
    "op5_ngram_jaccard": jaccard.SQL,
    "op6_top_k": topk.SQL,
    "op8_mixing": mixing.SQL,
    "op11_dual_tree_lloyd": lloyd.SQL,
    "op12_prefix_trie": trie.SQL,
    "op13_chat_format": chat.SQL,
}
