"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import context_mixing, exact_dedup, mixing, near_dedup, nearest, personal, prefix_trie, secrets, sentence_pieces, suffix_dedup, toxicity, warc, whitening
from tidepool.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated 50-byte passages removed, as counts and the hash of what is left. Null texts are empty, rows repeat as they are, an empty table gives none."""
    return suffix_dedup.digest(suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text, base ones as counts and a digest, with all spans. Null texts are empty, rows repeat as they are, an empty table gives none."""
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back. Null markup is empty; of equal payloads the smallest page_id is the response; an empty table gives none."""
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every text. Null texts are empty, null ids hash as empty, rows repeat as they are, an empty table gives none."""
    return context_mixing.score_texts(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from the labels. Null texts are empty, null ids are held out, rows repeat as they are, an empty table gives none."""
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as ids of pieces, and whether they give it back. Null texts are empty, rows repeat as they are, an empty table gives none."""
    return sentence_pieces.round_trip(_table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. Null texts have no words, null sources are one source, ties follow id, size and text hash, an empty table gives none."""
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts. Null texts are empty, null ids come last, of rows that agree in all one stays, an empty table gives none."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near duplicates. Null and empty texts are one class, null ids come last, of tied rows one stays, an empty table gives none."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every twentieth one. Null, zero and non-finite vectors take no part, ties go to the smaller id, an empty table gives none."""
    return nearest.nearest(_table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first four components of the distinct vectors' exact covariance, whitened. Null, empty and non-finite vectors take no part, repeated rows repeat, an empty table gives none."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text, base spans as counts and a digest, with all spans. Null texts are empty, rows repeat as they are, an empty table gives none."""
    return personal.digest(personal.find_personal(_table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations. Null turns come first, ties follow a digest of role and text, null roles and texts are empty, null ids take no part, an empty table gives none."""
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_secret_scan, op3_warc, op4_context_mixing, op5_toxicity, op6_sentence_pieces, op7_source_mixing, op8_exact_dedup, op9_near_dedup, op10_nearest, op11_whitening, op12_personal, op13_prefix_trie)}
