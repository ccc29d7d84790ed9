"""The corpus pipeline: stages over documents, each with one of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import exact_dedup, mixing, near_dedup, sentence_pieces, toxicity
from tidepool.llm.common import materialize

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels of this input, doesn't reject. Null and empty
    texts stay, repeated rows are judged alike, an empty table stays empty; all columns come through."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, labels)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest id, null ids last; of rows that
    agree in id and text any one. Null texts are empty; an empty table stays empty; all columns come through."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the smallest id, null ids last, of rows that tie any one.
    Null and empty texts are one class; an empty table stays empty; all columns come through."""
    return near_dedup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix that the sources' budgets make of the documents, repeats as further rows. Documents without words
    have nothing to take, null sources are one source, an empty table stays empty; all columns come through."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix as ids of sentence pieces, with whether they give the text back. Null texts have
    no ids, repeated rows repeat, an empty table stays empty; only the id comes along."""
    return sentence_pieces.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentence_pieces", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
