"""Roll-ups and lookups: profiles of entities, merged duplicates, cache keys, rotations, subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Pages that are watched for each product by default; fixed values.
DEFAULT_PAGES = (("homepage", ""), ("pricing", "/pricing"), ("features", "/features"), ("changelog", "/changelog"))


def profile(facts: DataFrame, key: str, order: str, text: str, score: str, most: int = 6) -> DataFrame:
    """One row an entity: its first distinct values, best score, number of facts. Ranks cut an entity's values
    before they are gathered."""
    first = facts.groupBy(key, text).agg(F.min(order).alias("_at"), F.max(score).alias("_s"), F.count("*").alias("_n"))
    first = first.withColumn("_i", F.row_number().over(W.partitionBy(key).orderBy("_at", text)))
    rows = first.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_i") <= most, F.struct("_i", text)))).alias("_v"), F.max("_s").alias("best"), F.sum("_n").alias("facts"))
    return rows.select(key, F.transform("_v", lambda x: x[text]).alias("values"), "best", "facts")


def merged(rows: DataFrame, keys: list[str], order: str, evidence: str, kept: list[str]) -> DataFrame:
    """Duplicates as one row: the first one's columns, the evidence of all in order."""
    out = rows.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in kept], F.array_sort(F.collect_list(F.struct(order, evidence))).alias("_e"))
    return out.withColumn(evidence, F.transform("_e", lambda x: x[evidence])).drop("_e")


def cache_key(*parts: Column) -> Column:
    """The hash of what an answer depends on."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def rotated(rows: DataFrame, order: str, week: int, most: int) -> DataFrame:
    """The next few rows of a pool that is turned on by one each week, with their place.

    The place to begin follows from the pool's size, so two ordered limits of at most week + most rows
    give them; the pool itself isn't numbered."""
    n = rows.count()
    start = week % max(n, 1)
    head = rows.orderBy(order).offset(start).limit(most).withColumn("_turn", F.lit(0))
    tail = rows.orderBy(order).limit(max(0, min(start, start + most - n))).withColumn("_turn", F.lit(1))
    return head.unionByName(tail).withColumn("place", F.row_number().over(W.orderBy("_turn", order)).cast("int")).drop("_turn")


def default_pages(owners: DataFrame, base_col: str) -> DataFrame:
    """The default pages of each owner."""
    pages = F.array(*[F.struct(F.lit(k).alias("page_type"), F.lit(p).alias("path")) for k, p in DEFAULT_PAGES])
    rows = owners.withColumn("_p", F.explode(pages))
    return rows.withColumns({"page_type": F.col("_p.page_type"), "page_url": F.concat(F.col(base_col), F.col("_p.path"))}).drop("_p")


def failure_kind(message: Column) -> Column:
    """A message without numbers, quotes and addresses, so that like ones count together."""
    text = F.regexp_replace(F.lower(message), r"https?://\S+", "<url>")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\d+", "#"), r"[\"'].*?[\"']", "<text>"))


def subscribed_plan(status: Column, plan: Column) -> Column:
    return F.when(status.isin("active", "trialing"), plan).otherwise("free")
