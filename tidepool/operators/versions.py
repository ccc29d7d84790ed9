"""Versioned rows: newest and previous ones, keyed differences, retention, streaks, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.operators.sinks import stored


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given; give a unique last column to break ties."""
    return top(rows, keys, order, 1).drop("rank")


def top(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their rank from 1."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def beyond(rows: DataFrame, keys: list[str], order: list[Column], keep: Column) -> DataFrame:
    """The rows that retention deletes: those behind the first `keep` of each key."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") > keep)


def with_previous(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Each row with prev_<column> of the version before it, and whether it is the first."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("is_first", F.row_number().over(w) == 1)
    return rows.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def with_neighbour(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Rows with the `order` value before theirs in their key, null for the first; orders are unique in a key.

    Rows are dealt to ranges of (key, order), so a key with a third of the rows is spread like any other; the last row of
    each range, one for each range in all, is broadcast to those that begin the next."""
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(ranges, key, order).withColumn("_range", F.spark_partition_id()), "neighbours")
    last = dealt.groupBy("_range").agg(F.max_by(F.struct(F.col(key).alias("k"), F.col(order).alias("o")), F.struct(key, order)).alias("_last"))
    edges = last.select("_range", F.lag("_last").over(W.orderBy("_range")).alias("_edge"))  # one row a range
    inside = F.lag(order).over(W.partitionBy(key, "_range").orderBy(order))
    dealt = dealt.withColumn("_own", inside).join(F.broadcast(edges), "_range", "left")
    edge = F.when(F.col("_edge.k").eqNullSafe(F.col(key)), F.col("_edge.o"))
    return dealt.select(*rows.columns, F.coalesce("_own", edge).alias(name))


#: Groups that hold more than this part of the rows are hot; there are no more of them than its inverse.
HOT = 0.001


def attached(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Rows with the columns of their group, as an inner join; groups: one row a key with its number of rows.

    Groups that hold more than a thousandth of all rows are at most a thousand, so those are broadcast and their rows
    stay where they are; the others join by a shuffle in which no key is large. Null keys meet nothing."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) > total * HOT)
    cold = groups.filter(F.col(size) <= total * HOT)
    some = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(some.join(cold, key))


def changed(columns: list[str]) -> Column:
    """Whether any of the columns differs from the version before; nulls are equal."""
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(c).eqNullSafe(F.col(f"prev_{c}"))
    return out


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """added, removed, changed or same for every key of two versions, with old_ and new_ values."""
    a = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("_old"))
    b = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("_new"))
    rows = a.join(b, keys, "full_outer")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(differs, "changed").otherwise("same")
    return rows.withColumn("change", kind).drop("_old", "_new")


def streak(rows: DataFrame, keys: list[str], order: list[Column], failed: Column, name: str = "streak") -> DataFrame:
    """Failures in a row up to each row; a success sets it to 0."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_island", F.sum(F.when(failed, 0).otherwise(1)).over(w))
    inside = W.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(failed, 1).otherwise(0)).over(inside)).drop("_island")


def upserted(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """What a table holds after rows have been upserted in turn: the last one of each key."""
    return latest(rows, keys, order)


def last_value_first_place(rows: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """One row a key: the last value at the first place."""
    return rows.groupBy(*keys).agg(F.max_by(value, place).alias(value), F.min(place).alias(place))


def not_active(new: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    """New jobs whose keys no active job has, the first of each."""
    return new.join(active.select(*keys).distinct(), keys, "left_anti")


def visible_to(rows: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that belong to one of the owners."""
    return rows.join(owners.select(*keys), keys, "left_semi")
