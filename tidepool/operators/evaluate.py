"""Evaluation: scorecards, percentiles by nearest rank, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scorecard(rows: DataFrame, predicted: str, expected: str) -> DataFrame:
    """Cases, precision, recall and F1 of boolean columns, to three places; null where nothing is divided."""
    p, e = F.col(predicted), F.col(expected)
    both, wrong, missed = (F.count_if(x).cast("double") for x in (p & e, p & ~e, ~p & e))
    share = lambda a, b: F.round(F.try_divide(a, b), 3)
    return rows.agg(F.count("*").alias("cases"), share(both, both + wrong).alias("precision_score"), share(both, both + missed).alias("recall_score"), share(both * 2, both * 2 + wrong + missed).alias("f1"))


def nearest_rank(column: str, percent: float) -> Column:
    """The smallest value that so many percent of the values don't exceed."""
    return F.expr(f"percentile_disc({percent / 100}) within group (order by {column})")


def ships(cases: Column, passed: Column) -> Column:
    """Four in five must pass from ten cases on, all below that."""
    return F.when(cases >= 10, passed >= F.ceil(cases * 0.8)).otherwise(passed == cases)
