"""All queries of the library, without those of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.plans import analysis, changes, comparisons, content, discovery, extraction, pagechecks, priced, reports, rollups, streams, usage, versions, web  # noqa: F401  they register their queries
from tidepool.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by canonical URL with their site, type, title and number of duplicates."""
    return web.url_duplicate_groups(spark, sf_dir)
