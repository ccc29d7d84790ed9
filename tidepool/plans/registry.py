"""Registry of the library's own queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a narrow table of which a task makes pages; fixed value.
MADE_A_TASK = 500


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a narrow table, dealt to tasks by how many there are: what is made of a row is many times as long as the
    row, so the file's size, by which Spark deals it, would leave the work of all rows to one task."""
    return rows.repartition(max(1, -(-rows.count() // MADE_A_TASK)), key)


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must return the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add
