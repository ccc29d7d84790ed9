"""Running a stream over the files that are there, to the end, with its result as a table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Where checkpoints and results go: spark.checkpoint.dir; an own folder where it's unset and Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}").rstrip("/")


def files(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files at a path, by the schema that they have now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(f"{path}*")


def drained(stream: DataFrame, mode: str = "append", newest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all there is and give its rows; newest picks the last update of each key."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{place}/rows"

    def write(batch: DataFrame, number: int) -> None:
        #: A trigger that runs again writes the same folder again.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/batch=-1")  # so that no rows make a table, too
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    return newest(rows) if newest else rows.drop("batch")
