"""Where results go: appended rows, merged batches, updated counters, snapshots with their changes, reports as JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidepool.streaming.runs import shared_folder


def new_table(spark, name: str) -> str:
    """The path of a table of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows written once to a table of their own and read again."""
    path = new_table(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def append(rows: DataFrame, path: str) -> DataFrame:
    """Add rows to a table and give the whole table."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def known(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A table, empty where nothing has been written."""
    return spark.read.schema(schema).parquet(path) if there(spark, path) else spark.createDataFrame([], schema)


def merge(rows: DataFrame, path: str, keys: list[str], order: list[Column], batch: int, update: list[str] | None = None, folders: int = 16) -> DataFrame:
    """Upsert a batch into a table in `folders` folders by a hash of the keys, and give the table with `batch`, the
    number of the batch that wrote each row last.

    Of rows of a batch that share their keys the first by `order` counts; rows with a null key have no place in a
    table with a primary key and are left out. Rows whose keys are there already take over the columns of `update`
    (all by default) and keep the others. Only folders with touched keys are read and written again.

    A batch that was merged is left alone, so writing it again changes nothing. What a batch makes of its folders is
    written beside the table before they are replaced; a batch that is written again after a failure replaces them by
    the same rows, whatever the failure left of them.
    """
    spark = rows.sparkSession
    values = [c for c in rows.columns if c not in keys]
    update = values if update is None else update
    schema = StructType([*rows.schema.fields, StructField("batch", LongType()), StructField("_folder", IntegerType())])
    schema = StructType([StructField(f.name, f.dataType) for f in schema])
    log, beside = f"{path}-merged", f"{path}-staged/batch={batch}"
    if known(spark, log, "batch bigint").filter(F.col("batch") == batch).isEmpty():
        if not there(spark, f"{beside}/_SUCCESS"):
            folder = F.pmod(F.xxhash64(*keys), F.lit(folders)).cast("int")
            new = rows.dropna(subset=keys).withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1")
            new = stored(new.select(*rows.columns, F.lit(batch).cast("long").alias("batch"), folder.alias("_folder")), "merge-batch")
            touched = [r[0] for r in new.select("_folder").distinct().collect()]  # at most as many as there are folders
            old = known(spark, path, schema).filter(F.col("_folder").isin(touched))
            both = old.select(*keys, "_folder", F.struct(*values, "batch").alias("_old")).join(new.select(*keys, "_folder", F.struct(*values, "batch").alias("_new")), [*keys, "_folder"], "full_outer")
            pick = lambda c: F.when(F.col("_new").isNull(), F.col(f"_old.{c}")).when(F.col("_old").isNull() | F.lit(c in update), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)
            last = F.coalesce("_new.batch", "_old.batch").alias("batch")
            both.select(*keys, *map(pick, values), last, "_folder").repartition("_folder").write.mode("overwrite").parquet(beside)
        staged = spark.read.schema(schema).parquet(beside)
        staged.select(*rows.columns, "batch", "_folder").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("_folder").parquet(path)
        spark.createDataFrame([(batch,)], "batch bigint").coalesce(1).write.mode("append").parquet(log)
    return known(spark, path, schema).select(*rows.columns, "batch")


def counters(rows: DataFrame, keys: list[str], order: list[Column], ok: Column, at: Column) -> DataFrame:
    """For each key what updating it at every outcome leaves: failures since the last success, last success,
    last failure. Aggregates only, so a key with any number of outcomes is combined before it is shuffled."""
    place, some = F.struct(*order), F.col("_ok")
    rows = rows.select(*keys, place.alias("_place"), ok.alias("_ok"), at.alias("_at"))
    last = rows.groupBy(*keys).agg(F.max(F.when(some, F.col("_place"))).alias("_last"), F.max_by(F.when(some, F.col("_at")), F.when(some, F.col("_place"))).alias("last_success"), F.max_by(F.when(~some, F.col("_at")), F.when(~some, F.col("_place"))).alias("last_failure"))
    behind = rows.filter("not _ok").join(last.select(*keys, "_last"), keys).filter("_last is null or _place > _last").groupBy(*keys).agg(F.count("*").alias("failures"))
    return last.join(behind, keys, "left").select(*keys, F.coalesce("failures", F.lit(0)).alias("failures"), "last_success", "last_failure")


def snapshots(facts: DataFrame, key: str, order: list[Column], value: Column, warning: Column, most: int = 60) -> DataFrame:
    """One row an entity: how many facts, the first `most` of them in order, distinct warnings in order.

    Ranks cut each entity's list before it is gathered, so what is gathered is bounded."""
    rows = facts.select(key, F.row_number().over(W.partitionBy(key).orderBy(*order)).alias("_n"), value.alias("_v"), warning.alias("_w"))
    warned = rows.filter("_w is not null").groupBy(key, "_w").agg(F.min("_n").alias("_n")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", "_w"))).alias("_ws"))
    listed = F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", "_v"))))
    out = rows.groupBy(key).agg(F.count("*").alias("facts"), listed.alias("_vs")).join(warned, key, "left")
    return out.select(key, "facts", F.transform("_vs", lambda x: x["_v"]).alias("listed"), F.transform(F.coalesce("_ws", F.array().cast("array<struct<_n:int,_w:string>>")), lambda x: x["_w"]).alias("warnings"))


def exported(rows: DataFrame, path: str) -> DataFrame:
    """Write rows as JSON lines and read them again by the same schema."""
    rows.write.mode("errorifexists").json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)
