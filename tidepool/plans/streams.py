"""Queries that run the streaming forms over the tables and must give what the batch forms give."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import versions
from tidepool.plans.registry import query
from tidepool.plans.reports import CACHED
from tidepool.streaming import live, runs


@query(
    "with v as (select o_custkey as page_id, o_orderkey as snapshot_id, o_orderstatus as s, lag(o_orderkey) over w as prev_snapshot_id, lag(o_orderstatus) over w as p from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)) "
    "select page_id, snapshot_id, prev_snapshot_id, case when p is null then 'first' when s = p then 'same' else 'changed' end as change from v"
)
def stream_version_changes(spark, sf_dir):
    """Snapshots compared with the last one of their page, kept as state."""
    orders = runs.files(spark, f"{sf_dir}/orders.parquet")
    return runs.drained(live.version_changes(orders, "o_custkey", "o_orderkey", "o_orderdate", F.col("o_orderstatus")))


@query(
    "with w as (select event_type, unnest(range(date_trunc('hour', ts) - interval 23 hours, date_trunc('hour', ts) + interval 1 hour, interval 1 hour)) as window_start, value from events) "
    "select event_type, window_start, count(*) as events, round(sum(value), 2) as total from w group by 1, 2"
)
def stream_usage_windows(spark, sf_dir):
    """Events by type in sliding days."""
    events = runs.files(spark, f"{sf_dir}/events.parquet")
    newest = lambda rows: versions.latest(rows, ["window_start", "event_type"], [F.desc("batch")])
    rows = runs.drained(live.usage_windows(events), "update", newest)
    return rows.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "events", F.round("total", 2).alias("total"))


@query(
    "with e as (select *, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from events), "
    "s as (select user_id, island, count(*) filter (where event_type = 'error') as streak from e group by 1, 2) select user_id, max(streak) as longest, max_by(streak, island) as current from s group by 1"
)
def stream_failure_streaks(spark, sf_dir):
    """Errors in a row of each user, kept as state."""
    events = runs.files(spark, f"{sf_dir}/events.parquet")
    newest = lambda rows: versions.latest(rows, ["key"], [F.desc("batch")])
    rows = runs.drained(live.failure_streaks(events, "user_id", "event_id", "ts", F.col("event_type") == "error"), "update", newest)
    return rows.select(F.col("key").alias("user_id"), "longest", "current")


@query("select date_trunc('week', o_orderdate) as week, o_orderpriority as kind, count(*) as changes from orders group by 1, 2")
def stream_weekly_digest(spark, sf_dir):
    """Changes by kind in weeks from Monday."""
    orders = runs.files(spark, f"{sf_dir}/orders.parquet").withColumnRenamed("o_orderpriority", "kind")
    newest = lambda rows: versions.latest(rows, ["week", "kind"], [F.desc("batch")])
    rows = runs.drained(live.weekly_digest(orders, "o_orderdate", ("kind",)), "update", newest)
    return rows.select(F.col("week").cast("timestamp_ntz").alias("week"), "kind", "changes")


@query(CACHED)
def stream_cached_fetches(spark, sf_dir):
    """Whether each fetch finds an answer younger than six hours, with when it was fetched kept as state."""
    events = runs.files(spark, f"{sf_dir}/events.parquet")
    return runs.drained(live.cache_hits(events, ["user_id", "event_type"], "event_id", "ts", 6 * 3600 * 1_000_000))


@query("select distinct user_id, event_type, date_trunc('day', ts) as day from events")
def stream_new_jobs(spark, sf_dir):
    """One job for each user, kind and day, however often it is asked for within the watermark."""
    events = runs.files(spark, f"{sf_dir}/events.parquet").withColumn("day", F.date_trunc("day", "ts"))
    return runs.drained(live.new_jobs(events, ["user_id", "event_type", "day"], "ts", "1 day")).select("user_id", "event_type", F.col("day").cast("timestamp_ntz").alias("day"))
