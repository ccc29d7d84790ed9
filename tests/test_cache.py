"""A cache whose answers aren't renewed by hits, in batches and as a stream."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidepool.operators import cache
from tidepool.streaming import live, runs

START, HOUR = dt.datetime(2024, 1, 1), 3_600_000_000
SCHEMA = "event_id bigint, site string, ts timestamp, cached int"


def brute(rows, ttl):
    fetched, out = {}, {}
    for i, site, ts, _ in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        hit = site in fetched and ts - fetched[site] < ttl
        fetched[site] = fetched[site] if hit else ts
        out[i] = hit
    return out | {r[0]: False for r in rows if r[2] is None}


def test_hits_do_not_renew(spark):
    rows = [(k, "a", START + dt.timedelta(hours=h), 0) for k, h in enumerate((0, 5, 10, 16, 21.9, 22))]
    found = {r.event_id: r.cached for r in cache.ttl_hits(spark.createDataFrame(rows, "event_id bigint, site string, ts timestamp, x int"), ["site"], "ts", "event_id", "6 HOURS").collect()}
    assert found == {0: False, 1: True, 2: False, 3: False, 4: True, 5: False}


def logs():
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "a", "b", "c", None]), START + dt.timedelta(minutes=rng.randrange(0, 60 * 24 * 30, 7)), 0) for k in range(1500)]
    rows += [(2000 + k, "hot", START + dt.timedelta(minutes=k), 0) for k in range(2500)]
    rows += [(9000 + k, "far", START + dt.timedelta(days=40 * k, hours=k), 0) for k in range(5)] + [(9990, "a", None, 0), (9991, "a", START, 0), (9992, "a", START, 0)]
    return rows


def test_matches_a_fold(spark):
    rows = logs()
    found = {r.event_id: r.cached for r in cache.ttl_hits(spark.createDataFrame(rows, "event_id bigint, site string, ts timestamp, x int"), ["site"], "ts", "event_id", "6 HOURS").collect()}
    assert found == brute(rows, dt.timedelta(hours=6))
    empty = cache.ttl_hits(spark.createDataFrame([], "event_id bigint, site string, ts timestamp"), ["site"], "ts", "event_id", "6 HOURS")
    assert empty.collect() == [] and empty.columns == ["event_id", "site", "ts", "cached"]


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted((r for r in logs() if r[2] is not None), key=lambda r: (r[2], r[0]))
    for k in range(4):
        spark.createDataFrame(rows[k * 1000 : (k + 1) * 1000 if k < 3 else None], "event_id bigint, site string, ts timestamp, x int").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = live.cache_hits(runs.files(spark, f"file://{tmp_path}/in", 1), ["site"], "event_id", "ts", 6 * HOUR)
    assert {r.event_id: r.cached for r in runs.drained(stream).collect()} == brute(rows, dt.timedelta(hours=6))


def test_one_job_a_key(spark, tmp_path):
    spark.createDataFrame([(k, "a" if k % 2 else "b", START + dt.timedelta(minutes=k)) for k in range(20)], "id int, kind string, at timestamp").write.parquet(f"file://{tmp_path}/jobs")
    found = runs.drained(live.new_jobs(runs.files(spark, f"file://{tmp_path}/jobs"), ["kind"], "at")).select(F.col("kind")).collect()
    assert sorted(r.kind for r in found) == ["a", "b"]
