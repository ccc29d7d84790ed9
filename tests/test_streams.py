"""Keyed comparisons of streams: how many groups hold the state, and what late, equal and nameless rows give."""

import datetime as dt

from pyspark.sql import functions as F

from tidepool.streaming import live, runs

START = dt.datetime(2024, 1, 1)


def write(spark, path, *triggers):
    for rows in triggers:
        spark.createDataFrame(rows, "page bigint, id bigint, at timestamp, content string").coalesce(1).write.mode("append").parquet(f"file://{path}")


def test_many_keys_share_groups_of_state(spark, tmp_path):
    """A group for each key costs milliseconds of overhead whatever it holds."""
    write(spark, tmp_path / "in", [(p, p, START, "x") for p in range(5000)])
    of = lambda: runs.files(spark, f"file://{tmp_path}/in")
    streams = live.version_changes(of(), "page", "id", "at", F.col("content")), live.failure_streaks(of(), "page", "id", "at", F.lit(True)), live.cache_hits(of(), ["page"], "id", "at", 1)
    for k, stream in enumerate(streams):
        query = stream.writeStream.format("noop").outputMode("update" if k == 1 else "append").option("checkpointLocation", f"file://{tmp_path}/state{k}").trigger(availableNow=True).start()
        query.awaitTermination()
        assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= live.GROUPS


def test_late_equal_and_nameless_rows(spark, tmp_path):
    at, big = (lambda h: START + dt.timedelta(hours=h)), (1 << 60) + 1
    write(
        spark, tmp_path / "in", [(0, 1, at(1), "a"), (None, big, at(1), "a"), (big, 3, at(1), None), (7, 1, None, "a")],
        [(0, 2, at(0), "b"), (0, 1, at(1), "b"), (0, big, at(2), "a"), (0, big, at(2), "a"), (None, big + 2, at(2), "b"), (big, 4, at(1), "c"), (big, 5, at(2), "c"), (7, 2, at(1), "b")],
    )
    rows = runs.drained(live.version_changes(runs.files(spark, f"file://{tmp_path}/in", 1), "page", "id", "at", F.col("content"))).collect()
    assert {(r.page_id, r.snapshot_id, r.prev_snapshot_id, r.change) for r in rows} == {
        (0, 1, None, "first"), (None, big, None, "first"), (big, 3, None, "first"), (7, 1, None, "first"), (0, big, 1, "same"), (None, big + 2, big, "changed"), (big, 4, 3, "first"), (big, 5, 4, "same"), (7, 2, 1, "changed"),
    } and len(rows) == 9


def test_streaks_over_triggers(spark, tmp_path):
    at = lambda h: START + dt.timedelta(hours=h)
    write(spark, tmp_path / "in", [(1, k, at(k), "bad" if k else "ok") for k in range(4)] + [(None, 9, at(0), "bad")], [(1, 4, at(4), "bad"), (1, 5, at(5), None), (2, 6, at(6), "bad")])
    rows = runs.drained(live.failure_streaks(runs.files(spark, f"file://{tmp_path}/in", 1), "page", "id", "at", F.col("content") == "bad"), "update", lambda found: found).collect()
    assert {(r.batch, r.key, r.current, r.longest) for r in rows} == {(0, 1, 3, 3), (0, None, 1, 1), (1, 1, 0, 4), (1, 2, 1, 1)}
