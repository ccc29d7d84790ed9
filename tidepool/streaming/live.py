"""Structured Streaming forms: versions compared as they come, usage windows, failure streaks, job keys.

Rows later than the watermark are left out of windows and keys; keyed comparisons take rows of a
trigger in the order of time and id, so a version that comes in a later trigger with an earlier time
counts as late and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def usage_windows(events: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("event_type",), length: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events in sliding windows by key, behind a watermark."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rows = rows.groupBy(F.window(ts, length, slide), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "events", "total")


def weekly_digest(changes: DataFrame, ts: str, keys: tuple[str, ...], late: str = "1 day") -> DataFrame:
    """Changes of each key in weeks that begin on Monday."""
    rows = changes.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rows = rows.groupBy(F.window(ts, "7 days", startTime="4 days"), *keys).agg(F.count("*").alias("changes"))
    return rows.select(F.col("window.start").alias("week"), *keys, "changes")


def new_jobs(jobs: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first job of each key inside the watermark."""
    return jobs.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


#: Keys whose state is kept and read together: a group for each single key costs milliseconds of overhead, whatever it
#: holds. Rows, state and work of a group are its share of a trigger; fixed values. Times that are null come last.
GROUPS, NO_TIME = 2048, (1 << 63) - 1


def _grouped(rows: DataFrame, key: str):
    """Rows dealt to groups of keys; a key is always in the same one."""
    return rows.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int")).groupBy("_group")


def _time(at: str) -> Column:
    return F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(NO_TIME))


def _named(key: str) -> list[Column]:
    """A key as a number that is never null, so that none is read as a float, and whether it is there."""
    key = F.col(key).cast("long")
    return [key.isNotNull().alias("named"), F.coalesce(key, F.lit(0)).alias("key")]


def _keys(named: np.ndarray, keys: np.ndarray) -> pd.Series:
    return pd.Series(keys, dtype="Int64").where(pd.Series(named, dtype=bool))


def _compare(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).assign(fresh=True)
    if state.exists:
        kept = pd.DataFrame(dict(zip(("named", "key", "at", "id", "hash"), state.get)))
        rows = pd.concat([kept.astype({"named": bool, "key": "int64", "at": "int64", "id": "int64", "hash": object}).assign(fresh=False), rows])
    rows = rows.sort_values(["named", "key", "fresh", "at", "id"], kind="stable")
    named, keys, fresh, at, ids, hashes = (rows[c].to_numpy() for c in ("named", "key", "fresh", "at", "id", "hash"))

    def starts() -> np.ndarray:
        return np.r_[True, (keys[1:] != keys[:-1]) | (named[1:] != named[:-1])]

    begins = starts()
    first = np.flatnonzero(begins)[np.cumsum(begins) - 1]
    #: Late ones are not after the key's last one; a last one without a time makes late only what has none either.
    late = fresh & ~fresh[first] & ((at < at[first]) | ((at == at[first]) & (ids <= ids[first]))) & ((at[first] != NO_TIME) | (at == NO_TIME))
    again = np.r_[False, ~begins[1:] & fresh[:-1] & (at[1:] == at[:-1]) & (ids[1:] == ids[:-1])]
    named, keys, fresh, at, ids, hashes = (x[~late & ~again] for x in (named, keys, fresh, at, ids, hashes))
    begins = starts()
    before = np.r_[None, hashes[:-1]]
    none = begins | pd.isna(before)
    change = np.where(none, "first", np.where(hashes == before, "same", "changed"))
    last = np.r_[begins[1:], True]
    state.update(tuple(x[last].tolist() for x in (named, keys, at, ids, hashes)))
    previous = pd.Series(np.r_[0, ids[:-1]], dtype="Int64").where(pd.Series(~begins))
    out = pd.DataFrame({"page_id": _keys(named, keys), "snapshot_id": ids, "prev_snapshot_id": previous, "change": change})
    yield out[fresh]


def version_changes(snapshots: DataFrame, page: str, snapshot: str, at: str, content: Column) -> DataFrame:
    """Each snapshot against the page's last one, which is kept as keyed state: first, same or changed."""
    rows = snapshots.select(*_named(page), F.col(snapshot).cast("long").alias("id"), _time(at).alias("at"), F.md5(content).alias("hash"))
    return _grouped(rows, "key").applyInPandasWithState(
        _compare, "page_id long, snapshot_id long, prev_snapshot_id long, change string", "named array<boolean>, key array<long>, at array<long>, id array<long>, hash array<string>", "append", GroupStateTimeout.NoTimeout
    )


def _streaks(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = {(named, key): (run, longest) for named, key, run, longest in zip(*state.get)} if state.exists else {}
    rows = pd.concat(list(frames)).sort_values(["at", "id"])
    touched = {}
    for named, key, failed in zip(rows["named"].tolist(), rows["key"].tolist(), rows["failed"].tolist()):
        run, longest = known.get((named, key), (0, 0))
        run = run + 1 if failed else 0
        known[named, key] = touched[named, key] = run, max(longest, run)
    state.update(tuple(map(list, zip(*((*key, *of) for key, of in known.items())))))
    named, keys = map(np.array, zip(*touched))
    current, longest = zip(*touched.values())
    yield pd.DataFrame({"key": _keys(named, keys), "current": current, "longest": longest})


def failure_streaks(events: DataFrame, key: str, event: str, at: str, failed: Column) -> DataFrame:
    """Failures in a row of each key, now and at most, updated at each trigger; a success sets them to 0."""
    rows = events.select(*_named(key), F.col(event).cast("long").alias("id"), _time(at).alias("at"), F.coalesce(failed, F.lit(False)).alias("failed"))
    return _grouped(rows, "key").applyInPandasWithState(
        _streaks, "key long, current long, longest long", "named array<boolean>, key array<long>, run array<long>, longest array<long>", "update", GroupStateTimeout.NoTimeout
    )


def _cached(ttl_us: int):
    def run(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fetched = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        cached = []
        for key, at in zip(rows["key"].tolist(), rows["at"].tolist()):
            hit = key in fetched and at - fetched[key] < ttl_us
            cached.append(hit)
            if not hit:
                fetched[key] = at
        state.update((list(fetched), list(fetched.values())))
        yield pd.DataFrame({"event_id": rows["id"].to_numpy(), "cached": cached})

    return run


def cache_hits(fetches: DataFrame, keys: list[str], event: str, at: str, ttl_us: int) -> DataFrame:
    """Whether each fetch finds an answer of its key younger than the lifetime; when the answer was fetched is the
    keyed state. A row that comes late finds the later answer."""
    named = F.to_json(F.struct(*keys)).alias("key")
    rows = fetches.select(named, F.col(event).cast("long").alias("id"), F.unix_micros(F.col(at).cast("timestamp")).alias("at")).filter("at is not null")
    return _grouped(rows, "key").applyInPandasWithState(_cached(ttl_us), "event_id long, cached boolean", "key array<string>, fetched array<long>", "append", GroupStateTimeout.NoTimeout)
