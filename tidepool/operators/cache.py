"""A cache with a time to live over a log of fetches: which fetch finds an answer depends on the hits before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.operators.sinks import stored

#: Lifetimes that one bucket of a key's time holds: a key is spread over its buckets.
LIVES = 16


def _pointers(nodes: DataFrame, keys: list[str], ttl: int) -> DataFrame:
    """Every time of a key with _next, the first time at which an answer fetched then is too old, and whether the
    time is a start: nothing was fetched in the lifetime before, so it is a miss whatever came earlier.

    Times of a key are cut into buckets; a bucket's own rows answer most questions, its neighbours' least and
    largest times the rest, so no window holds more of a key than one bucket or one row for each bucket.
    """
    bucket = lambda t: F.floor(t / (ttl * LIVES))
    times = nodes.select(*keys, F.col("_t").alias("_at"), F.col("_t").alias("_event"), F.lit(0).alias("_asks"))
    asks = nodes.select(*keys, (F.col("_t") + ttl).alias("_at"), F.lit(None).cast("long").alias("_event"), F.lit(1).alias("_asks"))
    both = times.unionByName(asks).withColumn("_bucket", bucket(F.col("_at")))
    held = both.groupBy(*keys, "_bucket").agg(F.min("_event").alias("_least"), F.max("_event").alias("_most"))
    along = W.partitionBy(*keys).orderBy("_bucket")
    held = held.select(
        *keys, "_bucket", F.last("_least", ignorenulls=True).over(W.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)).alias("_later"),
        F.last("_most", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
    )
    down = W.partitionBy(*keys, "_bucket").orderBy(F.desc("_at"), "_asks").rowsBetween(W.unboundedPreceding, W.currentRow)
    up = W.partitionBy(*keys, "_bucket").orderBy("_at", "_asks").rowsBetween(W.unboundedPreceding, -1)
    placed = both.select("*", F.last("_event", ignorenulls=True).over(down).alias("_found"), F.last("_event", ignorenulls=True).over(up).alias("_last"))
    placed = placed.join(held, [*keys, "_bucket"])
    known = placed.filter("_asks = 1").select(*keys, (F.col("_at") - ttl).alias("_t"), F.coalesce("_found", "_later").alias("_next"))
    before = F.coalesce("_last", "_before")
    starts = placed.filter("_asks = 0").select(*keys, F.col("_at").alias("_t"), (before.isNull() | (F.col("_at") - before >= ttl)).alias("_start"))
    return known.join(starts, [*keys, "_t"])


def ttl_hits(fetches: DataFrame, keys: list[str], at: str, order: str, ttl: str) -> DataFrame:
    """Fetches with `cached`: whether the answer of the last miss of their key is younger than the lifetime.

    A hit doesn't renew the answer; one exactly as old as the lifetime is too old. Of fetches of a key at one time
    the first by `order` may miss. Fetches without a time miss and leave nothing; null keys are a key.

    The misses of a key are what following the pointers to the first time that is too late reaches from its starts.
    Jumps of doubled length find them in as many rounds as the logarithm of the longest run of misses without a
    pause of a lifetime; rounds are written, so nothing is computed twice.
    """
    spark = fetches.sparkSession
    micros = spark.range(1).select((F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {ttl})")).alias("t")).first()["t"]
    own = [f"_k{i}" for i in range(len(keys))]
    #: Null keys are a key, so a key's columns travel as one that is never null.
    named = F.to_json(F.struct(*[F.col(k).alias(n) for k, n in zip(keys, own)]))
    time = F.unix_micros(F.col(at).cast("timestamp"))
    rows = fetches.select("*", named.alias("_key"), time.alias("_t"), F.col(order).alias("_order"))
    nodes = rows.filter("_t is not null").groupBy("_key", "_t").agg(F.min("_order").alias("_first"))
    nodes = stored(nodes, "cache-times")
    jumps = stored(_pointers(nodes, ["_key"], micros), "cache-pointers")
    missed = jumps.filter("_start").select("_key", "_t")
    jumps = jumps.filter("_next is not null").select("_key", "_t", "_next")
    found, total = missed.count(), -1
    while found != total:
        total = found
        reached = missed.join(jumps, ["_key", "_t"]).select("_key", F.col("_next").alias("_t"))
        missed = stored(missed.unionByName(reached).distinct(), "cache-misses")
        found = missed.count()
        if found != total:
            onward = jumps.select("_key", F.col("_t").alias("_next"), F.col("_next").alias("_onward"))
            jumps = stored(jumps.join(onward, ["_key", "_next"]).select("_key", "_t", F.col("_onward").alias("_next")), "cache-pointers")
    missed = nodes.join(missed, ["_key", "_t"]).select("_key", F.col("_first").alias("_order"), "_t", F.lit(True).alias("_missed"))
    out = rows.join(missed, ["_key", "_t", "_order"], "left")
    return out.select(*fetches.columns, (F.col("_t").isNotNull() & F.col("_missed").isNull()).alias("cached"))
