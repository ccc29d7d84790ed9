"""Queries over events as a usage log, with customers as users: rolling counts, costs, limits, reports.

The newest event's time stands for the present, so results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.operators import evaluate, scoring, usage, versions
from tidepool.plans.registry import query, table

NOW = "n as (select max(ts) as now from events)"
PLAN = "case c_mktsegment when 'BUILDING' then 'business' when 'AUTOMOBILE' then 'pro' when 'MACHINERY' then 'pro' else 'free' end"
PLAN_ROWS = "plans as (select * from (values " + ", ".join(f"('{p}', {a}, {b}, {c}, {d})" for p, a, b, c, d in usage.PLANS) + ") as t(plan, scans_per_day, owner_limit, interval_hours, versions_kept))"


def plan_of(segment: Column) -> Column:
    return F.when(segment == "BUILDING", "business").when(segment.isin("AUTOMOBILE", "MACHINERY"), "pro").otherwise("free")


def events_now(spark, sf_dir: str) -> DataFrame:
    """Events with the newest time of all as `now`, one broadcast row."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now")).withColumn("_one", F.lit(1))
    return events.withColumn("_one", F.lit(1)).join(F.broadcast(now), "_one").drop("_one")


def _recent(hours: int) -> Column:
    return usage.within_hours(F.col("ts"), F.col("now"), hours)


@query(f"with {NOW} select user_id, count(*) as events_24h, round(sum(value), 2) as value_24h from events, n where ts > now - interval 24 hours group by 1")
def usage_count_24h_user(spark, sf_dir):
    """Events of each user in the last 24 hours."""
    return events_now(spark, sf_dir).filter(_recent(24)).groupBy("user_id").agg(F.count("*").alias("events_24h"), F.round(F.sum("value"), 2).alias("value_24h"))


@query(f"with {NOW} select event_type, count(*) as events_24h from events, n where ts > now - interval 24 hours group by 1")
def usage_count_24h_type(spark, sf_dir):
    """Events of each type in the last 24 hours."""
    return events_now(spark, sf_dir).filter(_recent(24)).groupBy("event_type").agg(F.count("*").alias("events_24h"))


@query("select event_id, user_id, count(*) over (partition by user_id order by ts range between interval 24 hours preceding and current row) as rolling_24h from events")
def usage_rolling_24h(spark, sf_dir):
    """For each event how many its user had in the 24 hours up to it."""
    events = table(spark, sf_dir, "events").withColumn("_s", F.unix_micros(F.col("ts").cast("timestamp")))
    w = W.partitionBy("user_id").orderBy("_s").rangeBetween(-24 * 3600 * 1_000_000, 0)
    return events.select("event_id", "user_id", F.count("*").over(w).alias("rolling_24h"))


@query(f"with {NOW} select user_id, round(sum(coalesce(value, 0) * 0.0005), 6) as month_cost, count(*) as month_events from events, n where ts >= date_trunc('month', now) group by 1")
def usage_month_cost(spark, sf_dir):
    """Cost of each user since the month began."""
    rows = events_now(spark, sf_dir).filter(F.col("ts") >= F.date_trunc("month", "now"))
    return rows.groupBy("user_id").agg(F.round(F.sum(F.coalesce("value", F.lit(0.0)) * usage.PAGE_COST), 6).alias("month_cost"), F.count("*").alias("month_events"))


@query(
    f"with {NOW} select count(*) filter (where ts >= date_trunc('day', now)) as today_events, round(sum(case when event_type in ('view', 'click') then coalesce(value, 1) else 0 end), 2) as quantity, "
    "round(sum(coalesce(value, 0) * 0.0005) filter (where ts >= date_trunc('month', now)), 4) as month_cost, count(distinct user_id) as users from events, n"
)
def usage_admin_row(spark, sf_dir):
    """The administrator's dashboard: one row of conditional sums in one pass."""
    some = F.col("event_type").isin("view", "click")
    return events_now(spark, sf_dir).agg(
        F.count_if(F.col("ts") >= F.date_trunc("day", "now")).alias("today_events"), F.round(F.sum(F.when(some, F.coalesce("value", F.lit(1.0))).otherwise(0.0)), 2).alias("quantity"),
        F.round(F.sum(F.when(F.col("ts") >= F.date_trunc("month", "now"), F.coalesce("value", F.lit(0.0)) * usage.PAGE_COST)), 4).alias("month_cost"), F.count_distinct("user_id").alias("users"),
    )


@query("select user_id, round(sum(value) * 0.0005, 4) as cost from events group by 1 order by sum(value) desc, user_id limit 5")
def usage_top_users(spark, sf_dir):
    """The five users that cost most."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("_v"))
    return rows.orderBy(F.desc("_v"), "user_id").limit(5).select("user_id", F.round(F.col("_v") * usage.PAGE_COST, 4).alias("cost"))


@query(
    f"with {NOW}, {PLAN_ROWS}, scans as (select user_id, count(*) filter (where ts > now - interval 24 hours) as scans_user, sum(value * 0.0005) filter (where ts >= date_trunc('month', now)) as cost from events, n group by 1), "
    "g as (select count(*) as scans_global from events, n where ts > now - interval 24 hours), "
    f"u as (select c_custkey as user_id, {PLAN} as plan from customer) "
    "select u.user_id, plan, coalesce(scans_user, 0) as scans_user, scans_per_day, case when coalesce(cost, 0) >= 20.0 then 'budget' when scans_global >= 1000000 then 'global_limit' "
    "when coalesce(scans_user, 0) >= scans_per_day then 'user_limit' else 'allowed' end as decision from u join plans using (plan) left join scans using (user_id), g"
)
def usage_gate_decision(spark, sf_dir):
    """Whether each user may run a scan now, or the first limit that forbids it."""
    events = events_now(spark, sf_dir)
    scans = events.groupBy("user_id").agg(F.count_if(_recent(24)).alias("scans_user"), F.sum(F.when(F.col("ts") >= F.date_trunc("month", "now"), F.col("value") * usage.PAGE_COST)).alias("cost"))
    every = events.filter(_recent(24)).agg(F.count("*").alias("scans_global")).withColumn("_one", F.lit(1))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), plan_of(F.col("c_mktsegment")).alias("plan"), F.lit(1).alias("_one"))
    rows = users.join(F.broadcast(usage.plans(spark)), "plan").join(scans, "user_id", "left").join(F.broadcast(every), "_one")
    user = F.coalesce("scans_user", F.lit(0).cast("long"))
    decision = usage.scan_decision(F.coalesce("cost", F.lit(0.0)), F.col("scans_global"), user, F.col("scans_per_day"), most=1_000_000)
    return rows.select("user_id", "plan", user.alias("scans_user"), "scans_per_day", decision.alias("decision"))


@query(
    "select strftime(ts, '%Y-%m-%d') as day, " + ", ".join(f"count(*) filter (where event_type = '{t}') as n_{t}" for t in ("click", "error", "purchase", "signup", "view")) + " from events group by 1"
)
def usage_daily_types(spark, sf_dir):
    """Events of each type by day."""
    rows = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return rows.agg(*[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in ("click", "error", "purchase", "signup", "view")])


@query("select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events group by 1")
def usage_percentiles(spark, sf_dir):
    """Median and 95th percentile by nearest rank."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(evaluate.nearest_rank("value", 50).alias("p50"), evaluate.nearest_rank("value", 95).alias("p95"))


@query(
    "with e as (select *, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from events), "
    "s as (select user_id, island, count(*) filter (where event_type = 'error') as streak from e group by 1, 2) select user_id, max(streak) as longest from s group by 1"
)
def usage_failure_streak(spark, sf_dir):
    """The longest run of errors of each user."""
    rows = versions.streak(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error")
    return rows.groupBy("user_id").agg(F.max("streak").alias("longest"))


@query("select event_type, count(json_extract(props, '$.k')) as with_k, sum(json_extract(props, '$.k')::bigint)::bigint as sum_k from events group by 1")
def usage_props(spark, sf_dir):
    """A field of the events' JSON, summed."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("with_k"), F.sum(k).alias("sum_k"))


@query(
    f"with {NOW}, r as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from events, n where ts > now - interval 168 hours) "
    "select user_id, count(*) as week_events, max(event_id) filter (where rank = 1) as newest_id, string_agg(event_id::varchar, ',' order by rank) filter (where rank <= 8) as listed from r group by 1"
)
def digest_last_week(spark, sf_dir):
    """Each user's digest: events of the last seven days and the newest eight."""
    rows = events_now(spark, sf_dir).filter(_recent(168))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    listed = F.array_sort(F.collect_list(F.when(F.col("rank") <= 8, F.struct("rank", "event_id"))))
    return rows.groupBy("user_id").agg(F.count("*").alias("week_events"), F.max(F.when(F.col("rank") == 1, F.col("event_id"))).alias("newest_id"), F.array_join(F.transform(listed, lambda x: x["event_id"].cast("string")), ",").alias("listed"))


@query(f"with {NOW} select event_type, count(*) as this_week, max(ts) as newest, max(ts) + interval 12 hours as next_due from events, n where ts >= date_trunc('week', now) group by 1")
def market_pulse(spark, sf_dir):
    """Events by type since Monday, and when the next look is due."""
    rows = events_now(spark, sf_dir).filter(F.col("ts") >= F.date_trunc("week", "now"))
    return rows.groupBy("event_type").agg(F.count("*").alias("this_week"), F.max("ts").alias("newest")).withColumn("next_due", F.col("newest") + F.expr("INTERVAL 12 HOURS"))


@query("select user_id, event_type, max_by(value, event_id) as value, max(event_id) as event_id from events group by 1, 2")
def upsert_latest(spark, sf_dir):
    """The table after all events have been upserted by user and type."""
    rows = versions.upserted(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("event_id")])
    return rows.select("user_id", "event_type", "value", "event_id")


@query(
    "with q as (select strftime(ts, '%Y-%m-%d') as day, count(*) filter (where event_type <> 'error') as ok, count(*) filter (where event_type = 'error') as failed, count(*) filter (where event_type = 'purchase') as changed from events group by 1), "
    "s as (select *, greatest(0.0, least(100.0, ok * 0.05::double / greatest((ok + failed) * 0.05::double, 1) * 35 + 25 + case when changed > 0 then 20 else 12 end + 20 - failed * 0.05 * 8 - least(10.0, changed * 0.01 * 1.5))) as score from q) "
    "select day, round(score, 3) as score, case when score >= 80 then 'high' when score >= 60 then 'medium' else 'limited' end as label from s"
)
def scan_quality(spark, sf_dir):
    """Quality of each day as one scan, with its label."""
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(kind != "error").alias("ok"), F.count_if(kind == "error").alias("failed"), F.count_if(kind == "purchase").alias("changed"))
    #: Twenty events count as one page, a hundred changes as one warning.
    rows = rows.withColumn("_s", scoring.monitoring_quality(F.col("ok") * 0.05, F.col("failed") * 0.05, F.col("changed") * 0.01, F.col("changed"), F.lit(20)))
    return rows.select("day", F.round("_s", 3).alias("score"), scoring.quality_label(F.col("_s")).alias("label"))


@query(
    "select source, count(*) as texts, sum(ceil(length(coalesce(text, '')) / 4.0))::bigint as tokens, round(count(*) * 0.0005::double, 6) as page_cost, round(sum(ceil(length(coalesce(text, '')) / 4.0))::double / 1000 * 0.0002, 6) as token_cost from documents group by 1"
)
def analysis_costs(spark, sf_dir):
    """What analysing each source's texts costs: pages, tokens, and the price of both."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("texts"), F.sum(usage.text_tokens(F.col("text"))).alias("tokens"))
    return rows.select("source", "texts", "tokens", usage.page_cost(F.col("texts")).alias("page_cost"), usage.token_cost(F.col("tokens")).alias("token_cost"))
