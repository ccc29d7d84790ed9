"""Queries over orders as versioned snapshots of customers: newest, previous, written, kept, due."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators import usage, versions
from tidepool.plans.registry import query, table
from tidepool.plans.usage import PLAN, PLAN_ROWS, plan_of

LAG = (
    "v as (select o_custkey as page_id, o_orderkey as snapshot_id, o_orderdate as created_at, o_orderstatus as status, o_orderpriority as priority, o_totalprice as price, "
    "lag(o_orderkey) over w as prev_id, lag(o_orderstatus) over w as prev_status, lag(o_orderpriority) over w as prev_priority, lag(o_totalprice) over w as prev_price, row_number() over w = 1 as is_first "
    "from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))"
)


def snapshots(spark, sf_dir: str) -> DataFrame:
    """Orders as snapshots of a page, which is the customer."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"),
    )


def _oldest():
    return [F.col("created_at"), F.col("snapshot_id")]


def _newest():
    return [F.desc("created_at"), F.desc("snapshot_id")]


def _pairs(spark, sf_dir) -> DataFrame:
    return versions.with_previous(snapshots(spark, sf_dir), ["page_id"], _oldest(), ["snapshot_id", "status", "priority", "price"])


@query("select o_custkey as page_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) as snapshot_id, max(o_orderdate) as created_at from orders group by 1")
def snapshot_latest(spark, sf_dir):
    """The newest snapshot of each page, by one aggregation without a sort."""
    return snapshots(spark, sf_dir).groupBy("page_id").agg(F.max_by("snapshot_id", F.struct("created_at", "snapshot_id")).alias("snapshot_id"), F.max("created_at").alias("created_at"))


@query(f"with {LAG} select page_id, snapshot_id, prev_id as prev_snapshot_id, status is distinct from prev_status as status_changed, priority is distinct from prev_priority as priority_changed from v")
def snapshot_previous(spark, sf_dir):
    """Each snapshot with the one before it and what changed."""
    return _pairs(spark, sf_dir).select("page_id", "snapshot_id", "prev_snapshot_id", versions.changed(["status"]).alias("status_changed"), versions.changed(["priority"]).alias("priority_changed"))


@query(f"with {LAG} select case when is_first then 'first' when status is distinct from prev_status then 'content' when priority is distinct from prev_priority then 'facts' else 'skip' end as decision, count(*) as snapshots from v group by 1")
def snapshot_write_decision(spark, sf_dir):
    """Why a snapshot would be written, or that it is skipped."""
    decision = F.when(F.col("is_first"), "first").when(versions.changed(["status"]), "content").when(versions.changed(["priority"]), "facts").otherwise("skip")
    return _pairs(spark, sf_dir).groupBy(decision.alias("decision")).agg(F.count("*").alias("snapshots"))


@query(
    f"with {PLAN_ROWS}, r as (select o_custkey as page_id, o_orderkey as snapshot_id, {PLAN} as plan, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rank from orders join customer on o_custkey = c_custkey) "
    "select page_id, snapshot_id, rank::int as rank from r join plans using (plan) where rank > versions_kept // 3"
)
def snapshot_retention(spark, sf_dir):
    """Snapshots beyond what the owner's plan keeps (a third of it, as pages here have few)."""
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), plan_of(F.col("c_mktsegment")).alias("plan"))
    rows = snapshots(spark, sf_dir).join(owners, "page_id").join(F.broadcast(usage.plans(spark)), "plan")
    return versions.beyond(rows, ["page_id"], _newest(), F.floor(F.col("versions_kept") / 3)).select("page_id", "snapshot_id", "rank")


@query(
    f"with {PLAN_ROWS}, n as (select max(o_orderdate) as now from orders), l as (select c_custkey as page_id, {PLAN} as plan, max(o_orderdate) as last_checked from customer left join orders on o_custkey = c_custkey group by 1, 2) "
    "select page_id, plan, last_checked from l join plans using (plan), n where last_checked is null or last_checked <= now - to_hours(interval_hours)"
)
def due_work(spark, sf_dir):
    """Pages never checked, or not within the hours of their plan."""
    orders = table(spark, sf_dir, "orders")
    now = orders.agg(F.max("o_orderdate").alias("now")).withColumn("_one", F.lit(1))
    last = orders.groupBy(F.col("o_custkey").alias("page_id")).agg(F.max("o_orderdate").alias("last_checked"))
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), plan_of(F.col("c_mktsegment")).alias("plan"), F.lit(1).alias("_one"))
    rows = owners.join(F.broadcast(usage.plans(spark)), "plan").join(last, "page_id", "left").join(F.broadcast(now), "_one")
    return rows.filter(F.col("last_checked").isNull() | (F.col("last_checked") <= F.col("now") - F.make_dt_interval(hours=F.col("interval_hours")))).select("page_id", "plan", "last_checked")


@query("select o_custkey as owner, min(o_orderdate) as first_seen from orders group by 1 order by first_seen, owner limit 20")
def owners_limited(spark, sf_dir):
    """The twenty owners seen first."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.min("o_orderdate").alias("first_seen")).orderBy("first_seen", "owner").limit(20)


@query(
    "with r as (select o_orderkey, o_orderdate, c_nationkey, row_number() over (partition by c_nationkey order by o_orderdate desc, o_orderkey desc) as rank, count(*) over (partition by c_nationkey) as total from orders join customer on o_custkey = c_custkey) "
    "select n_name as nation, o_orderkey as change_id, rank::int as rank, least(total, 10)::bigint as listed, total from r join nation on n_nationkey = c_nationkey where rank <= 10"
)
def dashboard_recent_changes(spark, sf_dir):
    """The ten newest changes of each nation, with how many are listed and how many it has in all."""
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey").join(people, F.col("o_custkey") == F.col("c_custkey"))
    totals = rows.groupBy("c_nationkey").agg(F.count("*").alias("total"))
    newest = versions.top(rows, ["c_nationkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 10)
    listed = newest.groupBy("c_nationkey").agg(F.count("*").alias("listed"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return newest.join(totals, "c_nationkey").join(listed, "c_nationkey").join(F.broadcast(names), "c_nationkey").select("nation", F.col("o_orderkey").alias("change_id"), "rank", "listed", "total")


@query("select count(distinct c_custkey) as owners, count(o_orderkey) as snapshots, count(distinct o_custkey) as pages, max(o_orderdate) as last_checked from customer left join orders on o_custkey = c_custkey")
def dashboard_stats(spark, sf_dir):
    """Totals of the dashboard."""
    people = table(spark, sf_dir, "customer").agg(F.count_distinct("c_custkey").alias("owners")).withColumn("_one", F.lit(1))
    orders = table(spark, sf_dir, "orders").agg(F.count("*").alias("snapshots"), F.count_distinct("o_custkey").alias("pages"), F.max("o_orderdate").alias("last_checked")).withColumn("_one", F.lit(1))
    return people.join(orders, "_one").drop("_one")


@query(f"with {LAG} select page_id, snapshot_id, case when status = 'F' then 'page_unavailable' else 'page_available' end as change from v where not is_first and (status = 'F') <> (prev_status = 'F')")
def availability_transitions(spark, sf_dir):
    """Snapshots at which a page goes or comes back."""
    gone = F.col("status") == "F"
    rows = _pairs(spark, sf_dir).filter(~F.col("is_first") & (gone != (F.col("prev_status") == "F")))
    return rows.select("page_id", "snapshot_id", F.when(gone, "page_unavailable").otherwise("page_available").alias("change"))


@query(
    "select o_orderkey as job_id, case o_orderpriority when '1-URGENT' then 5 when '2-HIGH' then 4 when '3-MEDIUM' then 3 when '5-LOW' then 1 else 2 end as priority, o_orderdate as created_at "
    "from orders where o_orderstatus = 'O' order by priority desc, created_at, job_id limit 10"
)
def job_pick(spark, sf_dir):
    """The ten jobs to run next: by priority, then age."""
    level = F.col("o_orderpriority")
    priority = F.when(level == "1-URGENT", 5).when(level == "2-HIGH", 4).when(level == "3-MEDIUM", 3).when(level == "5-LOW", 1).otherwise(2)
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("job_id"), priority.alias("priority"), F.col("o_orderdate").alias("created_at"))
    return rows.orderBy(F.desc("priority"), "created_at", "job_id").limit(10)


@query("select o_custkey as page_id, o_orderpriority as kind, min(o_orderkey) as job_id from orders o where o_orderstatus = 'O' and not exists (select 1 from orders a where a.o_orderstatus = 'P' and a.o_custkey = o.o_custkey and a.o_orderpriority = o.o_orderpriority) group by 1, 2")
def job_dedupe(spark, sf_dir):
    """New jobs of which no like one is active, the first of each."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("job_id"), "o_orderstatus")
    new = versions.not_active(orders.filter("o_orderstatus = 'O'"), orders.filter("o_orderstatus = 'P'"), ["page_id", "kind"])
    return new.groupBy("page_id", "kind").agg(F.min("job_id").alias("job_id"))


@query("with s as (select o_orderkey, (o_orderkey % 5)::int as attempts, o_orderstatus from orders) select case when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'P' then 'deferred' when attempts >= 3 then 'failed' else 'queued' end as state, least(60, attempts * 5)::int as retry_minutes, count(*) as jobs from s group by 1, 2")
def job_states(spark, sf_dir):
    """What becomes of running jobs, and after how many minutes they are tried again."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5).cast("int").alias("attempts"), "o_orderstatus")
    state = usage.job_state(F.col("attempts"), F.col("o_orderstatus") == "P", F.col("o_orderstatus") == "F")
    return rows.groupBy(state.alias("state"), usage.retry_minutes(F.col("attempts")).alias("retry_minutes")).agg(F.count("*").alias("jobs"))


@query("select o_orderkey as snapshot_id from orders where exists (select 1 from customer join nation on c_nationkey = n_nationkey where c_custkey = o_custkey and n_regionkey = 1 and c_mktsegment = 'BUILDING')")
def visible_snapshots(spark, sf_dir):
    """Snapshots that the owners of one segment and region may see."""
    nations = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    owners = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").join(F.broadcast(nations), "c_nationkey", "left_semi").select(F.col("c_custkey").alias("page_id"))
    return versions.visible_to(snapshots(spark, sf_dir), owners, ["page_id"]).select("snapshot_id")


@query("select o_orderkey as change_id from orders where coalesce(o_totalprice / 500000, 0) < 0.72 and o_orderstatus is distinct from 'P' and regexp_matches(o_orderpriority, '(?i)(low|not specified)')")
def quarantine_rows(spark, sf_dir):
    """Changes that aren't shown: low confidence and doubtful evidence."""
    low = F.coalesce(F.col("o_totalprice") / 500000, F.lit(0.0)) < 0.72
    rows = table(spark, sf_dir, "orders").filter(low & ~F.col("o_orderstatus").eqNullSafe("P") & F.col("o_orderpriority").rlike("(?i)(low|not specified)"))
    return rows.select(F.col("o_orderkey").alias("change_id"))
