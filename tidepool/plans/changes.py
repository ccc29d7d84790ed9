"""Queries over line items as facts and plans: keyed differences, price changes, consensus, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.operators import recommend, scoring, versions
from tidepool.plans.registry import query, table

ORDER_PRICES = "p as (select o_custkey as page_id, o_orderkey as snapshot_id, o_orderdate as created_at, min(l_extendedprice) as lowest, max(l_extendedprice) as highest from orders join lineitem on l_orderkey = o_orderkey group by 1, 2, 3)"
RANKED_ORDERS = "r as (select o_custkey as page_id, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rank from orders)"


def _two_newest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), "o_orderkey", "o_orderdate")
    return versions.top(orders, ["page_id"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2).select("page_id", "o_orderkey", "rank")


def _brands(spark, sf_dir):
    """Brands with their lowest price in the two newest versions of each page."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("plan"))
    rows = _two_newest(spark, sf_dir).join(lines, "o_orderkey").join(parts, "l_partkey")
    return rows.groupBy("page_id", "rank", "plan").agg(F.min("l_extendedprice").alias("price"))


BRANDS = f"{RANKED_ORDERS}, b as (select page_id, rank, p_brand as plan, min(l_extendedprice) as price from r join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where rank <= 2 group by 1, 2, 3)"


@query(
    f"with {ORDER_PRICES}, v as (select *, lag(lowest) over w as prev_lowest, lag(highest) over w as prev_highest from p window w as (partition by page_id order by created_at, snapshot_id)) "
    "select page_id, snapshot_id, lowest <> prev_lowest as lowest_changed, highest <> prev_highest as highest_changed, round((lowest - prev_lowest) / prev_lowest, 6) as lowest_shift from v where prev_lowest is not null"
)
def price_change(spark, sf_dir):
    """Lowest and highest price of each version against the version before."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("snapshot_id")).agg(F.min("l_extendedprice").alias("lowest"), F.max("l_extendedprice").alias("highest"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("created_at"))
    rows = versions.with_previous(orders.join(lines, "snapshot_id"), ["page_id"], [F.col("created_at"), F.col("snapshot_id")], ["lowest", "highest"]).filter("not is_first")
    shift = F.round((F.col("lowest") - F.col("prev_lowest")) / F.col("prev_lowest"), 6)
    return rows.select("page_id", "snapshot_id", versions.changed(["lowest"]).alias("lowest_changed"), versions.changed(["highest"]).alias("highest_changed"), shift.alias("lowest_shift"))


@query(
    f"with {BRANDS}, two as (select page_id from r group by 1 having count(*) >= 2), o as (select * from b where rank = 2), n as (select * from b where rank = 1) "
    "select coalesce(o.page_id, n.page_id) as page_id, coalesce(o.plan, n.plan) as plan, case when o.plan is null then 'added' when n.plan is null then 'removed' when o.price <> n.price then 'changed' else 'same' end as change "
    "from o full join n on o.page_id = n.page_id and o.plan = n.plan where coalesce(o.page_id, n.page_id) in (select page_id from two)"
)
def plan_diff(spark, sf_dir):
    """Plans added, removed and changed between the two newest versions of each page that has two."""
    brands = _brands(spark, sf_dir)
    two = _two_newest(spark, sf_dir).filter("rank = 2").select("page_id")
    diff = versions.keyed_diff(brands.filter("rank = 2"), brands.filter("rank = 1"), ["page_id", "plan"], ["price"])
    return diff.join(two, "page_id", "left_semi").select("page_id", "plan", "change")


@query(
    f"with {BRANDS}, s as (select page_id, list(plan) filter (where rank = 1) as n, list(plan) filter (where rank = 2) as o from b group by 1) "
    "select page_id, list_sort(list_filter(n, lambda x: not list_contains(o, x)))[1] as first_added, list_sort(list_filter(o, lambda x: not list_contains(n, x)))[1] as first_removed from s where o is not null and n is not null"
)
def value_set_diff(spark, sf_dir):
    """The first value that came and the first that went."""
    rows = _brands(spark, sf_dir).groupBy("page_id").agg(F.collect_set(F.when(F.col("rank") == 1, F.col("plan"))).alias("n"), F.collect_set(F.when(F.col("rank") == 2, F.col("plan"))).alias("o"))
    first = lambda a, b: F.get(F.array_sort(F.array_except(a, b)), F.lit(0))
    return rows.filter((F.size("o") > 0) & (F.size("n") > 0)).select("page_id", first("n", "o").alias("first_added"), first("o", "n").alias("first_removed"))


CONF = "round(0.5 + (l_quantity / 100), 4)"


def _facts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", F.round(0.5 + F.col("l_quantity") / 100, 4).alias("confidence"))


@query(f"select l_orderkey as change_id, l_linenumber as line, {CONF} as confidence, case when {CONF} >= 0.9 then 'high' when {CONF} >= 0.82 then 'medium' else 'low' end as severity from lineitem where {CONF} >= 0.72 and l_returnflag <> 'R'")
def change_confidence_gate(spark, sf_dir):
    """Changes that are trusted, with their severity."""
    rows = _facts(spark, sf_dir).filter(scoring.trusted(F.col("confidence"), F.when(F.col("l_returnflag") == "R", "duplicate_homepage").otherwise("")))
    return rows.select(F.col("l_orderkey").alias("change_id"), F.col("l_linenumber").alias("line"), "confidence", scoring.severity(F.col("confidence")).alias("severity"))


@query(
    f"with f as (select l_orderkey, l_linenumber, l_partkey, l_returnflag as category, {CONF} as confidence from lineitem), r as (select *, row_number() over (partition by l_orderkey order by confidence desc, l_linenumber, l_partkey) as rank from f) "
    "select l_orderkey as page_id, count(*) as changes, string_agg(category || ':' || l_linenumber::varchar, ',' order by category, confidence desc, l_linenumber) as payload, "
    "max(case when confidence >= 0.9 then 3 when confidence >= 0.82 then 2 else 1 end)::int as highest_severity from r where rank <= 4 group by 1"
)
def change_payload(spark, sf_dir):
    """The four surest changes of each page as one row, ordered by category."""
    rows = versions.top(_facts(spark, sf_dir), ["l_orderkey"], [F.desc("confidence"), F.col("l_linenumber"), F.col("l_partkey")], 4)
    each = F.struct(F.col("l_returnflag").alias("c"), (-F.col("confidence")).alias("n"), F.col("l_linenumber").alias("l"))
    rows = rows.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.count("*").alias("changes"), F.array_sort(F.collect_list(each)).alias("_e"), F.max(scoring.severity_rank(scoring.severity(F.col("confidence")))).alias("highest_severity"))
    return rows.select("page_id", "changes", F.array_join(F.transform("_e", lambda x: F.concat(x["c"], F.lit(":"), x["l"].cast("string"))), ",").alias("payload"), "highest_severity")


@query(
    f"with f as (select l_orderkey, l_linenumber, l_partkey, case l_returnflag when 'N' then 1 when 'A' then 2 else 3 end as field_rank, p_type as value, {CONF} as confidence from lineitem join part on p_partkey = l_partkey), "
    "r as (select *, row_number() over (partition by l_orderkey order by confidence desc, field_rank, l_linenumber, l_partkey) as rank from f) select l_orderkey as page_id, value, confidence from r where rank = 1"
)
def fact_best_by_field(spark, sf_dir):
    """The surest fact of each page; of equals the one of the field that comes first."""
    rank = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    rows = versions.latest(_facts(spark, sf_dir).withColumn("_field", rank), ["l_orderkey"], [F.desc("confidence"), F.col("_field"), F.col("l_linenumber"), F.col("l_partkey")])
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("value"))
    return rows.join(parts, "l_partkey").select(F.col("l_orderkey").alias("page_id"), "value", "confidence")


@query(
    f"with f as (select l_suppkey, {CONF} as c from lineitem), g as (select l_suppkey, case when c >= 0.8 then greatest(c, 0.8) when c >= 0.6 then greatest(c, 0.55) else least(c, 0.54) end as c from f) "
    "select l_suppkey as entity_id, round(avg(c), 4) as confidence, count(*) as facts from g group by 1"
)
def fact_confidence_avg(spark, sf_dir):
    """Mean confidence of each entity's facts, each inside the range of its level."""
    rows = _facts(spark, sf_dir)
    c = scoring.clamped_confidence(scoring.confidence_level(F.col("confidence")), F.col("confidence"))
    return rows.groupBy(F.col("l_suppkey").alias("entity_id")).agg(F.round(F.avg(c), 4).alias("confidence"), F.count("*").alias("facts"))


@query(
    f"with f as (select p_brand as value, l_suppkey, {CONF} as c from lineitem join part on p_partkey = l_partkey), s as (select value, count(distinct l_suppkey) as supporters, avg(c) as mean from f group by 1) "
    "select value, supporters, (case when mean >= 0.9 then 1 when mean >= 0.75 then 2 when mean >= 0.6 then 3 else 4 end)::int as needed, supporters >= case when mean >= 0.9 then 1 when mean >= 0.75 then 2 when mean >= 0.6 then 3 else 4 end as agreed from s"
)
def consensus_support(spark, sf_dir):
    """Values with the entities that support them, and how many it takes at their mean confidence."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("value"))
    rows = _facts(spark, sf_dir).join(parts, "l_partkey").groupBy("value").agg(F.count_distinct("l_suppkey").alias("supporters"), F.avg("confidence").alias("_m"))
    needed = scoring.supporters_needed(F.col("_m"))
    return rows.select("value", "supporters", needed.alias("needed"), (F.col("supporters") >= needed).alias("agreed"))


@query(
    "with f as (select n_name as nation, s_suppkey, sum(l_extendedprice) as v, count(*) as n from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by 1, 2), "
    "s as (select *, floor(v / 1000) as score from f), r as (select *, row_number() over (partition by nation order by score desc, n desc, s_suppkey) as rank from s) select nation, rank::int as rank, s_suppkey as entity_id, n as support from r where rank <= 3"
)
def recommendation_rank(spark, sf_dir):
    """The three entities of each nation that are worth most."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_extendedprice").alias("v"), F.count("*").alias("support"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    rows = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").join(F.broadcast(nations), "s_nationkey").withColumn("score", F.floor(F.col("v") / 1000))
    rows = versions.top(rows, ["nation"], [F.desc("score"), F.desc("support"), F.col("s_suppkey")], 3)
    return rows.select("nation", "rank", F.col("s_suppkey").alias("entity_id"), "support")


@query(
    "with r as (select p_partkey, p_type, p_size, row_number() over (partition by p_type order by p_size desc, p_partkey) as own, row_number() over (order by p_size desc, p_partkey) as overall from part), "
    "q as (select *, (own <= case when starts_with(p_type, 'PROMO') then 3 else 2 end) as within from r), f as (select *, row_number() over (order by within desc, overall) as place from q) select p_partkey as candidate_id, within as by_quota, place::int as place from f where place <= 40"
)
def candidate_quota(spark, sf_dir):
    """Forty candidates: each type's quota first, then the best of the rest."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    best = [F.desc("p_size"), F.col("p_partkey")]
    #: No type needs more than its first three, no place more than the first forty of all: both are cut off early.
    own = versions.top(rows, ["p_type"], best, 3).filter((F.col("rank") <= 2) | F.col("p_type").startswith("PROMO")).drop("rank")
    rest = rows.orderBy(*best).limit(40).withColumn("by_quota", F.lit(False))
    both = own.withColumn("by_quota", F.lit(True)).unionByName(rest).groupBy("p_partkey", "p_type", "p_size").agg(F.max("by_quota").alias("by_quota"))
    chosen = both.orderBy(F.desc("by_quota"), *best).limit(40)
    place = F.row_number().over(W.orderBy(F.desc("by_quota"), *best))
    return chosen.select(F.col("p_partkey").alias("candidate_id"), "by_quota", place.alias("place"))


@query(
    f"with f as (select s_nationkey as user_id, l_suppkey as entity_id, p_type as field, p_brand as value, {CONF} as score from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey), "
    "g as (select user_id, field, count(distinct entity_id) as supporters, count(distinct lower(trim(value))) as signals, avg(score) as mean from f where score >= 0.55 group by 1, 2), "
    "n as (select *, case when mean >= 0.9 then 1 when mean >= 0.75 then 2 when mean >= 0.6 then 3 else 4 end as needed from g), "
    "k as (select user_id, field, supporters, signals, needed, mean, least(96, floor(round(48 + least(supporters, 4) * 9 + mean * 20, 6) + 0.5))::int as confidence from n where supporters >= needed and field <> 'PROMO'), "
    "s as (select *, round(least(0.94, 0.54 + signals * 0.12 + supporters * 0.06), 4) as novelty, least(100, floor(0.86::double * 0.62::double * (confidence / 100.0::double) / 0.7::double * 100 + 0.5))::int as priority from k), "
    "t as (select *, len(list_filter(string_split('Show ' || field || ' as ' || supporters || ' others do', ' '), lambda w: w <> '')) >= 4 as specific, greatest(0, least(10, round(least(10, (supporters + 1) * 1.7::double + mean * 4), 1))) as proof, greatest(0, least(10, round(confidence / 10.0::double, 1))) as sure from s), "
    "v as (select *, floor(round(case when specific then 9 else 3 end + proof + 8.6::double + greatest(0, least(10, round(novelty * 10, 1))) + 6.2::double + greatest(0, least(10, round(priority / 15.0::double + least(3, supporters) + case when specific then 9 else 3 end / 4.0::double, 1))) + sure, 6) + 0.5)::int as value from t), "
    "r as (select *, row_number() over (partition by user_id order by novelty desc, priority desc, confidence desc, field) as rank from v where confidence >= 75 and value >= 60 and novelty >= 0.6 and priority >= 35 and proof >= 6 and sure >= 6 and signals > 0) "
    "select user_id, field, value, supporters, confidence, novelty, priority, rank::int as rank, case when confidence >= 90 then 'highlight' when confidence >= 75 then 'normal' else 'collapsed' end as visibility from r where rank <= 3"
)
def recommended_gaps(spark, sf_dir):
    """What a nation's suppliers agree on and the nation's own facts (here PROMO everywhere) don't have."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("field"), F.col("p_brand").alias("value"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("user_id"))
    facts = _facts(spark, sf_dir).join(parts, "l_partkey").join(suppliers, "l_suppkey")
    others = facts.select("user_id", F.col("l_suppkey").alias("entity_id"), "field", "value", F.col("confidence").alias("score"))
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("user_id"), F.lit("PROMO").alias("field"), F.lit(0.9).alias("score"))
    rows = recommend.ranked(recommend.supported_gaps(own, others))
    return rows.select("user_id", "field", "value", "supporters", "confidence", "novelty", "priority", "rank", "visibility")
