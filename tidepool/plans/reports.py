"""Queries for sinks, reports, evaluation, discovery and the reads behind pages of the application."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.functions import urls
from tidepool.operators import cache, quality, recommend, scoring, sinks, usage, versions
from tidepool.plans.registry import query, table


@query("select event_id, user_id, value from events union all select event_id, user_id, value from events where event_type = 'error'")
def appended_rows(spark, sf_dir):
    """A table after two writes, of all events and of the errors once more."""
    rows, path = table(spark, sf_dir, "events"), sinks.new_table(spark, "appended")
    sinks.append(rows.select("event_id", "user_id", "value"), path)
    return sinks.append(rows.filter("event_type = 'error'").select("event_id", "user_id", "value"), path)


@query(
    "with l as (select user_id, max(struct_pack(ts := ts, i := event_id)) filter (where event_type <> 'error') as last, max(ts) filter (where event_type <> 'error') as last_success, max(ts) filter (where event_type = 'error') as last_failure from events group by 1) "
    "select l.user_id, count(*) filter (where event_type = 'error' and (last is null or struct_pack(ts := ts, i := event_id) > last)) as failures, any_value(last_success) as last_success, any_value(last_failure) as last_failure from l join events using (user_id) group by 1"
)
def availability_counters(spark, sf_dir):
    """Each user's failures since the last success, with the times of both."""
    return sinks.counters(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") != "error", F.col("ts"))


@query("select coalesce(c_custkey, s_suppkey) as id, case when s_suppkey is not null then s_name else c_name end as name, s_suppkey is not null as written from customer full join supplier on c_custkey = s_suppkey")
def user_upsert(spark, sf_dir):
    """A table after two batches by id, the second one written twice: its name wins, others stay."""
    path = sinks.new_table(spark, "users")
    named = lambda name, key, text: table(spark, sf_dir, name).select(F.col(key).alias("id"), F.col(text).alias("name"))
    sinks.merge(named("customer", "c_custkey", "c_name"), path, ["id"], [F.col("name")], 1)
    for _ in range(2):
        rows = sinks.merge(named("supplier", "s_suppkey", "s_name"), path, ["id"], [F.col("name")], 2)
    return rows.select("id", "name", (F.col("batch") == 2).alias("written"))


@query(
    "with d as (select user_id, event_type, ts::date as day, event_id, value from events), f as (select user_id, event_type, min_by(day, event_id) as day, arg_max(value, event_id) as value, count(*) as n from d group by 1, 2) "
    "select user_id, event_type, strftime(day, '%Y-%m-%d') as first_day, round(value, 4) as value from f"
)
def event_trigger_rows(spark, sf_dir):
    """One row for each user and kind after merging the first and then the last events: the day of the first stays, the value follows the last."""
    path, events = sinks.new_table(spark, "triggered"), table(spark, sf_dir, "events")
    rows = events.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("first_day"), F.round("value", 4).alias("value"), "event_id")
    sinks.merge(rows, path, ["user_id", "event_type"], [F.col("event_id")], 1)
    found = sinks.merge(rows, path, ["user_id", "event_type"], [F.desc("event_id")], 2, update=["value", "event_id"])
    return found.select("user_id", "event_type", "first_day", "value")


@query(
    "with r as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders), w as (select o_custkey, o_orderstatus, min(n) as n from r where o_orderstatus <> 'O' group by 1, 2), ww as (select o_custkey, string_agg(o_orderstatus, ',' order by n) as warnings from w group by 1) "
    "select o_custkey, count(*) as facts, string_agg(o_orderkey::varchar, ',' order by n) filter (where n <= 60) as listed, coalesce(any_value(warnings), '') as warnings from r left join ww using (o_custkey) group by 1"
)
def entity_snapshots(spark, sf_dir):
    """One snapshot row an owner: facts in order (sixty at the most) and distinct warnings."""
    rows = sinks.snapshots(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")))
    return rows.select("o_custkey", "facts", F.array_join("listed", ",").alias("listed"), F.array_join("warnings", ",").alias("warnings"))


@query(
    "with v as (select *, lag(value) over (partition by user_id order by ts, event_id) as old from events), c as (select *, abs(value - old) / 20 as score from v where old is not null), k as (select *, row_number() over (partition by user_id order by score desc, event_id) as n from c where score >= 0.82) "
    "select e.event_id as snapshot_id, e.user_id, k.n::int as change_rank, round(k.score, 4) as score from events e left join k on k.event_id = e.event_id and k.n <= 8"
)
def snapshot_changes_sink(spark, sf_dir):
    """Snapshots with the accepted changes that are written beside them, eight an entity at the most."""
    rows = table(spark, sf_dir, "events")
    old = versions.with_previous(rows, ["user_id"], [F.col("ts"), F.col("event_id")], ["value"]).filter("prev_value is not null")
    changes = versions.top(old.withColumn("score", F.abs(F.col("value") - F.col("prev_value")) / 20).filter("score >= 0.82"), ["user_id"], [F.desc("score"), F.col("event_id")], 8)
    written = sinks.append(changes.select(F.col("event_id").alias("snapshot_id"), F.col("rank").alias("change_rank"), F.round("score", 4).alias("score")), sinks.new_table(spark, "changes"))
    kept = sinks.append(rows.select(F.col("event_id").alias("snapshot_id"), "user_id"), sinks.new_table(spark, "snapshots"))
    return kept.join(written, "snapshot_id", "left")


@query("select event_type, count(*) as cases, count(*) filter (where value > 10) as passed, round(count(*) filter (where value > 10) * 100.0 / count(*), 4) as percent from events group by 1")
def report_export(spark, sf_dir):
    """A run's report, written as JSON and read again."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("cases"), F.count_if(F.col("value") > 10).alias("passed"))
    return sinks.exported(rows.withColumn("percent", scoring.ratio(F.col("passed"), F.col("cases"))), sinks.new_table(spark, "report"))


@query("select page_id, trim(url) as url, length(html)::int as n, substr(html, 1, 80) as head, len(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)))::int as kinds, len(regexp_extract_all(html, '<a ')[1:60])::int as links from pages")
def debug_payloads(spark, sf_dir):
    """A compact view of each page for debugging: nested, with lists of sixty at the most."""
    view = F.struct(F.trim("url").alias("url"), F.char_length("html").alias("n"), F.substring("html", 1, 80).alias("head"), F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("kinds"), F.slice(F.regexp_extract_all("html", F.lit("<a "), F.lit(0)), 1, 60).alias("links"))
    return table(spark, sf_dir, "pages").select("page_id", view.alias("v")).select("page_id", "v.url", "v.n", "v.head", F.size("v.kinds").alias("kinds"), F.size("v.links").alias("links"))


QUALITY = (
    "with g as (select user_id, count(*) as attempted, count(*) filter (where event_type <> 'error') as pages, count(*) filter (where event_type = 'error') as failed, bool_or(event_type = 'view' and value > 12) as positioning, bool_or(event_type = 'click' and value > 12) as cta, "
    "bool_or(event_type = 'purchase' and value > 15) as pricing, bool_or(event_type = 'signup' and value > 18) as features, avg(least(value / 20, 1)) filter (where event_type <> 'error') as confidence, (sum(value) * 20)::bigint as ms from events group by 1), "
    "c as (select *, pricing::int + positioning::int + cta::int + features::int as done, case when pages = 0 then 'failed' when positioning and cta and (pricing or features) then 'useful' else 'limited' end as delivery from g), "
    "s as (select *, case when delivery = 'failed' then null else ms end as insight from c), "
    "q as (select *, greatest(0, least(100, floor(round(case delivery when 'useful' then 35.0 when 'limited' then greatest(12.0, done / 4 * 28) else 0 end + greatest(0, 25 - (4 - done) * 3 - least(8, failed)) + coalesce(confidence, 0) * 20 + case when insight is null then 0 when insight <= 1500 then 20 when insight <= 3000 then 18 when insight <= 5000 then 14 when insight <= 8000 then 8 else 3 end - least(10.0, failed * 1.5) * 0.4, 6) + 0.5)))::int as score from s) "
)


@query(
    QUALITY + "select user_id, delivery, score, case when score >= 80 then 'high' when score >= 60 then 'medium' else 'limited' end as label, case when pages = 0 or score < 55 then 'limited' when score >= 80 and failed = 0 and 4 - done <= 1 then 'complete' else 'partial' end as status, "
    "score >= 80 and not (pages = 0 or score < 55) and failed <= 1 as alerts_allowed from q"
)
def scan_quality_scores(spark, sf_dir):
    """Quality of each user's scan: usefulness, clarity, correctness and speed, with what follows for alerts."""
    kind, value = F.col("event_type"), F.col("value")
    sign = lambda t, least: F.bool_or((kind == t) & (value > least))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(kind != "error").alias("pages"), F.count_if(kind == "error").alias("failed"), sign("view", 12).alias("positioning"), sign("click", 12).alias("cta"), sign("purchase", 15).alias("pricing"), sign("signup", 18).alias("features"),
        F.avg(F.when(kind != "error", F.least(value / 20, F.lit(1.0)))).alias("confidence"), F.round(F.sum("value") * 20).cast("long").alias("ms"),
    )
    done = sum((F.col(c).cast("int") for c in quality.CRITICAL), F.lit(0))
    rows = rows.withColumns({"done": done, "delivery": quality.delivery_status(F.col("pages"), F.col("positioning"), F.col("cta"), F.col("pricing") | F.col("features"))})
    insight = F.when(F.col("delivery") != "failed", F.col("ms"))
    rows = rows.withColumn("score", quality.scan_score(F.col("delivery"), F.col("done"), 4 - F.col("done"), F.col("failed"), F.coalesce("confidence", F.lit(0.0)), insight))
    rows = rows.withColumn("status", quality.completeness(F.col("score"), F.col("pages"), F.col("failed"), 4 - F.col("done")))
    return rows.select("user_id", "delivery", "score", scoring.quality_label(F.col("score")).alias("label"), "status", ((F.col("score") >= 80) & (F.col("status") != "limited") & (F.col("failed") <= 1)).alias("alerts_allowed"))


STAGE = "['fetch', 'discovery', 'extraction', 'scoring', 'render'][(event_id % 5 + 1)::int]"


@query(
    f"with s as (select user_id, {STAGE} as stage, value * 150 as ms from events), t as (select *, ms > case when stage in ('scoring', 'render') then 1000 else 2000 end as late from s) "
    "select user_id, round(sum(ms) filter (where stage in ('discovery', 'fetch', 'extraction')), 2) as insight_ms, count(*) filter (where late) as over_budget, string_agg(distinct stage, ',' order by stage) filter (where late) as late_stages from t group by 1"
)
def stage_metrics(spark, sf_dir):
    """Time to the first insight of each user, and stages that took longer than they may."""
    stage = F.get(F.array(*[F.lit(n) for n, _ in quality.BUDGETS]), (F.col("event_id") % 5).cast("int"))
    rows = table(spark, sf_dir, "events").select("user_id", stage.alias("stage"), (F.col("value") * 150).alias("ms"))
    rows = rows.withColumn("late", quality.over_budget(F.col("stage"), F.col("ms")))
    late = F.array_sort(F.collect_set(F.when(F.col("late"), F.col("stage"))))
    return rows.groupBy("user_id").agg(F.round(F.sum(F.when(F.col("stage").isin("discovery", "fetch", "extraction"), F.col("ms"))), 2).alias("insight_ms"), F.count_if("late").alias("over_budget"), F.when(F.size(late) > 0, F.array_join(late, ",")).alias("late_stages"))


CASES = (
    "with c as (select d.doc_id, d.source, n_chars, coalesce(quality, 0) as q, coalesce(toxic, 1) as t, l.doc_id is not null as labelled from documents d left join labels l using (doc_id)), s as (select *, case when labelled and t = 0 then 'pass' when labelled then 'partial' else 'fail' end as status, case when n_chars > 600 then 'found' else 'weak' end as pricing, "
    "case when q = 1 then 'useful' else 'weak' end as positioning, case when n_chars % 2 = 0 then 'useful' else 'weak' end as cta, case when n_chars % 3 = 0 then 'useful' else 'weak' end as features from c) "
)


def _cases(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("labelled"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(labels, "doc_id", "left")
    useful = lambda x: F.when(x, "useful").otherwise("weak")
    return rows.select(
        "doc_id", "source", "n_chars", F.when(F.col("labelled") & (F.coalesce("toxic", F.lit(1)) == 0), "pass").when(F.col("labelled"), "partial").otherwise("fail").alias("status"), F.when(F.col("n_chars") > 600, "found").otherwise("weak").alias("pricing"),
        useful(F.coalesce("quality", F.lit(0)) == 1).alias("positioning"), useful(F.col("n_chars") % 2 == 0).alias("cta"), useful(F.col("n_chars") % 3 == 0).alias("features"),
    )


@query(
    CASES + "select doc_id, status, round(case status when 'pass' then 2 when 'partial' then 1 else 0 end + case when pricing = 'found' then 1.5 else 0 end + case when positioning = 'useful' then 1.5 else 0 end + case when cta = 'useful' then 1 else 0 end + case when features = 'useful' then 1 else 0 end "
    "+ case when status <> 'fail' then 1 else 0 end + case when n_chars > 400 then 1 else 0.5 end + case when n_chars < 3000 then 1 when n_chars < 8000 then 0.5 else 0 end, 1)::double as value, "
    "concat_ws(';', case when pricing = 'weak' then 'Pricing' end, case when positioning = 'weak' then 'Positioning' end, case when cta = 'weak' then 'CTA' end, case when features = 'weak' then 'Features' end, case when status = 'fail' then 'No baseline' end) as failures from s"
)
def validation_cases(spark, sf_dir):
    """A report of each validation case: its value to a user, and every signal that failed."""
    rows = _cases(spark, sf_dir)
    value = quality.user_value(F.col("status"), F.col("pricing"), F.col("positioning"), F.col("cta"), F.col("features"), F.when(F.col("status") != "fail", "useful").otherwise("weak"), F.when(F.col("n_chars") > 400, "complete").otherwise("partial"), F.col("n_chars"))
    failures = F.concat_ws(";", *[F.when(F.col(c) == "weak", n) for c, n in (("pricing", "Pricing"), ("positioning", "Positioning"), ("cta", "CTA"), ("features", "Features"))], F.when(F.col("status") == "fail", "No baseline"))
    return rows.select("doc_id", "status", value.alias("value"), failures.alias("failures"))


@query(
    CASES + "select source, count(*) as cases, round(greatest(0, least(100, 100 - (82 + 100 - count(*) filter (where positioning = 'weak' or cta = 'weak' or n_chars > 8000) * 100.0 / count(*)) / 2)), 2)::double as friction, "
    "round((count(*) filter (where status = 'pass') * 100.0 / count(*) + count(*) filter (where positioning = 'useful' and cta = 'useful' and features <> 'weak') * 100.0 / count(*)) / 2, 2)::double as attention, count(*) filter (where status = 'fail') as rerun from s group by 1"
)
def evaluation_scores(spark, sf_dir):
    """Composite scores of each source's cases, and how many would run again."""
    useful = lambda c: F.col(c) == "useful"
    weak = (F.col("positioning") == "weak") | (F.col("cta") == "weak") | (F.col("n_chars") > 8000)
    rows = _cases(spark, sf_dir).groupBy("source").agg(F.count("*").alias("cases"), F.count_if(weak).alias("_weak"), F.count_if(F.col("status") == "pass").alias("_pass"), F.count_if(useful("positioning") & useful("cta") & useful("features")).alias("_good"), F.count_if(F.col("status") == "fail").alias("rerun"))
    attention = F.round((F.col("_pass") * 100.0 / F.col("cases") + F.col("_good") * 100.0 / F.col("cases")) / 2, 2)
    return rows.select("source", "cases", quality.friction(F.lit(82.0), F.col("_weak"), F.col("cases")).alias("friction"), attention.alias("attention"), "rerun")


@query(
    "with m as (select o_custkey as name, date_trunc('month', o_orderdate) as run, count(*) as facts, round(sum(o_totalprice), 2) as total from orders group by 1, 2), r as (select *, row_number() over (partition by name order by run desc) as n from m) "
    "select a.name, a.run, a.facts, b.facts as previous_facts, b.name is null as first_run, coalesce(a.facts > b.facts, false) as improved from r a left join r b on a.name = b.name and b.n = 2 where a.n = 1"
)
def followup_reports(spark, sf_dir):
    """The newest report of each name beside the one before it."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("name"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("run")).agg(F.count("*").alias("facts"))
    rows = versions.with_previous(rows, ["name"], [F.col("run")], ["facts"])
    rows = versions.latest(rows, ["name"], [F.desc("run")])
    return rows.select("name", "run", "facts", F.col("prev_facts").alias("previous_facts"), F.col("is_first").alias("first_run"), F.coalesce(F.col("facts") > F.col("prev_facts"), F.lit(False)).alias("improved"))


@query(
    "select o_orderkey as change_id, n_name as competitor, c_custkey as user_id from orders join customer on o_custkey = c_custkey join nation on n_nationkey = c_nationkey where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus <> 'F' and c_acctbal > 0 and o_totalprice / 500000 >= 0.72"
)
def pending_notifications(spark, sf_dir):
    """Trusted changes that still have to be told: change, page owner and competitor must all be there, and the gate open."""
    people = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_nationkey")
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("competitor"))
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") != "F") & scoring.trusted(F.col("o_totalprice") / 500000)
    changes = table(spark, sf_dir, "orders").filter(urgent).select(F.col("o_orderkey").alias("change_id"), F.col("o_custkey").alias("c_custkey"))
    return changes.join(people, "c_custkey").join(F.broadcast(names), "c_nationkey").select("change_id", "competitor", F.col("c_custkey").alias("user_id"))


@query(
    "with r as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) select c_custkey, n_name as nation, count(o_orderkey) as changes, max(o_orderkey) filter (where n = 1) as newest, string_agg(o_orderkey::varchar, ',' order by n) filter (where n <= 5) as last_five "
    "from customer join nation on n_nationkey = c_nationkey left join r on o_custkey = c_custkey group by 1, 2"
)
def competitor_details(spark, sf_dir):
    """What a competitor's page shows: its group, changes, newest version and last five entries."""
    ranked = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("n"))
    five = F.array_sort(F.collect_list(F.when(F.col("n") <= 5, F.struct("n", "o_orderkey"))))
    rows = ranked.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("changes"), F.max(F.when(F.col("n") == 1, F.col("o_orderkey"))).alias("newest"), five.alias("_f"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(names), "c_nationkey")
    last = F.array_join(F.transform("_f", lambda x: x["o_orderkey"].cast("string")), ",")
    return people.join(rows, "c_custkey", "left").select("c_custkey", "nation", F.coalesce("changes", F.lit(0)).alias("changes"), "newest", last.alias("last_five"))


FALLBACK = ("/pricing", "/plans", "/features", "/changelog", "/docs")
DISCOVERED = (
    "with u as (select page_id, lower(regexp_extract(trim(url), '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(trim(url), '^[^:]*://([^/?#]*)', 1)) as origin, html from pages), h as (select origin, min_by(html, page_id) as html from u group by 1), "
    "l as (select origin, unnest(regexp_extract_all(html, '<a href=\"(/[^\"#?]*)\"', 1)) as path from h), c as (select origin, regexp_replace(path, '/+$', '') as path, 1 as source from l union all "
    + " union all ".join(f"select distinct origin, '{p}', 3 from u" for p in FALLBACK)
    + "), m as (select origin, path, min(source) as source from c where path <> '' group by 1, 2), "
    "t as (select *, case when regexp_matches(path, '(?i)(pricing|plans?|billing|subscriptions?)') then 'pricing' when regexp_matches(path, '(?i)(changelog|release|updates?|whats-new)') then 'changelog' when regexp_matches(path, '(?i)(features?|products?|solutions?|platform)') then 'features' when regexp_matches(path, '(?i)(docs?|help|guides?|support)') then 'docs' else 'other' end as page_type from m), "
    "r as (select *, row_number() over (partition by origin, page_type order by source, path) as n from t) "
)


def _candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", urls.origin(F.col("url")).alias("origin"), "html")
    home = rows.groupBy("origin").agg(F.min_by("html", "page_id").alias("html"))
    linked = home.select("origin", F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"#?]*)"'), F.lit(1))).alias("path"), F.lit(1).alias("source"))
    spare = home.select("origin", F.explode(F.array(*[F.lit(p) for p in FALLBACK])).alias("path"), F.lit(3).alias("source"))
    every = linked.unionByName(spare).withColumn("path", F.regexp_replace("path", "/+$", "")).filter("path <> ''")
    every = every.groupBy("origin", "path").agg(F.min("source").alias("source"))
    return every.withColumn("page_type", urls.path_type(F.concat("origin", "path")))


@query(DISCOVERED + "select origin, page_type, n::int as rank, path, source from r where n <= case when page_type = 'pricing' then 3 else 2 end")
def discovered_pages(spark, sf_dir):
    """Pages worth fetching of each origin: the homepage's links before usual paths, each once, a quota for each type."""
    rows = versions.top(_candidates(spark, sf_dir), ["origin", "page_type"], [F.col("source"), F.col("path")], 3)
    return rows.filter((F.col("rank") <= 2) | (F.col("page_type") == "pricing")).select("origin", "page_type", "rank", "path", "source")


@query(
    DISCOVERED + ", b as (select * from r where n = 1 and source = 1), d as (select distinct origin, unnest(['pricing', 'features', 'changelog']) as page_type from u) select d.origin, d.page_type, coalesce(b.path, '/' || d.page_type) as path, b.path is not null as discovered from d left join b using (origin, page_type)"
)
def baseline_pages(spark, sf_dir):
    """The pages that a new entity is watched at: the one found for each type, else the usual path."""
    found = versions.latest(_candidates(spark, sf_dir).filter("source = 1"), ["origin", "page_type"], [F.col("path")]).select("origin", "page_type", F.col("path").alias("found"))
    wanted = table(spark, sf_dir, "pages").select(urls.origin(F.col("url")).alias("origin")).distinct().withColumn("page_type", F.explode(F.array(*[F.lit(t) for t in ("pricing", "features", "changelog")])))
    rows = wanted.join(found, ["origin", "page_type"], "left")
    return rows.select("origin", "page_type", F.coalesce("found", F.concat(F.lit("/"), F.col("page_type"))).alias("path"), F.col("found").isNotNull().alias("discovered"))


@query(
    "with b as (select page_id, lower(regexp_extract(trim(url), '^[^:]*://([^/?#]*)', 1)) as site, page_id % 4 as k, length(html) as n from pages), p as (select site, min(page_id) filter (where k = 2 and n > 2000) as verified, list(page_id order by page_id) filter (where k = 0) as blocked, list(page_id order by page_id) filter (where k = 1) as missing from b group by 1) "
    "select site, verified, coalesce(len(list_filter(blocked, lambda x: verified is null or x < verified)), 0)::int as blocked, coalesce(len(list_filter(missing, lambda x: verified is null or x < verified)), 0)::int as missing from p"
)
def page_bundles(spark, sf_dir):
    """Candidates probed in order until one is verified, with those found blocked and missing on the way."""
    kind, mine = F.col("page_id") % 4, F.lower(F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1)).alias("site")
    rows = table(spark, sf_dir, "pages").select(mine, "page_id", kind.alias("k"), F.char_length("html").alias("n"))
    first = rows.groupBy("site").agg(F.min(F.when((F.col("k") == 2) & (F.col("n") > 2000), F.col("page_id"))).alias("verified"), F.count("*").alias("_pages"))
    rows = versions.attached(rows, sinks.stored(first, "first-pages"), "site", "_pages").withColumn("probed", F.col("verified").isNull() | (F.col("page_id") < F.col("verified")))
    return rows.groupBy("site").agg(F.first("verified").alias("verified"), F.count_if(F.col("probed") & (F.col("k") == 0)).cast("int").alias("blocked"), F.count_if(F.col("probed") & (F.col("k") == 1)).cast("int").alias("missing"))


@query(
    "with e as (select event_id, event_type <> 'error' as ok, user_id % 3 = 0 as moved, [null, 404, 403, 503, null, null, null, null][(event_id % 8 + 1)::int] as status, ['', '', '', '', 'Timeout of 8 s', 'getaddrinfo failed', 'bad certificate', 'odd'][(event_id % 8 + 1)::int] as error, ['pricing', 'features', 'docs'][(event_id % 3 + 1)::int] as page_type from events) "
    "select event_id, case when ok and moved then 'redirected' when ok then 'live' else case event_id % 8 when 0 then 'unknown_error' when 1 then 'not_found' when 2 then 'blocked' when 3 then 'server_error' when 4 then 'timeout' when 5 then 'dns_error' when 6 then 'ssl_error' else 'inaccessible' end end as state, "
    "case page_type when 'pricing' then 'high' when 'features' then 'medium' else 'low' end as relevance from e"
)
def availability_states(spark, sf_dir):
    """The state of each fetched address and how much its page matters."""
    pick = lambda values, n, t: F.get(F.array(*[F.lit(v).cast(t) for v in values]), (F.col("event_id") % n).cast("int"))
    status = pick((None, 404, 403, 503, None, None, None, None), 8, "int")
    error = pick(("", "", "", "", "Timeout of 8 s", "getaddrinfo failed", "bad certificate", "odd"), 8, "string")
    page = pick(("pricing", "features", "docs"), 3, "string")
    return table(spark, sf_dir, "events").select("event_id", quality.availability(F.col("event_type") != "error", F.col("user_id") % 3 == 0, status, error).alias("state"), quality.relevance(page).alias("relevance"))


@query(
    "with f as (select o_custkey, count(*) filter (where o_totalprice > 300000) as high, count(*) filter (where o_totalprice between 150000 and 300000) as medium, least(100, count(*) * 5) as homepage, least(100, count(distinct o_orderpriority) * 20) as pricing, least(100, count(distinct o_orderstatus) * 33) as features, bool_or(o_orderstatus = 'P') as cta from orders group by 1) "
    "select o_custkey, case when high >= 3 then 'high' when high + medium >= 3 then 'medium' else 'low' end as confidence, floor((homepage + pricing + features + case when cta then 80 else 20 end) / 4 + 0.5)::int as completeness, "
    "concat_ws(';', case when pricing < 60 then 'No public pricing' end, case when not cta then 'No clear CTA' end, case when features < 99 then 'Few features' end) as not_detected from f"
)
def profile_confidence(spark, sf_dir):
    """How sure and how complete each profile is, and what wasn't detected."""
    price = F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_if(price > 300000).alias("high"), F.count_if(price.between(150000, 300000)).alias("medium"), F.least(F.lit(100), F.count("*") * 5).alias("homepage"), F.least(F.lit(100), F.count_distinct("o_orderpriority") * 20).alias("pricing"),
        F.least(F.lit(100), F.count_distinct("o_orderstatus") * 33).alias("features"), F.bool_or(F.col("o_orderstatus") == "P").alias("cta"),
    )
    missing = F.concat_ws(";", F.when(F.col("pricing") < 60, "No public pricing"), F.when(~F.col("cta"), "No clear CTA"), F.when(F.col("features") < 99, "Few features"))
    return rows.select("o_custkey", quality.count_confidence(F.col("high"), F.col("medium")).alias("confidence"), quality.mean_completeness(F.col("homepage"), F.col("pricing"), F.col("features"), F.col("cta")).alias("completeness"), missing.alias("not_detected"))


@query(
    "with b as (select s_nationkey, s_suppkey, s_acctbal, row_number() over (partition by s_nationkey order by case when s_suppkey % 4 = 0 then 0 when s_suppkey % 4 = 1 then 1 else 2 end, s_suppkey) as n, s_suppkey % 4 as kind from supplier) select s_nationkey as entity_id, s_suppkey as page_id, kind in (0, 1) as preferred from b where n = 1"
)
def profile_pages(spark, sf_dir):
    """The page that speaks for each entity: a homepage, else a page with plans, else the first."""
    rank = F.when(F.col("s_suppkey") % 4 == 0, 0).when(F.col("s_suppkey") % 4 == 1, 1).otherwise(2)
    rows = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("entity_id")).agg(F.min(F.struct(rank.alias("r"), "s_suppkey")).alias("p"))
    return rows.select("entity_id", F.col("p.s_suppkey").alias("page_id"), (F.col("p.r") < 2).alias("preferred"))


@query(
    "with f as (select o_custkey as user_id, bool_or(o_orderpriority = '1-URGENT') as price, bool_or(o_orderstatus = 'P') as cta, bool_or(o_totalprice > 350000) as audience from orders group by 1), r as (select user_id, unnest([case when not price then 'pricing' end, case when not cta then 'cta' end, case when not audience then 'positioning' end]) as rule from f) select user_id, rule from r where rule is not null"
)
def baseline_rules(spark, sf_dir):
    """What to recommend from one's own facts alone: pricing, call to action, positioning."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("price"), F.bool_or(F.col("o_orderstatus") == "P").alias("cta"), F.bool_or(F.col("o_totalprice") > 350000).alias("audience"))
    return recommend.baseline(rows, {"pricing": ~F.col("price"), "cta": ~F.col("cta"), "positioning": ~F.col("audience")})


@query(
    "with s as (select s_nationkey as user_id, count(*) as others, count(*) filter (where s_acctbal > 0) as public, count(*) filter (where s_acctbal > 5000) as trial, count(*) filter (where s_suppkey % 3 = 0) as audience from supplier group by 1), r as (select user_id, others, unnest(['pricing_visibility', 'cta', 'positioning']) as rule, unnest([public, trial, audience]) as supporters from s), "
    "k as (select *, least(96, floor(round(48 + least(supporters, 4) * 9 + 0.8 * 14 + 0.8 * 20, 6) + 0.5))::int as confidence from r where supporters >= 2) "
    "select user_id, rule, supporters, confidence, supporters || ' of ' || others || ' competitors' as compared, confidence >= 75 and least(0.94, 0.54 + 2 * 0.12 + supporters * 0.06) >= 0.6 as shown from k"
)
def competitive_rules(spark, sf_dir):
    """What to recommend because enough competitors do it: pricing, call to action, positioning, behind the final gate."""
    some = lambda c: F.count_if(c)
    rows = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("user_id")).agg(F.count("*").alias("others"), some(F.col("s_acctbal") > 0).alias("pricing_visibility"), some(F.col("s_acctbal") > 5000).alias("cta"), some(F.col("s_suppkey") % 3 == 0).alias("positioning"))
    rows = recommend.by_rule(rows, ["pricing_visibility", "cta", "positioning"])
    sure = recommend.confidence(F.col("supporters"), F.lit(0.8), F.lit(0.8))
    new = recommend.novelty(F.col("rule"), F.lit(2), F.col("supporters"))
    return rows.select("user_id", "rule", "supporters", sure.alias("confidence"), F.concat(F.col("supporters").cast("string"), F.lit(" of "), F.col("others").cast("string"), F.lit(" competitors")).alias("compared"), recommend.passes(sure, F.lit(60), new, F.lit(35)).alias("shown"))


@query("select user_id, round(sum(floor(value * 100)) * 0.0002, 4) as cost, sum(floor(value * 100))::bigint as tokens, sum(floor(value * 100)) >= 400000 as over_limit from events where ts >= (select date_trunc('month', max(ts)) from events) group by 1")
def month_tokens(spark, sf_dir):
    """Tokens of each user since the month began, their cost, and whether the limit is reached."""
    rows = table(spark, sf_dir, "events")
    month = rows.agg(F.date_trunc("month", F.max("ts")).cast("timestamp_ntz").alias("_m"))
    rows = rows.join(F.broadcast(month), F.col("ts") >= F.col("_m")).groupBy("user_id").agg(F.sum(F.floor(F.col("value") * 100)).alias("tokens"))
    return rows.select("user_id", F.round(F.col("tokens") * usage.TOKEN_COST, 4).alias("cost"), "tokens", (F.col("tokens") >= usage.MONTHLY_TOKENS).alias("over_limit"))


@query("select event_id, value * 5 >= 80 and event_type <> 'error' and value / 20 >= 0.72 and user_id % 3 > 0 as alerts from events")
def alert_decisions(spark, sf_dir):
    """Whether each change alerts anybody: good scan, trusted, more than a low severity."""
    level = F.when(F.col("user_id") % 3 == 0, "low").when(F.col("user_id") % 3 == 1, "medium").otherwise("high")
    return table(spark, sf_dir, "events").select("event_id", scoring.alerts(F.col("value") * 5, F.col("event_type") == "error", F.col("value") / 20, level).alias("alerts"))


CACHED = (
    "with recursive f as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events), "
    "c as (select event_id, user_id, event_type, n, ts as fetched, false as cached from f where n = 1 "
    "union all select f.event_id, f.user_id, f.event_type, f.n, case when f.ts - c.fetched < interval 6 hours then c.fetched else f.ts end, f.ts - c.fetched < interval 6 hours from f join c on f.user_id = c.user_id and f.event_type = c.event_type and f.n = c.n + 1) "
    "select event_id, cached from c"
)


@query(CACHED)
def cached_fetches(spark, sf_dir):
    """Whether each fetch finds an answer that was fetched less than six hours ago; hits don't renew it."""
    return cache.ttl_hits(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", "6 HOURS").select("event_id", "cached")
