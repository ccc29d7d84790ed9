"""Queries that roll facts up, merge duplicates, look pages up and compare runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions import urls
from tidepool.operators import display, rollups, scoring, sinks, versions
from tidepool.plans.registry import query, table
from tidepool.plans.web import URL_PARTS


@query(
    "with f as (select l_suppkey, l_shipmode_ as v, min(l_linenumber * 100000000 + l_orderkey) as pos, max(l_quantity) as s, count(*) as n from (select *, l_returnflag || l_linestatus as l_shipmode_ from lineitem) group by 1, 2) "
    "select l_suppkey as entity_id, array_to_string(list_slice(list(v order by pos, v), 1, 3), ',') as first_values, max(s) as best, sum(n)::bigint as facts from f group by 1"
)
def entity_profile(spark, sf_dir):
    """Profile of each supplier: its first distinct values, best score and number of facts."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("v"), (F.col("l_linenumber") * F.lit(100000000).cast("long") + F.col("l_orderkey")).alias("at"), "l_quantity")
    rows = rollups.profile(rows, "l_suppkey", "at", "v", "l_quantity", 3)
    return rows.select(F.col("l_suppkey").alias("entity_id"), F.array_join("values", ",").alias("first_values"), "best", "facts")


@query("select o_custkey as owner, o_orderpriority as kind, min_by(o_totalprice, o_orderkey) as price, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as evidence from orders group by 1, 2")
def merged_duplicates(spark, sf_dir):
    """Orders of one owner and kind as one row, with the first one's price and all ids as evidence."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("kind"), "o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderkey").cast("string").alias("evidence"))
    return rollups.merged(rows, ["owner", "kind"], "o_orderkey", "evidence", ["price"]).select("owner", "kind", "price", F.array_join("evidence", ",").alias("evidence"))


@query("select o_custkey as owner, max_by(o_orderstatus, o_orderkey) as status, min(o_orderkey) as place from orders group by 1")
def last_value_first_place(spark, sf_dir):
    """The last status of each owner at the place of the first."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("place"), F.col("o_orderstatus").alias("status"))
    return versions.last_value_first_place(rows, ["owner"], "place", "status")


@query("""select page_id, sha256('{"page_id":' || page_id::varchar || ',"hash":"' || sha256(html) || '"}') as cache_key from pages""")
def content_cache_key(spark, sf_dir):
    """The key under which an answer about a page's content is kept."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("hash"))
    return rows.select("page_id", rollups.cache_key(F.col("page_id"), F.col("hash")).alias("cache_key"))


@query("with s as (select s_suppkey, s_name, row_number() over (order by s_suppkey) - 1 as i, count(*) over () as n from supplier), r as (select s_suppkey, s_name, ((i - 7) % n + n) % n + 1 as place from s) select s_suppkey as entity_id, place::int as place from r where place <= 5")
def rotated_examples(spark, sf_dir):
    """Five examples of a pool that is turned on each week, in week seven."""
    return rollups.rotated(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id")), "entity_id", 7, 5)


@query("select s_suppkey as owner, p.page_type, 'https://s' || s_suppkey::varchar || '.test' || p.path as page_url from supplier, (values ('homepage', ''), ('pricing', '/pricing'), ('features', '/features'), ('changelog', '/changelog')) as p(page_type, path)")
def default_pages(spark, sf_dir):
    """The pages that are watched by default."""
    owners = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("owner"), F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".test")).alias("base"))
    return rollups.default_pages(owners, "base").select("owner", "page_type", "page_url")


@query("select trim(regexp_replace(lower(event_type || ' ' || (event_id % 7)::varchar || ' failed'), '\\d+', '#', 'g')) as kind, count(*) as failures from events where event_type in ('error', 'signup') group by 1 order by failures desc, kind limit 25")
def failure_histogram(spark, sf_dir):
    """The most frequent kinds of failures."""
    message = F.concat_ws(" ", "event_type", (F.col("event_id") % 7).cast("string"), F.lit("failed"))
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "signup")).groupBy(rollups.failure_kind(message).alias("kind"))
    return rows.agg(F.count("*").alias("failures")).orderBy(F.desc("failures"), "kind").limit(25)


@query(
    "with l as (select o_custkey as customer, max_by(o_orderstatus, o_orderkey) as s, max_by(o_orderpriority, o_orderkey) as p from orders group by 1) "
    "select customer, case when s in ('O', 'P') then case when p in ('1-URGENT', '2-HIGH') then 'business' else 'pro' end else 'free' end as plan from l"
)
def subscription_plans(spark, sf_dir):
    """The plan that each customer's newest subscription event leaves."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("s"), F.max_by("o_orderpriority", "o_orderkey").alias("p"))
    status = F.when(F.col("s") == "O", "active").when(F.col("s") == "P", "trialing").otherwise("canceled")
    return rows.select("customer", rollups.subscribed_plan(status, F.when(F.col("p").isin("1-URGENT", "2-HIGH"), "business").otherwise("pro")).alias("plan"))


@query(
    f"with {URL_PARTS}, t as (select page_id, regexp_replace(host, '^(www|m)\\.', '') as site, sha256(regexp_replace(html, '<[^>]*>', '', 'g')) as h, length(html) as n from canon), "
    "home as (select site, min_by(page_id, (n, page_id)) as home_id from t group by 1) select t.page_id, home.home_id, t.h = b.h as same_text from t join home using (site) join t b on b.page_id = home.home_id where t.page_id <> home.home_id"
)
def homepage_siblings(spark, sf_dir):
    """Each page with its site's homepage (the shortest page) and whether both say the same."""
    rows = table(spark, sf_dir, "pages").select("page_id", urls.site(F.col("url")).alias("site"), F.sha2(F.regexp_replace("html", "<[^>]*>", ""), 256).alias("h"), F.char_length("html").alias("n"))
    home = rows.groupBy("site").agg(F.min_by(F.struct("page_id", "h"), F.struct("n", "page_id")).alias("_h"), F.count("*").alias("_pages")).select("site", F.col("_h.page_id").alias("home_id"), F.col("_h.h").alias("_hh"), "_pages")
    return versions.attached(rows, sinks.stored(home, "homes"), "site", "_pages").filter("page_id <> home_id").select("page_id", "home_id", (F.col("h") == F.col("_hh")).alias("same_text"))


@query(
    "with t as (select page_id, lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1) as labels from pages) "
    "select page_id, list_filter(labels, lambda x: x <> '' and contains(title, lower(x)))[1] as label from t"
)
def evidence_label(spark, sf_dir):
    """The first link text of each page that its title holds: a contains join inside the page's own arrays."""
    title = F.lower(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    rows = table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1)).alias("labels"))
    return rows.select("page_id", F.get(F.filter("labels", lambda x: (x != "") & F.contains(F.col("title"), F.lower(x))), F.lit(0)).alias("label"))


@query(
    "with x as (select l_orderkey, list(distinct l_partkey % 10) as x from lineitem where l_returnflag <> 'R' group by 1), y as (select l_orderkey, list(distinct l_suppkey % 10) as y from lineitem where l_quantity > 40 group by 1) "
    "select y.l_orderkey as page_id, len(list_filter(y, lambda v: not list_contains(coalesce(x, []), v)))::int as outside, len(list_filter(y, lambda v: not list_contains(coalesce(x, []), v))) = 0 as holds, case when len(list_filter(y, lambda v: not list_contains(coalesce(x, []), v))) > 0 then 'blocked' else 'shown' end as status from y left join x using (l_orderkey)"
)
def displayed_within_accepted(spark, sf_dir):
    """How many displayed values of each page weren't accepted, and whether there are none: two sets of their own."""
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "page_id")
    accepted = rows.filter("l_returnflag <> 'R'").groupBy("page_id").agg(F.collect_set(F.col("l_partkey") % 10).alias("x"))
    shown = rows.filter("l_quantity > 40").groupBy("page_id").agg(F.collect_set(F.col("l_suppkey") % 10).alias("y"))
    taken = F.coalesce("x", F.array().cast("array<bigint>"))
    outside = F.size(F.array_except("y", taken))
    return shown.join(accepted, "page_id", "left").select("page_id", outside.alias("outside"), (outside == 0).alias("holds"), display.display_status(taken, F.col("y")).alias("status"))


@query(
    "with u as (select 1 as ord, o_custkey as owner, o_orderstatus as warning from orders union all select 2, o_custkey, o_orderpriority from orders where o_orderpriority <> '5-LOW'), "
    "d as (select owner, warning, min(ord) as ord from u group by 1, 2) select owner, string_agg(warning, ';' order by ord, warning) as warnings from d group by 1"
)
def distinct_warnings(spark, sf_dir):
    """Warnings of two sources in one list, each once."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), "o_orderstatus", "o_orderpriority")
    first = orders.select("owner", F.col("o_orderstatus").alias("warning"), F.lit(1).alias("ord"))
    rows = first.unionByName(orders.filter("o_orderpriority <> '5-LOW'").select("owner", F.col("o_orderpriority").alias("warning"), F.lit(2).alias("ord")))
    rows = rows.groupBy("owner", "warning").agg(F.min("ord").alias("ord")).groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("ord", "warning"))).alias("_w"))
    return rows.select("owner", F.array_join(F.transform("_w", lambda x: x["warning"]), ";").alias("warnings"))


@query(
    "with a as (select o_custkey as page_id, count(*) as n, max(o_totalprice) as top from orders where o_orderstatus <> 'F' group by 1), b as (select o_custkey as page_id, count(*) as n, max(o_totalprice) as top from orders where o_orderstatus <> 'P' group by 1) "
    "select coalesce(a.page_id, b.page_id) as page_id, coalesce(a.n, 0) as old_facts, coalesce(b.n, 0) as new_facts, a.top is distinct from b.top as differs, a.n is not null and b.n is null as dangerous from a full join b using (page_id)"
)
def shadow_compare(spark, sf_dir):
    """Two analyses side by side: facts of each, whether they differ, whether the new one lost everything."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), "o_orderstatus", "o_totalprice")
    side = lambda other, p: orders.filter(F.col("o_orderstatus") != other).groupBy("page_id").agg(F.count("*").alias(f"{p}_n"), F.max("o_totalprice").alias(f"{p}_top"))
    rows = side("F", "old").join(side("P", "new"), "page_id", "full_outer")
    return rows.select(
        "page_id", F.coalesce("old_n", F.lit(0)).alias("old_facts"), F.coalesce("new_n", F.lit(0)).alias("new_facts"), (~F.col("old_top").eqNullSafe(F.col("new_top"))).alias("differs"), (F.col("old_n").isNotNull() & F.col("new_n").isNull()).alias("dangerous")
    )


@query("select conv_id, max(turn) filter (where role = 'user') as last_user_turn, count(*) filter (where role = 'assistant') as answers, arg_min(text, turn) = arg_max(text, turn) as first_is_last from conversations group by 1")
def conversation_rollup(spark, sf_dir):
    """Each conversation as one row."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("last_user_turn"), F.count_if(F.col("role") == "assistant").alias("answers"), (F.min_by("text", "turn") == F.max_by("text", "turn")).alias("first_is_last")
    )


@query("select count(*) as checked, count(*) filter (where o_orderstatus = 'F') as failed, count(*) filter (where o_orderstatus = 'P') as deferred, count(distinct o_custkey) as owners, round(count(*) filter (where o_orderstatus <> 'F') * 100.0 / count(*), 4) as success_percent from orders")
def scan_outcomes(spark, sf_dir):
    """Counters of a run, in one pass."""
    status = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").agg(F.count("*").alias("checked"), F.count_if(status == "F").alias("failed"), F.count_if(status == "P").alias("deferred"), F.count_distinct("o_custkey").alias("owners"))
    return rows.withColumn("success_percent", scoring.ratio(F.col("checked") - F.col("failed"), F.col("checked")))
