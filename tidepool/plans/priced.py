"""Queries over price pages made of the parts table: eight parts a page, as a table, as cards or as a script's array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators import display, extract, structured
from tidepool.plans.registry import query, table
from tidepool.sources import html

#: DuckDB's side of the pages' plans.
PARTS = (
    "parts as (select p_partkey // 8 as page_id, (p_partkey // 8) % 3 as shape, p_partkey, p_name || ' ' || p_partkey as plan, case when p_partkey % 8 = 7 and (p_partkey // 8) % 3 <> 2 then null else round(p_retailprice, 2) end as price, "
    "case when p_partkey % 8 = 7 and (p_partkey // 8) % 3 <> 2 then null when p_partkey % 2 = 0 then 'USD' else 'EUR' end as currency, case when p_partkey % 8 = 7 and (p_partkey // 8) % 3 <> 2 then 'unknown' when p_size % 2 = 0 then 'month' else 'year' end as billing_period, "
    "case when (p_partkey // 8) % 3 = 2 then '' else p_size || ' projects' end as limits from part)"
)


def _pages(spark, sf_dir) -> DataFrame:
    page = F.floor(F.col("p_partkey") / 8)
    amount = F.format_string("%.2f", "p_retailprice")
    sign = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("$"), amount)).otherwise(F.concat(F.lit("€"), amount))
    per = F.when(F.col("p_size") % 2 == 0, "month").otherwise("year")
    asked = F.col("p_partkey") % 8 == 7
    said = F.when(asked, "Contact sales").otherwise(F.concat(sign, F.lit(" per "), per))
    name, limit = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")), F.concat(F.col("p_size").cast("string"), F.lit(" projects"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    row = say("<tr><td>", name, "</td><td>", said, "</td><td>", limit, "</td></tr>")
    card = say('<article class="plan-card"><h3>', name, "</h3><p>", said, "</p><ul><li>", limit, "</li></ul><button>Get started</button></article>")
    entry = say('{"name":"', name, '","price":', amount, ',"currency":"', F.when(F.col("p_partkey") % 2 == 0, "usd").otherwise("eur"), '","period":"', per, '"}')
    rows = table(spark, sf_dir, "part").select(page.alias("page_id"), "p_partkey", F.when(page % 3 == 0, row).when(page % 3 == 1, card).otherwise(entry).alias("part"))
    #: Eight parts a page, whatever the table holds.
    whole = rows.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "part"))), lambda x: x["part"]).alias("p"))
    shape = F.col("page_id") % 3
    body = (
        F.when(shape == 0, say("<table><tr><th>Plan</th><th>Price</th><th>Limits</th></tr>", F.array_join("p", ""), "</table>"))
        .when(shape == 1, say('<section class="pricing">', F.array_join("p", ""), "</section>")).otherwise(say("<p>Choose below</p><script>var plans = [", F.array_join("p", ","), "];</script>"))
    )
    noise = '<nav><a href="/login">Log in</a></nav><article class="testimonial"><p>This tool saved our team $2,500 a month</p></article><footer><p>Copyright $1</p></footer>'
    markup = say("<html><head><title>Plans of ", F.col("page_id").cast("string"), "</title></head><body>", body, noise, "</body></html>")
    return whole.select("page_id", F.concat(F.lit("https://p"), F.col("page_id").cast("string"), F.lit(".example.com/pricing")).alias("url"), F.lit("pricing").alias("page_type"), F.lit(200).alias("status_code"), markup.alias("html"))


@query(f"with {PARTS} select page_id, plan, price, currency, billing_period, limits, case shape when 0 then 'table' when 1 then 'card' else 'script' end as source, case when price is null then 'contact' else 'flat' end as mode from parts")
def structured_plans(spark, sf_dir):
    """Plans of tables, cards and script arrays: name, price, currency, period, limits, mode, where they stood."""
    rows = structured.plans(_pages(spark, sf_dir))
    return rows.select("page_id", "plan", "price", "currency", "billing_period", F.array_join("limits", ",").alias("limits"), "source", "mode")


@query(
    f"with {PARTS} select page_id, case when count(price) > 0 then 'public_pricing' else 'contact_sales' end as status, count(*) as plans, round(min(case when billing_period = 'year' then price / 12 else price end), 4) as lowest, round(max(case when billing_period = 'year' then price / 12 else price end), 4) as highest, "
    "round(40 * count(price) / count(*) + 30 * count(*) filter (where billing_period <> 'unknown') / count(*) + 30 * count(*) filter (where limits <> '') / count(*))::int as completeness from parts group by 1"
)
def structured_models(spark, sf_dir):
    """The pricing model of each page from its structures alone."""
    found = structured.plans(_pages(spark, sf_dir))
    return structured.model(structured.merged(found, found.limit(0)))


@query(
    f"with {PARTS}, t as (select page_id, plan, price from parts where p_partkey % 3 = 0), b as (select page_id, plan, price + 1000 as price from parts where p_partkey % 2 = 0), a as (select * from t) "
    "select page_id, plan, coalesce(a.price, b.price) as price, case when a.plan is null then 'text' when b.plan is null then 'structure' else 'both' end as found_in from a full join b using (page_id, plan)"
)
def merged_plans(spark, sf_dir):
    """Plans of the structures completed by those of another reading: its prices count only where the structure has none."""
    found = structured.plans(_pages(spark, sf_dir)).withColumn("_k", F.regexp_extract("plan", r"(\d+)$", 1).cast("long"))
    rows = structured.merged(found.filter("_k % 3 = 0"), found.filter("_k % 2 = 0").withColumn("price", F.col("price") + 1000))
    return rows.select("page_id", "plan", "price", "found_in")


@query(
    f"with {PARTS} select page_id, round(price, 2) as amount, currency, true as accepted, count(*) as times from parts where price is not null and shape <> 2 group by 1, 2, 3 union all select distinct page_id, 2500.0, 'USD', false, 1 from parts union all select distinct page_id, 1.0, 'USD', false, 1 from parts"
)
def page_prices(spark, sf_dir):
    """Amounts in the text of price pages and whether they are prices of the product, by page and amount."""
    rows = extract.prices(html.evidence_blocks(_pages(spark, sf_dir), "page_id", "html", ["url", "page_type"]))
    return rows.groupBy("page_id", "amount", "currency", "accepted").agg(F.count("*").alias("times"))


@query(f"with {PARTS} select distinct page_id, case when shape = 2 then 'script_shell' else 'ok' end as validity, 'pricing' as page_type from parts")
def price_page_validity(spark, sf_dir):
    """Whether price pages can be judged: those whose prices are in a script alone show too little."""
    pages = _pages(spark, sf_dir)
    found = html.evidence_blocks(pages, "page_id", "html", ["url", "page_type"])
    return extract.page_validity(pages, found).withColumn("page_type", F.lit("pricing"))


@query(
    f"with {PARTS}, m as (select *, case when billing_period = 'year' then price / 12 else price end as monthly, regexp_replace(printf('%.2f', price), '\\.00$', '') as shown from parts), r as (select *, row_number() over (partition by page_id order by monthly nulls last, plan, p_partkey) as rank from m) "
    "select page_id, rank::int as rank, plan, case when price is null then 'Contact sales' else case currency when 'USD' then '$' else '€' end || shown || ' / ' || billing_period end as price_text from r where rank <= 6"
)
def shown_options(spark, sf_dir):
    """The options that are shown of each price page: six at the most, cheapest by the month first."""
    found = structured.plans(_pages(spark, sf_dir)).select("page_id", "plan", "price", "currency", "billing_period", F.format_string("%012d", F.regexp_extract("plan", r"(\d+)$", 1).cast("long")).alias("block_id"), F.lit("paid").alias("kind"))
    return display.price_options(found).select("page_id", "rank", "plan", "price_text")


@query(
    "with p as (select p_partkey, p_partkey // 8 as page_id, p_partkey % 8 as i, round(p_retailprice, 2) as price, p_size from part), m as (select page_id, 'Pro ' || p_partkey as plan, case when i = 7 then null else price end as price, case when i = 7 then null else 'USD' end as currency, "
    "case when i = 7 then 'unknown' else 'month' end as billing_period, p_size || ' projects' as limits from p) select *, 'heading' as source from m"
)
def heading_plans(spark, sf_dir):
    """Plans of pages that only headings divide: what stands under each heading up to the next of its level."""
    amount, key = F.format_string("%.2f", "p_retailprice"), F.col("p_partkey").cast("string")
    said = F.when(F.col("p_partkey") % 8 == 7, "Contact sales").otherwise(F.concat(F.lit("$"), amount, F.lit(" per month")))
    part = F.concat(F.lit("<h2>Pro "), key, F.lit("</h2><p>"), said, F.lit("</p><p>"), F.col("p_size").cast("string"), F.lit(" projects</p><h3>Notes</h3><p>plain words</p>"))
    rows = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 8).alias("page_id"), "p_partkey", part.alias("part"))
    pages = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "part"))), lambda x: x["part"]), "").alias("html"))
    pages = pages.withColumn("html", F.concat(F.lit("<html><body><main>"), "html", F.lit("</main><p>$5 outside</p></body></html>")))
    found = structured.plans(pages)
    return found.select("page_id", "plan", "price", "currency", "billing_period", F.array_join("limits", ",").alias("limits"), "source")
