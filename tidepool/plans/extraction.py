"""Queries over product pages made of the suppliers table, one page each: prices, plans, models, calls to action,
features, releases, validity, summaries, linked data; and over price sentences made of the parts table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import money, urls
from tidepool.operators import display, extract
from tidepool.operators.sinks import stored
from tidepool.plans.registry import dealt, query, table
from tidepool.plans.web import UNESCAPED
from tidepool.sources import html


def _said(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def product_pages(spark, sf_dir, raised: int = 0) -> DataFrame:
    """(page_id, url, page_type, status_code, html): every fifth price raised by so much, every third with an
    offer by contact, every other with linked data that is broken, some blocked or gone."""
    key = F.col("s_suppkey")
    number = lambda x: x.cast("string")
    price = 10 + key % 90 + F.when(key % 5 == 0, raised).otherwise(0)
    contact = F.when(key % 3 == 0, '<article class="plan-card"><h3>Enterprise</h3><p>Custom pricing</p><button>Contact sales</button></article>').otherwise("")
    data = F.when(key % 2 == 0, '<script type="application/ld+json">{broken</script>').otherwise("")
    markup = _said(
        "<html><head><title>", F.col("s_name"), " pricing</title>", data, '<script type="application/ld+json">{"@type":"Product","name":"', F.col("s_name"), '"}</script></head><body><nav><a href="/login">Log in</a></nav>',
        '<section class="hero"><h1>Plan your week with ', F.col("s_name"), '</h1><p>For small teams that juggle many calendars</p><a href="/signup">Start free</a></section>',
        '<article class="plan-card"><h3>Pro</h3><p>$', number(price), " per month billing</p><p>", number(key % 50 + 2), " users</p><button>Get Pro</button></article>", contact,
        '<article class="testimonial"><p>This tool saved our team $2,500 a month</p></article>', '<section class="feature-grid"><h2>Automatic schedules ', number(key % 10), "</h2><p>Plans fill themselves from what your team already knows</p></section>",
        "<section><h2>Changelog</h2><p>Changelog: March ", number(key % 28 + 1), ", 2024 faster search</p></section><footer><p>All rights reserved</p></footer></body></html>",
    )
    status = F.when(key % 11 == 7, 403).when(key % 11 == 8, 404).otherwise(200)
    return dealt(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey").select(key.alias("page_id"), _said("https://s", number(key), ".example.com/pricing").alias("url"), F.lit("pricing").alias("page_type"), status.alias("status_code"), F.when(status == 404, "").otherwise(markup).alias("html"))


#: DuckDB's side of the pages that show something.
SHOWN = "p as (select s_suppkey as page_id, s_name as name, (10 + s_suppkey % 90)::double as price, s_suppkey % 3 = 0 as contact, s_suppkey % 10 as feature, s_suppkey % 28 + 1 as day from supplier where s_suppkey % 11 <> 8)"


def _blocks(spark, sf_dir, raised: int = 0):
    return html.evidence_blocks(product_pages(spark, sf_dir, raised), "page_id", "html", ["url", "page_type"])


def _models(spark, sf_dir, raised: int = 0):
    #: Written once: plans, models and prices read them again and again.
    blocks = stored(_blocks(spark, sf_dir, raised), "evidence")
    found = stored(extract.prices(blocks), "prices")
    return extract.pricing_models(blocks, found, extract.plans(blocks, found))


@query(f"with {SHOWN} select page_id, '$' || price::int as price_text, true as accepted from p union all select page_id, '$2,500', false from p")
def extract_prices(spark, sf_dir):
    """Amounts in the pages and whether they are prices of the product."""
    return extract.prices(_blocks(spark, sf_dir)).select("page_id", "price_text", "accepted")


@query(f"with {SHOWN} select page_id, 'Pro' as plan, price, 'USD' as currency, 'month' as billing_period from p union all select page_id, 'Enterprise', null, null, null from p where contact")
def extract_plans(spark, sf_dir):
    """Plans with their prices."""
    blocks = _blocks(spark, sf_dir)
    return extract.plans(blocks, extract.prices(blocks)).select("page_id", "plan", "price", "currency", "billing_period")


@query(f"with {SHOWN} select page_id, 'public_pricing' as status, case when contact then 'mixed' else 'fixed_plans' end as model_type, price as lowest, price as highest, contact as contact_sales from p")
def pricing_models(spark, sf_dir):
    """The pricing model of each page that has blocks."""
    return _models(spark, sf_dir).select("page_id", "status", "model_type", "lowest", "highest", "contact_sales")


@query(
    f"with {SHOWN}, c as (select page_id, printf('%.1f', price) as old, printf('%.1f', price + 10) as new from p where page_id % 5 = 0) select page_id, 'lowest_price_changed' as change, old, new, 'high' as severity, true as written from c union all select page_id, 'highest_price_changed', old, new, 'medium', true from c"
)
def pricing_model_changes(spark, sf_dir):
    """What changes when every fifth page raises its price."""
    return extract.model_changes(_models(spark, sf_dir), _models(spark, sf_dir, raised=10)).select("page_id", "change", "old", "new", "severity", "written")


@query(
    f"with {SHOWN} select page_id, 'Start free' as label, 'start_trial' as intent, 1 as rank, null as rejected from p union all select page_id, 'Get Pro', 'upgrade_buy', 2, null from p union all select page_id, 'Contact sales', 'contact_sales', 3, null from p where contact "
    "union all select page_id, 'Log in', 'unknown', case when contact then 4 else 3 end, 'utility_or_legal' from p"
)
def calls_to_action(spark, sf_dir):
    """Buttons by intent, in the order of their weight."""
    return extract.calls_to_action(_blocks(spark, sf_dir)).select("page_id", "label", "intent", F.col("rank").cast("int").alias("rank"), "rejected")


@query(f"with {SHOWN} select page_id, 1 as rank, 'Automatic schedules ' || feature as name, 0.72::double as score from p")
def extract_features(spark, sf_dir):
    """Named features."""
    return extract.features(_blocks(spark, sf_dir)).select("page_id", "rank", "name", "score")


@query(f"with {SHOWN} select page_id, 1 as rank, '2024-03-' || lpad(day::varchar, 2, '0') as released from p")
def extract_releases(spark, sf_dir):
    """Dated entries of a changelog."""
    return extract.releases(_blocks(spark, sf_dir)).select("page_id", "rank", "released")


@query(f"with {SHOWN} select page_id, 'Plan your week with ' || name as headline, 0.9::double as score from p")
def extract_positioning(spark, sf_dir):
    """Main claims of pages."""
    return extract.positioning(_blocks(spark, sf_dir)).select("page_id", "headline", "score")


@query("select s_suppkey as page_id, case s_suppkey % 11 when 7 then 'blocked' when 8 then 'missing' else 'ok' end as validity from supplier")
def page_validity(spark, sf_dir):
    """Whether a page can be judged at all."""
    return extract.page_validity(product_pages(spark, sf_dir), _blocks(spark, sf_dir))


#: DuckDB's side of links' texts in the crawled pages, which stand in the navigation only.
_LABEL = "trim(regexp_replace(" + UNESCAPED.format("x") + ", '\\s+', ' ', 'g'))"
_INTENT = "case " + " ".join(f"when regexp_matches(label, '{p}') then '{n}'" for n, p in extract.INTENTS) + " else 'unknown' end"


@query(
    f"with l as (select page_id, unnest(list_filter(list_transform(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1), lambda x: {_LABEL}), lambda x: x <> '')) as label, generate_subscripts(list_filter(list_transform(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1), lambda x: {_LABEL}), lambda x: x <> ''), 1) - 1 as i from pages), "
    f"t as (select *, {_INTENT} as intent from l), r as (select *, case when regexp_matches(label, '{extract.UTILITY}') then 'utility_or_legal' when intent = 'unknown' then 'unknown_intent' end as rejected from t) "
    "select page_id, label, intent, 8 + i / 10.0::double as priority, case when rejected is null then 0.72 else 0.25 end::double as score, rejected, row_number() over (partition by page_id order by rejected is not null, i)::int as rank from r"
)
def page_calls_to_action(spark, sf_dir):
    """Buttons and links of the crawled pages by intent and rank."""
    pages = table(spark, sf_dir, "pages").withColumn("page_type", urls.path_type(F.col("url")))
    rows = extract.calls_to_action(html.evidence_blocks(pages, carry=["page_type"]))
    return rows.select("page_id", "label", "intent", F.col("priority").cast("double").alias("priority"), "score", "rejected", "rank")


@query(f"with {SHOWN} select page_id, 1 as rank, 'Pro' as plan, '$' || price::int || ' / month' as price_text from p union all select page_id, 2, 'Enterprise', 'Contact sales' from p where contact")
def price_options(spark, sf_dir):
    """Options that are shown for each page, cheapest by the month first."""
    blocks = _blocks(spark, sf_dir)
    return display.price_options(extract.plans(blocks, extract.prices(blocks))).select("page_id", "rank", "plan", "price_text")


@query(f"with {SHOWN} select page_id, 'Positioning: Plan your week with ' || name || '. Pricing: ' || printf('%.1f', price) || '. Cta: Start free. Feature: Automatic schedules ' || feature as summary, '' as unknown from p")
def page_summaries(spark, sf_dir):
    """One sentence from the best fact of each section, and what is unknown."""
    blocks = _blocks(spark, sf_dir)
    facts = display.page_facts(_models(spark, sf_dir), extract.calls_to_action(blocks), extract.positioning(blocks), extract.features(blocks))
    rows = display.summary(display.best_by_section(facts, "page_id"), "page_id")
    return rows.select("page_id", "summary", F.array_join("unknown", ",").alias("unknown"))


GATED = """page_id | page_type | run_pricing | run_positioning | run_cta | run_features | run_momentum | run_trust | run_category
0 | homepage | true | true | true | true | false | true | true
1 | pricing | true | false | true | false | false | false | false
2 | features | false | true | false | true | false | false | true
3 | product | false | true | true | true | false | true | true
4 | changelog | false | false | false | false | true | false | false
5 | docs | false | false | false | false | false | false | false"""
_HEAD, *_ROWS = [[c.strip() for c in line.split("|")] for line in GATED.splitlines()]


@query(
    "with g as (select * from (values " + ", ".join(f"({r[0]}, '{r[1]}', {', '.join(r[2:])})" for r in _ROWS) + f") as t(k, page_type, {', '.join(_HEAD[2:])})) "
    "select page_id, " + ", ".join(f"{c} and page_id % 5 <> 4 as {c}" for c in _HEAD[2:]) + " from pages join g on page_id % 6 = k"
)
def extraction_gates(spark, sf_dir):
    """Which analyses run on which page; none on a page that wasn't verified."""
    kinds = F.array(*[F.lit(x) for x in ("homepage", "pricing", "features", "product", "changelog", "docs")])
    kind = F.get(kinds, (F.col("page_id") % 6).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", *display.gates(kind, F.col("page_id") % 5 != 4))


@query("select s_suppkey as page_id, (case when s_suppkey % 2 = 0 then 1 else 0 end)::int as ord, 'Product' as type, s_name as name from supplier where s_suppkey % 11 <> 8")
def linked_data(spark, sf_dir):
    """Linked data in pages; what doesn't parse is left out."""
    return html.json_ld(product_pages(spark, sf_dir)).select("page_id", "ord", "type", "name")


#: Sentences around an amount, and what it is about in each.
SENTENCES = (("Pro plan: {} per month", "plan"), ("We saved {} of revenue", "savings"), ("Their campaign budget was {}", "case_study"), ("{} per year", "period"), ("worldwide we count {}", "unknown"))


def _sentences(spark, sf_dir) -> DataFrame:
    whole = F.floor(F.col("p_retailprice")).cast("long")
    grouped = F.concat((F.floor(whole / 1000) + 1).cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"))
    shown = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("$"), grouped)).when(F.col("p_partkey") % 3 == 1, F.concat(F.translate(grouped, ",", "."), F.lit(",50 €"))).otherwise(F.concat(F.lit("GBP "), F.format_string("%.2f", "p_retailprice")))
    said = F.get(F.array(*[_said(s.split("{}")[0], shown, s.split("{}")[1]) for s, _ in SENTENCES]), (F.col("p_partkey") % len(SENTENCES)).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("text_id"), said.alias("text"))


@query(
    "select p_partkey as text_id, case p_partkey % 3 when 0 then floor(p_retailprice) + 1000 when 1 then floor(p_retailprice) + 1000.5 else round(p_retailprice, 2) end as amount, ['USD', 'EUR', 'GBP'][(p_partkey % 3 + 1)::int] as currency, "
    "['month', 'unknown', 'unknown', 'year', 'unknown'][(p_partkey % 5 + 1)::int] as period from part"
)
def currency_amounts(spark, sf_dir):
    """Prices in sentences, in the spellings of several countries."""
    rows = _sentences(spark, sf_dir).withColumn("p", F.explode(money.prices(F.col("text"))))
    return rows.select("text_id", "p.amount", "p.currency", money.period(F.col("text")).alias("period"))


@query("select p_partkey as text_id, ['plan', 'savings', 'case_study', 'period', 'unknown'][(p_partkey % 5 + 1)::int] as context from part")
def price_contexts(spark, sf_dir):
    """What the amounts of the same sentences are about."""
    return _sentences(spark, sf_dir).select("text_id", money.price_context(F.col("text")).alias("context"))
