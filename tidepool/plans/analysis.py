"""Queries that analyse whole pages at once, show them, and run over stored pages again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import analysis, profiles, sinks
from tidepool.plans.extraction import product_pages
from tidepool.plans.registry import query, table


def _pages(spark, sf_dir, raised: int = 0):
    """Product pages of the suppliers, every other one a home page; every fifth price raised by so much."""
    kind = F.when(F.col("page_id") % 2 == 0, "homepage").otherwise("pricing")
    return product_pages(spark, sf_dir, raised).withColumn("page_type", kind)


#: DuckDB's side of the pages, and of which sections run on them.
MADE = (
    "p as (select s_suppkey as page_id, s_name as name, (10 + s_suppkey % 90)::double as price, s_suppkey % 50 + 2 as users, s_suppkey % 3 = 0 as contact, s_suppkey % 10 as feature, s_suppkey % 2 = 0 as home, "
    "case s_suppkey % 11 when 7 then 'blocked' when 8 then 'missing' else 'ok' end as validity, s_suppkey % 11 not in (7, 8) as ok from supplier)"
)


@query(
    f"with {MADE} select page_id, validity, case validity when 'missing' then 0 else 7 + contact::int end as blocks, case when validity <> 'missing' then name || ' pricing' end as title, case when ok then 'public_pricing' else 'unknown' end as pricing_status, case when ok then price end as lowest, "
    "case when not ok then 0 when contact then 50 else 100 end as completeness, case when not ok then '' else 'Pro=' || price::int || ' USD month ' || users || ' users' || case when contact then '; Enterprise=' else '' end end as plans, "
    "case when not ok then '' else 'Start free,Get Pro' || case when contact then ',Contact sales' else '' end end as actions, case when ok and home then 'Automatic schedules ' || feature else '' end as features, case when ok and home then 'Plan your week with ' || name end as headline, "
    "case when not ok then 'plans:page_type_not_verified,actions:page_type_not_verified,features:page_type_not_verified,releases:page_type_not_verified,claims:page_type_not_verified' when home then 'releases:page_type_not_verified' "
    "else 'features:page_type_not_verified,releases:page_type_not_verified,claims:page_type_not_verified' end as warnings from p"
)
def page_analysis(spark, sf_dir):
    """Every section of every page from one parse: validity, plans, calls to action, features, claims, what is missing and why."""
    rows = analysis.analyse(analysis.parsed(_pages(spark, sf_dir)))
    plan = lambda p: F.concat(p["plan"], F.lit("="), F.coalesce(F.concat_ws(" ", F.format_string("%.0f", p["price"]), p["currency"], p["billing_period"], F.array_join(p["limits"], "+")), F.lit("")))
    return rows.select(
        "page_id", "validity", "blocks", F.col("metadata.title").alias("title"), F.col("pricing.status").alias("pricing_status"), F.col("pricing.lowest").alias("lowest"), F.col("pricing.completeness").alias("completeness"),
        F.array_join(F.transform("plans", lambda p: F.when(p["price"].isNull(), F.concat(p["plan"], F.lit("="))).otherwise(plan(p))), "; ").alias("plans"), F.array_join(F.transform("actions", lambda a: a["label"]), ",").alias("actions"),
        F.array_join(F.transform("features", lambda f: f["name"]), ",").alias("features"), F.get("claims", F.lit(0))["headline"].alias("headline"), F.array_join("warnings", ",").alias("warnings"),
    )


@query(
    f"with {MADE} select page_id, validity, case when ok then 'public' else 'not_detected' end as state, case when ok then 'Pro: $' || price::int || ' / month' || case when contact then '; Enterprise: Contact sales' else '' end else '' end as options, "
    "case when ok then 'Start free' end as primary_action, case when not ok then '' else 'Get Pro' || case when contact then ',Contact sales' else '' end end as other_actions, 'unavailable' as features, "
    "case when ok then case when home then 'Plan your week with ' || name || ' · ' else '' end || 'from ' || printf('%.2f', price) || ' · Start free' else '' end as overview from p"
)
def display_views(spark, sf_dir):
    """What is shown of each analysed page."""
    rows = analysis.views(analysis.analyse(analysis.parsed(_pages(spark, sf_dir))))
    return rows.select(
        "page_id", "validity", "pricing.state", F.array_join(F.transform("pricing.options", lambda o: F.concat(o["plan"], F.lit(": "), o["price_text"])), "; ").alias("options"), F.col("actions.primary").alias("primary_action"),
        F.array_join("actions.others", ",").alias("other_actions"), F.col("features.status").alias("features"), "overview",
    )


@query("select page_id, case when html is null or html = '' then 'missing' else 'ok' end as validity, 4 as blocks from pages")
def reanalysed_pages(spark, sf_dir):
    """The crawled pages analysed again by a run that resumes part by part; the run shows when it has ended."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.lit("unknown").alias("page_type"), F.lit(200).alias("status_code"), "html")
    work = lambda rows: analysis.analyse(analysis.parsed(rows)).select("page_id", "validity", "blocks")
    return analysis.rerun(pages, "page_id", sinks.new_table(spark, "reanalysis"), 1, work, parts=4)


def _listed(values) -> str:
    return "concat_ws(' ', " + ", ".join(f"case when {when} then '{x}' end" for when, x in values) + ")"


@query(
    f"with {MADE} select page_id, "
    + _listed(zip(("not ok", "not (ok and home)", "not ok", "true", "true"), profiles.REASONS))
    + " as reasons, "
    + _listed([(w, x) for (a, b), found in zip(profiles.WATCH, ("ok", "ok and home", "false", "ok")) for w, x in ((found, a), (f"not ({found})", b))])
    + f" as watch, case when ok and home then 'Plan your week with ' || name else '{profiles.UNCLEAR['what']}' end as what_it_does, '{profiles.UNCLEAR['who']}' as who_it_serves, case when not ok then '{profiles.UNCLEAR['price']}' when contact then 'mixed pricing visible' else 'fixed pricing visible' end as monetization, "
    f"case when ok then 'Start free' else '{profiles.UNCLEAR['cta']}' end as primary_cta, case when ok and home then 'automation' else '{profiles.UNCLEAR['themes']}' end as feature_themes, '{profiles.UNCLEAR['updates'][1]}' as update_presence from p"
)
def business_profiles(spark, sf_dir):
    """The profile of each analysed page in short: what it does, for whom, what wasn't found and what to watch."""
    rows = profiles.profiles(analysis.analyse(analysis.parsed(_pages(spark, sf_dir))))
    return rows.select("page_id", F.array_join(profiles.reasons(), " ").alias("reasons"), F.array_join(profiles.watchlist(), " ").alias("watch"), profiles.compact().alias("c")).select("page_id", "reasons", "watch", "c.*")


@query(
    f"with {MADE} select page_id, case when ok and page_id % 5 = 0 then 'model_changed' else 'no_meaningful_change' end as status, case when ok and page_id % 5 = 0 then 'pricing' else '' end as changed_models, "
    "case when ok and page_id % 5 = 0 then 'monetization.plans,monetization.lowest' else '' end as changed_paths from p"
)
def profile_follow_ups(spark, sf_dir):
    """What changed in each profile since every fifth page raised its price, down to the fields."""
    side = lambda raised: profiles.hashed(profiles.profiles(analysis.analyse(analysis.parsed(_pages(spark, sf_dir, raised)))))
    rows = profiles.follow_up(side(0), side(10), "page_id")
    return rows.select("page_id", "status", *[F.array_join(c, ",").alias(c) for c in ("changed_models", "changed_paths")])


_NO_ALERT = analysis.SUPPRESSED["low_confidence_model"]


@query(
    f"with {MADE} select page_id, 1 as place, 'pricing_model_changed' as type, 'Pro plan changed from USD ' || price::int || ' to USD ' || (price::int + 10) || '.' as summary, 0.9::double as confidence, false as suppressed, 'high' as severity, true as written from p where ok and page_id % 5 = 0 "
    f"union all select page_id, 1, '{_NO_ALERT[0]}', '{_NO_ALERT[1]}', 0.0::double, true, 'low', false from p where not ok"
)
def business_changes(spark, sf_dir):
    """What changed between two analyses of each page, in sentences, and which changes are written."""
    side = lambda raised: analysis.analyse(analysis.parsed(_pages(spark, sf_dir, raised)))
    return analysis.changes(side(0), side(10)).select("page_id", "place", "type", "summary", "confidence", "suppressed", "severity", "written")
