"""Hash trees of profiles, follow-ups, reasons and suggestions."""

import fixture_pages as fixtures
from pyspark.sql import functions as F

from tidepool.operators import analysis, profiles, validate


def test_follow_ups_name_what_changed(spark):
    side = lambda **prices: profiles.hashed(profiles.profiles(analysis.analyse(analysis.parsed(fixtures.pages(spark, **prices)))))
    old, new = side(), side(pro="$39")
    found = {r.page_id: r for r in profiles.follow_up(old.filter("page_id <> 2"), new.filter("page_id <> 3"), "page_id").collect()}
    assert (found[1].status, found[1].changed_models, found[1].changed_paths) == ("model_changed", ["pricing"], ["monetization.plans", "monetization.lowest"])
    assert found[2].status == "new_baseline" and found[3].status == "unavailable" and found[5].status == "no_meaningful_change" and found[5].changed_paths == []
    roots = {r.page_id: r.hashes.root for r in old.collect()}
    assert roots == {r.page_id: r.hashes.root for r in side().collect()} and len(set(roots.values())) >= 5


def test_reasons_and_suggestions(spark):
    rows = profiles.profiles(analysis.analyse(analysis.parsed(fixtures.pages(spark))))
    found = {r.page_id: r for r in rows.select("page_id", profiles.reasons().alias("why"), profiles.watchlist().alias("watch"), profiles.compact().alias("c")).collect()}
    assert found[5].why == list(profiles.REASONS) and found[5].watch == [b for _, b in profiles.WATCH]
    assert profiles.REASONS[0] not in found[1].why and profiles.WATCH[0][0] in found[1].watch and found[1].c.monetization == "mixed pricing visible" and found[1].c.primary_cta == "Start free"
    assert found[5].c.what_it_does == profiles.UNCLEAR["what"]


def test_business_signals(spark):
    row = spark.range(1).select(validate.business_signals(F.lit("Free to start, or Contact Sales"), F.array(F.lit("Automated workflow"), F.lit("Team roles"), F.lit("workflow"))).alias("s")).first()
    assert row.s == ["automation", "collaboration", "sales-led", "free tier"]
