"""Types of pages by content and path, and what changed between two analyses."""

import fixture_pages as fixtures
from pyspark.sql import functions as F

from tidepool.operators import analysis, classify
from tidepool.sources import dom

PRICES = "<html><head><title>Plans</title></head><body><section class='pricing'><h2>Pro</h2><p>$29 per month</p></section></body></html>"
HOME = "<html><body><header><h1>Plan your week</h1><p>Calm calendars for busy teams everywhere</p></header></body></html>"


def test_types_and_reasons(spark):
    pages = [
        (1, "https://a.test/pricing", 200, "pricing", PRICES), (2, "https://a.test/", 200, "homepage", HOME), (3, "https://a.test/pricing", 200, "pricing", HOME), (4, "https://a.test/x", 403, "pricing", HOME),
        (5, "https://a.test/x", 404, "docs", HOME), (6, "https://a.test/x", 200, "docs", None), (7, "https://a.test/docs/a", 200, "docs", "<body><p>Plain words</p></body>"), (8, "https://a.test/y", 200, "unknown", "<body><section>Release notes: version 2</section></body>"),
        (9, "https://a.test/", 200, "homepage", PRICES), (10, "https://a.test/z", 500, "pricing", PRICES),
    ]
    df = spark.createDataFrame(pages, "page_id int, url string, status_code int, requested string, html string")
    home = spark.createDataFrame([(3, "Plan your week\nCalm calendars for busy teams everywhere")], "page_id int, home_text string")
    rows = classify.classified(dom.parsed(df, carry=["url", "status_code", "requested"], parts=("elements", "blocks")), home=home)
    found = {r.page_id: (r.page_type, round(r.type_confidence, 2), r.allowed) for r in rows.collect()}
    assert found == {
        1: ("pricing", 0.94, True), 2: ("homepage", 0.9, True), 3: ("duplicate_homepage", 0.96, False), 4: ("blocked", 0.95, False), 5: ("missing", 0.95, False), 6: ("missing", 0.95, False),
        7: ("homepage", 0.84, False), 8: ("changelog", 0.84, True), 9: ("homepage", 0.9, True), 10: ("pricing", 0.84, False),
    }


def test_changes_between_analyses(spark):
    old = analysis.analyse(analysis.parsed(fixtures.pages(spark)))
    new = analysis.analyse(analysis.parsed(fixtures.pages(spark, starter="$5", pro="$39").withColumn("html", F.replace("html", F.lit("Shared calendars"), F.lit("Shared boards everywhere"))).withColumn("html", F.replace("html", F.lit(">Start free<"), F.lit(">Try free<")))))
    found = {}
    for r in analysis.changes(old, new).orderBy("page_id", "place").collect():
        found.setdefault(r.page_id, []).append((r.type, r.summary, r.confidence, r.severity, r.written))
    assert found[1] == [
        ("pricing_model_changed", "Starter plan changed from USD 0 to USD 5.", 0.9, "high", True), ("pricing_model_changed", "Pro plan changed from USD 29 to USD 39.", 0.9, "high", True),
        ("cta_changed", 'Primary CTA changed from "Start free" to "Try free".', 0.9, "high", True),
    ]
    assert [x[:2] for x in found[3]] == [
        ("pricing_alert_suppressed", "No pricing alert because pricing model confidence was low."), ("feature_model_changed", 'New feature signal added: "Shared boards everywhere".'), ("feature_model_changed", 'Feature signal removed: "Shared calendars".'),
    ]
    assert [x[0] for x in found[5]] == ["alert_suppressed"] and not any(x[4] for k in (3, 5) for x in found[k]) and 2 not in found
    gone = analysis.changes(new, old.withColumn("plans", F.slice("plans", 2, 9))).filter("page_id = 1 and type = 'pricing_plan_removed'").first()
    assert gone.summary == "Pricing plan removed: Starter." and gone.written
