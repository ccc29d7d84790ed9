"""Extraction from invented pages in the shapes that matter, against what a reader finds in them."""

import fixture_pages as fixtures
from pyspark.sql import functions as F

from tidepool.operators import extract, structured, validate
from tidepool.sources import html


def blocks(spark, **prices):
    return html.evidence_blocks(fixtures.pages(spark, **prices), "page_id", "html", ["url", "page_type"])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_prices_and_plans(spark):
    found = extract.prices(blocks(spark))
    assert rows(found.select("page_id", "price_text", "accepted")) == [(1, "$2,500", False), (1, "$29", True), (2, "€1.249,00", True), (2, "€9,99", True), (3, "$40,000", False)]
    plans = extract.plans(blocks(spark), found).select("page_id", "plan", "price", "currency", "billing_period")
    assert {tuple(r) for r in plans.collect()} == {(1, "Pro", 29.0, "USD", "month"), (1, "Enterprise", None, None, None), (2, "Basic", 9.99, "EUR", "month"), (2, "Team", 1249.0, "EUR", "year")}


def test_validity(spark):
    assert rows(extract.page_validity(fixtures.pages(spark), blocks(spark))) == [(1, "ok"), (2, "ok"), (3, "ok"), (4, "script_shell"), (5, "blocked"), (6, "missing")]


def test_structures_of_cards_tables_and_scripts(spark):
    script = '<script>var a = [{"name":"Solo","price":5,"currency":"eur","period":"month"},{"price":7}];var b = [{broken];</script>'
    pages = fixtures.pages(spark).select("page_id", "html").unionByName(spark.createDataFrame([(7, script), (8, None), (9, "<table><tr><td>only</td></tr></table>")], "page_id bigint, html string"))
    found = {(r.page_id, r.plan, r.price, r.currency, r.billing_period, r.source) for r in structured.plans(pages).collect()}
    assert found == {
        (1, "Starter", 0.0, "USD", "month", "card"), (1, "Pro", 29.0, "USD", "month", "card"), (1, "Enterprise", None, None, "unknown", "card"),
        (2, "Basic plan", 9.99, "EUR", "month", "table"), (2, "Team plan", 1249.0, "EUR", "year", "table"), (7, "Solo", 5.0, "EUR", "month", "script"),
    }


def test_scored_types(spark):
    made = [("https://a.test/", "Welcome home", "homepage", 0.96), ("https://a.test/pricing", "Compare plans", "pricing", 0.69), ("https://a.test/x", "nothing", "unknown", 0.0), ("https://a.test/docs/guide", "Read the guide", "docs", 0.69)]
    got = spark.createDataFrame([(u, t) for u, t, *_ in made], "u string, t string").select("u", validate.detected(validate.type_scores(F.col("u"), F.col("t"))).alias("d")).collect()
    assert {r.u: (r.d["type"], r.d["confidence"]) for r in got} == {u: (k, s) for u, _, k, s in made}
