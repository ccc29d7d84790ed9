import pytest
from pyspark.sql import functions as F

from tidepool.functions import money, text, urls


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "url, canonical",
    [
        ("HTTPS://Example.COM/", "https://example.com"),
        ("https://example.com//a///b/?utm_source=x&b=2&a=1&GCLID=3#top", "https://example.com/a/b?a=1&b=2"),
        ("https://example.com/?q=1", "https://example.com?q=1"),
        ("https://example.com/a/?fbclid=1", "https://example.com/a"),
        ("  not a url ", "not a url"),
        (None, ""),
    ],
)
def test_canonical(spark, url, canonical):
    assert one(spark, urls.canonical, url) == canonical
    assert one(spark, lambda c: urls.canonical(urls.canonical(c)), url) == canonical


@pytest.mark.parametrize(
    "url, error",
    [("", "empty"), ("a b", "invalid"), ("http://example.com", "not_https"), ("https://u:p@example.com", "credentials"), ("https://localhost:3000/x", "private_host"), ("10.1.2.3", "private_host"), ("example.com/pricing", None), ("https://[::1]/", "private_host"), (None, "empty")],
)
def test_input_errors(spark, url, error):
    assert one(spark, urls.input_error, url) == error


@pytest.mark.parametrize("host, private", [("192.168.0.1", True), ("172.31.9.9", True), ("172.32.0.1", False), ("8.8.8.8", False), ("::ffff:10.0.0.1", True), ("fd00::1", True), ("fe80::1", True), ("example.com", False), ("db.internal", True), ("999.1.1.1", False)])
def test_private_hosts(spark, host, private):
    assert one(spark, urls.private_host, host) is private


@pytest.mark.parametrize("raw, comparable", [
    ("Pro  $ 29 per month ,now!", "pro $29/ month, now!"),
    ("Build chunk-abc123def &amp; <b>bold</b> 12:30 pm", "build & bold"),
    ("9.99/month", "9. 99/ month"),
    (None, ""),
])
def test_comparable(spark, raw, comparable):
    assert one(spark, text.comparable, raw) == comparable


def test_canonical_content_ignores_order_and_boilerplate(spark):
    a, b = "Hello world\nTerms\nPricing: $5 monthly\nHello  world", "Pricing: $5 per month\ncookie settings\nhello world"
    assert one(spark, text.canonical_content, a) == one(spark, text.canonical_content, b) != ""


@pytest.mark.parametrize("raw, amount", [("1,234.56", 1234.56), ("1.234,56", 1234.56), ("9,99", 9.99), ("1,000", 1000.0), ("12", 12.0), ("x", None), ("10.000", 10000.0)])
def test_amounts(spark, raw, amount):
    assert one(spark, money.amount, raw) == amount


def test_truncated_and_jaccard(spark):
    assert one(spark, lambda c: text.truncated(c, 10), "a long text here") == "a long..."
    row = spark.createDataFrame([(["a", "b"], ["b", "c"], [])], "x array<string>, y array<string>, z array<string>").select(text.jaccard(F.col("x"), F.col("y")), text.jaccard(F.col("z"), F.col("z"))).first()
    assert row[0] == pytest.approx(1 / 3) and row[1] == 1.0


def test_entities_are_decoded_once(spark):
    wanted = {"&#36;29 &euro;30": "$29 €30", "&#x20AC;5 &#8364;6": "€5 €6", "&amp;lt;b&amp;gt;": "&lt;b&gt;", "&AMP; &Pound;7": "& £7", "&unknown; &; a&b": "&unknown; &; a&b", "&#128512;&#233;&#65;": "\U0001f600éA", "plain": "plain", "&#99999999;": "&#99999999;"}
    rows = spark.createDataFrame([(k,) for k in wanted], "t string").select("t", text.decoded(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == wanted
    assert spark.createDataFrame([("&#36; 29, &euro; 30",)], "t string").select(text.comparable(F.col("t"))).first()[0] == "$29, €30"


def test_canonical_drops_credentials_and_default_ports(spark):
    wanted = {"https://user:pw@Shop.example.com:443/a/": "https://shop.example.com/a", "http://x.example:80": "http://x.example", "https://x.example:8443/b": "https://x.example:8443/b", "http://x.example:443/c": "http://x.example:443/c"}
    rows = spark.createDataFrame([(k,) for k in wanted], "u string").select("u", urls.canonical(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in rows} == wanted


def test_contexts_of_amounts(spark):
    cases = [
        ("Pro $29 per month", "div plan-card", "plan_card", True), ("Freelancer budget $40/hr", "", "job_budget", False), ("Testimonial: saved $20", "div pricing-card", "plan_card", True), ("Billed monthly $5", "", "billing_toggle", True),
        ("Compare plans: $9", "", "pricing_table", True), ("$9", "td cell", "pricing_table", True), ("$9 usage", "", "product_pricing", True), ("$9", "", "unknown", False), ("Subscribe for $9", "", "upgrade_modal", True), ("$1", "x-checkout", "checkout_section", True),
        ("éjob $1", "", "job_budget", False), ("a joblike thing", "", "unknown", False),
    ]
    found = spark.createDataFrame([(k, t, e) for k, (t, e, _, _) in enumerate(cases)], "k int, t string, e string").select("k", money.classified_context(F.col("t"), F.col("e"), F.lit("unknown"), F.lit("unknown")).alias("c")).collect()
    assert {r.k: (r.c.classification, r.c.accepted, r.c.reason) for r in found} == {k: (kind, ok, None if ok else f"non_product_pricing_{kind}") for k, (_, _, kind, ok) in enumerate(cases)}
    labels = spark.createDataFrame([("Pro",), ("plan 3",), ("Growth",), ("",), (None,), ("What?!.. no",), ("x" * 57,), ("Team plus",)], "l string")
    assert [r.l for r in labels.filter(money.reliable_label(F.col("l"))).collect()] == ["Pro", "Team plus"]
