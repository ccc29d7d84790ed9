"""Texts are searched once for all words of contexts; only those that have one are searched for each."""

import re

from pyspark.sql import functions as F

from tidepool.functions import money
from tidepool.functions import text as T

EACH = [p for n, p in money.OTHER_CONTEXTS if n != money.ELEMENT_CONTEXT] + [money.PRICED_WORDS] + [p for _, _, p in money.PRICE_CONTEXTS]


def texts():
    words = {w.replace(r"\b", "").replace(r"/\s?", "/ ").replace("s?", "s") for p in EACH + [money.PLAN_LABEL] for w in re.sub(r"\\b\(\?:|\)\\b", "|", p).split("|") if w}
    found = [t for w in sorted(words) for t in (w, f"one {w} two", f"one.{w}.two", f"é{w}é", f"one{w}two", f"{w}9", f"5{w}", f"_{w}", f"pro {w}")]
    return [*found, "", "nothing at all", "20/hr", "20 /hr", "a/hrs", "a/article", "éhr", "an article", "plan pro"]


def test_no_context_is_missed(spark):
    rows = spark.createDataFrame([(t,) for t in texts()], "text string")
    found = rows.select("text", F.col("text").rlike(money.CONTEXT_SIGNS).alias("some"), *[F.col("text").rlike(T.ascii_words(p)).alias(f"p{i}") for i, p in enumerate(EACH)]).collect()
    assert all(r.some or not any(r[2:]) for r in found) and sum(not r.some for r in found) > 100


def test_each_context_is_told(spark):
    cases = [("20/hr", "div", "job_budget", False), ("éhr", "div", "job_budget", False), ("an article", "div", "blog_content", False), ("nothing", "article", "blog_content", False), ("nothing", "card", "plan_card", True), ("nothing", "div", "unknown", False), ("monthly", "div", "billing_toggle", True), ("5 seat", "div", "product_pricing", True), ("seat pro", "p", "plan_card", True), ("sample", "price", "plan_card", True), (None, None, "unknown", False)]
    unknown = F.lit("unknown")
    rows = spark.createDataFrame([(k, t, e) for k, (t, e, _, _) in enumerate(cases)], "k int, t string, e string").withColumn("c", money.classified_context(F.col("t"), F.col("e"), unknown, unknown))
    assert [(r.c.classification, r.c.accepted) for r in rows.orderBy("k").collect()] == [c[2:] for c in cases]
    assert rows.select("c.classification", "c.accepted")._jdf.queryExecution().optimizedPlan().toString().count("salary") <= 2
