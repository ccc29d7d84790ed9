"""Blocks are searched once for all signs of roles; only those that have one are searched for each."""

import re

from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators import blocks

EACH = [blocks.PRICING, blocks.FEATURE, blocks.ACTION, blocks.CHANGELOG, blocks.QUESTIONS, *[p for _, _, p in blocks.NEGATIVE]]


def _rows(spark, texts):
    none = F.lit(None).cast("string")
    rows = spark.createDataFrame(list(enumerate(texts)), "place int, text string")
    return rows.select(F.lit("div").alias("tag"), *[none.alias(c) for c in ("id_attribute", "classes", "aria_label", "role_attribute")], (F.col("place") + 5).alias("place"), "text", F.lit(0).alias("table_rows"), F.lit(0).alias("table_columns"))


def test_no_sign_is_missed(spark):
    words = {re.sub(r"(?<!\\)s\?", "s", w.replace(r"v\d+(?:\.\d+)*", "v1.2")) for p in EACH for w in re.sub(r"\\b\(\?:|\)\\b", "|", p).split("|") if w}
    words = {w.replace(r"[$€£]", "€").replace(r"\s?", " ").replace(r"\d", "7") for w in words}
    texts = [t for w in sorted(words) for t in (w, f"one {w} two", f"one.{w}.two", f"é{w}é", f"one{w}two", f"{w}9", f"5{w}", f"_{w}")] + ["", "Nothing at all", "20/hr", "20 /hr", "a/hrs"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = rows.select("text", F.col("text").rlike(blocks.SIGNS).alias("some"), F.col("text").rlike(blocks.NEGATIVES).alias("against"), *[F.col("text").rlike(T.ascii_words(p)).alias(f"p{i}") for i, p in enumerate(EACH)]).collect()
    assert all(r.some or not any(r[3:]) for r in found) and all(r.against or not any(r[8:]) for r in found)
    assert sum(not r.some for r in found) > len(words) and all(any(r[3:]) for r in found if r.text in words - {"/hr"})


def test_one_search_for_texts_without_signs(spark):
    rows = blocks.classified(_rows(spark, ["Nothing at all", "Pro plan $7", "Paid 20/hr", "Frequently asked"]), F.lit("unknown"))
    assert [r.role for r in rows.orderBy("place").collect()] == ["unknown", "pricing_card", "job_example", "faq"]
    #: The test of both sides of a word, which is slow, is left to the one pattern that begins a word with a sign.
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|") <= 4
