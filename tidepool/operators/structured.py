"""Prices that a page states in a structure: tables, cards and arrays in scripts, and their merge with prices in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.functions import money
from tidepool.operators import extract
from tidepool.sources import dom

#: What is no name of a plan, units of a price and of a limit, modes of billing; fixed values.
NO_NAME = r"(?i)^(plan|plans|price|pricing|tier|features?|limits?|monthly|yearly|per month|per year|included|yes|no|-|–)?$"
UNIT = r"(?i)(?:/|per)\s*(user|seat|member|site|project)\b"
USAGE = r"(?i)\b(pageviews?|requests?|events?|credits?|messages?|gb)\b"
#: Sources of plans: the first that names a plan counts.
SOURCES = ("table", "card", "heading", "script")


def unit(text: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(text, UNIT, 1)), F.lit(""))


def billing_mode(text: Column) -> Column:
    return F.when(text.rlike(extract.CONTACT), "contact").when(text.rlike(USAGE) & text.rlike(r"(?i)\bper\b"), "usage").when(unit(text).isNotNull(), "per_unit").otherwise("flat")


def script_arrays(markup: Column) -> Column:
    """Texts of the arrays of objects that scripts of a page assign."""
    return F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(extract.SCRIPT_ARRAY), F.lit(1))


def plans_of_arrays(pages: DataFrame) -> DataFrame:
    """Plans of (page_id, arrays); arrays that don't parse and objects without a name or price drop out."""
    rows = pages.select("page_id", F.posexplode("arrays").alias("_at", "_text"))
    rows = rows.select("page_id", "_at", F.posexplode(F.from_json("_text", "array<struct<name:string,price:double,currency:string,period:string>>")).alias("_i", "x")).filter("x.name is not null and x.price is not null")
    none = lambda t: F.lit(None).cast(t)
    return rows.select("page_id", F.lit("script").alias("source"), (F.col("_at") * 1000 + F.col("_i")).cast("int").alias("ord"), F.col("x.name").alias("plan"), F.col("x.price").alias("price"), F.upper("x.currency").alias("currency"), F.coalesce("x.period", F.lit("unknown")).alias("billing_period"), none("string").alias("unit"), F.lit("flat").alias("mode"), F.array().cast("array<string>").alias("limits"))


def plans(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per plan and price of a page's structures: page_id, plan, price, currency, billing_period, unit,
    mode, limits, source, plan_id.

    A row of a table or a card names a plan in its heading or its first cell that is neither a price nor a
    label; its price is the first in it. Rows without a price stay if they are by contact (no price) or free
    (0). A plan that several sources name at one price counts once, from the first of SOURCES.
    """
    rows = dom.part(dom.parsed(pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")), parts=("structures",)), "structures")
    return plans_of(rows, plans_of_arrays(pages.select(F.col(id_col).alias("page_id"), script_arrays(F.col(html_col)).alias("arrays"))))


def plans_of(rows: DataFrame, scripted: DataFrame) -> DataFrame:
    """Plans of the structures of pages and of their scripts, as in plans()."""
    #: What stands under a heading is a plan only if the heading names one.
    rows = rows.filter((F.col("source") != "heading") | F.col("heading").rlike(extract.PLAN_NAME))
    body = F.array_join("cells", "\n")
    bare = lambda x: ~x.rlike(money.PRICE) & ~F.trim(x).rlike(NO_NAME)
    name = F.coalesce(F.when(F.trim("heading") != "", F.trim("heading")), F.trim(F.get(F.filter("cells", bare), F.lit(0))))
    rows = rows.withColumns({"_body": body, "plan": name, "_p": F.get(F.filter(money.prices(F.array_join("cells", " | ")), lambda p: p["currency"].isNotNull()), F.lit(0))}).filter("plan is not null")
    contact, free = F.col("_body").rlike(extract.CONTACT), F.concat_ws("\n", "plan", "_body").rlike(extract.FREE_PLAN)
    rows = rows.withColumn("price", F.when(F.col("_p").isNotNull(), F.col("_p.amount")).when(~contact & free, 0.0)).filter(F.col("price").isNotNull() | contact)
    limits = F.slice(F.regexp_extract_all("_body", F.lit(extract.LIMIT), F.lit(0)), 1, 8)
    rows = rows.select("page_id", "source", "ord", "plan", "price", F.col("_p.currency").alias("currency"), money.period(F.col("_body")).alias("billing_period"), unit(F.col("_body")).alias("unit"), billing_mode(F.col("_body")).alias("mode"), limits.alias("limits"))
    rows = rows.unionByName(scripted)
    place = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source"))
    first = W.partitionBy("page_id", F.lower("plan"), "price", "billing_period").orderBy(place, "ord")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    key = F.concat_ws(":", F.lower("plan"), F.coalesce(F.format_string("%.2f", "price"), F.lit("")), "billing_period")
    return rows.withColumn("plan_id", F.substring(F.sha1(key), 1, 12))


def merged(structured: DataFrame, fallback: DataFrame) -> DataFrame:
    """Plans of a page by name from its structures, completed by those from its text: what a structure
    doesn't know comes from the text, limits of both are joined."""
    side = lambda df, p: df.groupBy("page_id", F.lower("plan").alias("_name")).agg(
        F.min("plan").alias(f"{p}plan"), F.min("price").alias(f"{p}price"), F.min("currency").alias(f"{p}currency"), F.min(F.when(F.col("billing_period") != "unknown", F.col("billing_period"))).alias(f"{p}period"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("limits")))).alias(f"{p}limits"),
    )
    rows = side(structured, "_a_").join(side(fallback, "_b_"), ["page_id", "_name"], "full_outer")
    both = lambda c: F.coalesce(f"_a_{c}", f"_b_{c}").alias("billing_period" if c == "period" else c)
    none = F.array().cast("array<string>")
    limits = F.array_sort(F.array_union(F.coalesce("_a_limits", none), F.coalesce("_b_limits", none)))
    found = F.when(F.col("_a_plan").isNull(), "text").when(F.col("_b_plan").isNull(), "structure").otherwise("both")
    return rows.select("page_id", both("plan"), both("price"), both("currency"), both("period"), limits.alias("limits"), found.alias("found_in"))


def model(offered: DataFrame) -> DataFrame:
    """The pricing model of each page's merged plans: status, lowest and highest monthly price, completeness."""
    month = money.monthly(F.col("price"), F.col("billing_period"))
    rows = offered.groupBy("page_id").agg(F.count("*").alias("plans"), F.count("price").alias("priced"), F.round(F.min(F.when(F.col("price") > 0, month)), 4).alias("lowest"), F.round(F.max(F.when(F.col("price") > 0, month)), 4).alias("highest"), F.count(F.nullif("billing_period", F.lit("unknown"))).alias("_dated"), F.sum((F.size("limits") > 0).cast("int")).alias("_limited"))
    complete = F.round(40 * F.col("priced") / F.col("plans") + 30 * F.col("_dated") / F.col("plans") + 30 * F.col("_limited") / F.col("plans")).cast("int")
    return rows.select("page_id", F.when(F.col("priced") > 0, "public_pricing").otherwise("contact_sales").alias("status"), "plans", "lowest", "highest", complete.alias("completeness"))
