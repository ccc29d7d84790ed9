"""What is shown of a page's models: price options, the best fact of each section, a summary, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.functions import money
from tidepool.functions import text as T

#: Analyses, and the verified types of pages that each runs on; fixed values.
GATES = (
    ("pricing", ("homepage", "pricing")), ("positioning", ("homepage", "product", "features")), ("cta", ("homepage", "pricing", "product")), ("features", ("homepage", "features", "product")),
    ("momentum", ("changelog",)), ("trust", ("homepage", "product")), ("category", ("homepage", "product", "features")),
)
#: Sections of a summary with the fields that can fill them, the first that has a fact counts; fixed values.
SECTIONS = (("positioning", ("headline", "value_proposition", "target")), ("pricing", ("lowest_price", "pricing_status")), ("cta", ("primary_cta",)), ("feature", ("feature",)))


def gates(page_type: Column, allowed: Column) -> list[Column]:
    """run_<analysis> for each analysis: nothing runs on a page that wasn't verified."""
    return [F.coalesce(allowed & page_type.isin(*types), F.lit(False)).alias(f"run_{name}") for name, types in GATES]


def money_text(price: Column, currency: Column, per: Column) -> Column:
    """0 is Free, no price is Contact sales."""
    amount = F.regexp_replace(F.format_string("%.2f", price), r"\.00$", "")
    shown = F.concat(F.when(currency == "USD", "$").when(currency == "EUR", "€").when(currency == "GBP", "£").otherwise(F.concat(F.coalesce(currency, F.lit("")), F.lit(" "))), amount)
    return F.when(price.isNull(), "Contact sales").when(price == 0, "Free").otherwise(F.concat(shown, F.when(per.isin("month", "year"), F.concat(F.lit(" / "), per)).otherwise("")))


def price_options(plans: DataFrame, most: int = 6) -> DataFrame:
    """The named options of each page, cheapest by the month first, those without a price last, each once."""
    rows = plans.filter(~F.col("plan").rlike(r"(?i)^(unnamed|plan \d+)$"))
    rows = rows.withColumn("_m", money.monthly(F.col("price"), F.col("billing_period")))
    first = W.partitionBy("page_id", F.lower("plan"), "price", "billing_period").orderBy("block_id")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    order = W.partitionBy("page_id").orderBy(F.col("_m").asc_nulls_last(), "plan", "block_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return rows.select("page_id", "rank", "plan", money_text(F.col("price"), F.col("currency"), F.col("billing_period")).alias("price_text"), "kind")


def display_status(accepted: Column, shown: Column) -> Column:
    """Nothing is shown that wasn't accepted."""
    return F.when(F.size(F.array_except(shown, accepted)) > 0, "blocked").when(F.size(shown) == 0, F.when(F.size(accepted) == 0, "none").otherwise("hidden")).otherwise("shown")


def best_by_section(facts: DataFrame, key: str) -> DataFrame:
    """The fact that fills each section of each entity: by score, then by the order of the fields, then by place."""
    place = F.lit(None).cast("string")
    rank = F.lit(None).cast("int")
    for name, fields in SECTIONS:
        for k, field in enumerate(fields):
            place, rank = F.when(F.col("field") == field, name).otherwise(place), F.when(F.col("field") == field, k).otherwise(rank)
    rows = facts.withColumns({"section": place, "_rank": rank}).filter("section is not null and value is not null")
    w = W.partitionBy(key, "section").orderBy(F.desc("score"), "_rank", "ord")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(key, "section", "field", "value", "score")


def summary(best: DataFrame, key: str) -> DataFrame:
    """One sentence an entity, section by section, and the sections that nothing is known of."""
    order = F.lit(99)
    for k, (name, _) in enumerate(SECTIONS):
        order = F.when(F.col("section") == name, k).otherwise(order)
    rows = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "section", "value"))).alias("_s"))
    known = F.transform("_s", lambda x: x["section"])
    text = F.array_join(F.transform("_s", lambda x: F.concat(F.initcap(x["section"]), F.lit(": "), T.truncated(x["value"], 130, "…"))), ". ")
    return rows.select(key, text.alias("summary"), F.array_except(F.array(*[F.lit(n) for n, _ in SECTIONS]), known).alias("unknown"))


def page_facts(pricing: DataFrame, ctas: DataFrame, claims: DataFrame, named: DataFrame) -> DataFrame:
    """Models of pages as rows of facts: (page_id, field, value, score, ord)."""
    row = lambda df, field, value, score, at: df.select("page_id", F.lit(field).alias("field"), F.col(value).cast("string").alias("value"), (F.col(score) if isinstance(score, str) else F.lit(score)).alias("score"), (F.col(at) if isinstance(at, str) else F.lit(at)).cast("int").alias("ord"))
    parts = [row(claims, "headline", "headline", "score", 0), row(pricing, "pricing_status", "status", 0.6, 1), row(pricing.filter("lowest is not null"), "lowest_price", "lowest", 0.9, 0)]
    parts += [row(ctas.filter("rejected is null"), "primary_cta", "label", "score", "rank"), row(named, "feature", "name", "score", "rank")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
