"""Profiles of businesses from analysed pages: hash trees, follow-ups, what wasn't found, what to watch, a compact form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepool.operators import validate

#: Sections of a profile with the names under which their changes are told; fixed values.
SECTIONS = (("monetization", "pricing"), ("product_summary", "positioning"), ("conversion", "cta"), ("product_capabilities", "features"), ("momentum", "momentum"), ("availability", "availability"))
#: Why nothing was found, in order; fixed values.
REASONS = (
    "No public pricing detected after scanning homepage, pricing candidates, plan-like sections, metadata, linked pages, and sitemap links.",
    "Positioning unclear after checking title, metadata, H1/H2 headings, hero copy, semantic sections, and visible text fallback.",
    "No clear CTA detected after checking hero buttons, important links, semantic buttons, and repeated conversion links.",
    "Not enough feature information detected after scanning feature sections, product pages, cards, headings, and visible text fallback.",
    "No changelog/update page detected after checking update-like URLs, page titles, release language, dates, and sitemap candidates.",
)
#: What to watch where something was found and where nothing was, in order; fixed values.
WATCH = (
    ("Watch pricing page for plan, price, and packaging changes.", "Watch public pages for newly exposed pricing or contact-sales shifts."),
    ("Watch homepage hero for positioning and target-customer shifts.", "Add a product or homepage URL if positioning remains unclear."),
    ("Watch changelog for release momentum and shipped feature themes.", "Add an updates or changelog page if one exists."),
    ("Watch CTA strategy for self-serve, demo, or sales-led shifts.", "Watch hero buttons and signup links for CTA strategy changes."),
)
#: What a compact profile says where nothing is known; fixed values.
UNCLEAR = {"what": "Positioning unclear from public page content.", "who": "Target customer unclear.", "price": "No public pricing detected", "sales": "Contact sales detected", "cta": "No clear CTA detected", "themes": "Feature themes unclear", "updates": ("Public updates/changelog detected", "No changelog/update page detected")}
LEAST_FEATURES = 3


def profiles(analyses: DataFrame) -> DataFrame:
    """(page_id, profile): an analysed page as a nested profile of six sections."""
    plan = lambda p: F.concat_ws(" ", p["plan"], F.format_string("%.2f", p["price"]), p["currency"], p["billing_period"])
    status = F.col("pricing.status")
    seen = F.when(status == "public_pricing", "public").when(status == "contact_sales", "contact_sales").otherwise("unknown")
    contact = F.exists("plans", lambda p: p["price"].isNull())
    kind = F.when(status == "public_pricing", F.when(contact, "mixed").otherwise("fixed")).when(status == "contact_sales", "contact_sales").otherwise("unknown")
    labels, names = F.transform("actions", lambda a: a["label"]), F.transform("features", lambda f: f["name"])
    themes = F.array_distinct(F.transform(names, lambda n: validate.first_match(F.lower(n), validate.FEATURE_CATEGORIES, "product")))
    profile = F.struct(
        F.struct(seen.alias("pricing_visibility"), kind.alias("pricing_model"), F.transform("plans", plan).alias("plans"), F.col("pricing.lowest").alias("lowest")).alias("monetization"),
        F.struct(F.lit(None).cast("string").alias("category"), F.array().cast("array<string>").alias("target_customers"), F.transform("claims", lambda c: c["headline"]).alias("value_props")).alias("product_summary"),
        F.struct(F.get(labels, F.lit(0)).alias("primary_cta"), F.slice(labels, 2, 5).alias("secondary_ctas")).alias("conversion"),
        F.struct(names.alias("features"), themes.alias("feature_categories")).alias("product_capabilities"),
        F.struct((F.size("releases") > 0).alias("changelog_detected"), F.get(F.transform("releases", lambda r: r["released"]), F.lit(0)).alias("latest")).alias("momentum"),
        F.struct(F.col("validity").alias("status")).alias("availability"),
    )
    return analyses.select("page_id", profile.alias("profile"))


def hashed(rows: DataFrame, profile: str = "profile") -> DataFrame:
    """Rows with `hashes`: root, one for each section, one for each field by its path; a node's hash is that of its
    children's, so equal hashes mean equal branches."""
    kind: StructType = rows.schema[profile].dataType
    value = lambda path: F.sha2(F.coalesce(F.to_json(F.struct(F.col(f"{profile}.{path}").alias("v"))), F.lit("")), 256)
    fields = {s.name: [f"{s.name}.{f.name}" for f in s.dataType.fields] for s in kind.fields}
    leaves = F.struct(*[F.struct(*[value(p).alias(p.split(".")[1]) for p in paths]).alias(s) for s, paths in fields.items()])
    rows = rows.withColumn("_leaves", leaves)
    sections = F.struct(*[F.sha2(F.concat(*[F.col(f"_leaves.{p}") for p in paths]), 256).alias(s) for s, paths in fields.items()])
    rows = rows.withColumn("_sections", sections)
    root = F.sha2(F.concat(*[F.col(f"_sections.{s}") for s in fields]), 256)
    return rows.withColumn("hashes", F.struct(root.alias("root"), F.col("_sections").alias("sections"), F.col("_leaves").alias("fields"))).drop("_sections", "_leaves")


def follow_up(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, status, changed_models, changed_paths) of hashed profiles against the ones before: new_baseline without one,
    unavailable where the new one is missing, else no_meaningful_change or model_changed with what differs.

    Equal roots end the comparison, equal sections that of their fields: only branches that differ are opened."""
    fields = {s.name: [f.name for f in s.dataType.fields] for s in old.schema["hashes"].dataType["fields"].dataType.fields}
    rows = old.select(key, F.col("hashes").alias("_old")).join(new.select(key, F.col("hashes").alias("_new")), key, "full_outer")
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    differs = lambda path: F.col(f"_old.{path}") != F.col(f"_new.{path}")
    none = F.array().cast("array<string>")
    models = F.array_compact(F.array(*[F.when(differs(f"sections.{s}"), told) for s, told in SECTIONS]))
    paths = F.flatten(F.array(*[F.when(differs(f"sections.{s}"), F.array_compact(F.array(*[F.when(differs(f"fields.{s}.{f}"), F.lit(f"{s}.{f}")) for f in fields[s]]))).otherwise(none) for s, _ in SECTIONS]))
    changed = both & differs("root")
    status = F.when(F.col("_new").isNull(), "unavailable").when(F.col("_old").isNull(), "new_baseline").when(changed, "model_changed").otherwise("no_meaningful_change")
    return rows.select(key, status.alias("status"), F.when(changed, models).otherwise(none).alias("changed_models"), F.when(changed, paths).otherwise(none).alias("changed_paths"))


def _found(p: str) -> tuple[Column, ...]:
    """Whether pricing, positioning, releases and a call to action were found."""
    return (
        F.col(f"{p}.monetization.pricing_visibility").isin("public", "partially_public"), F.size(f"{p}.product_summary.value_props") > 0,
        F.col(f"{p}.momentum.changelog_detected"), F.col(f"{p}.conversion.primary_cta").isNotNull(),
    )


def reasons(p: str = "profile") -> Column:
    """Why sections of a profile are empty, at most five sentences."""
    _, claimed, released, called = _found(p)
    missing = (
        F.col(f"{p}.monetization.pricing_visibility").isin("unknown", "hidden"), F.col(f"{p}.product_summary.category").isNull() & ~claimed, ~called,
        F.size(f"{p}.product_capabilities.features") < LEAST_FEATURES, ~released,
    )
    return F.array_compact(F.array(*[F.when(m, F.lit(r)) for m, r in zip(missing, REASONS)]))


def watchlist(p: str = "profile") -> Column:
    """What to watch next: one suggestion for pricing, positioning, releases and calls to action."""
    return F.array_distinct(F.array(*[F.when(found, a).otherwise(b) for found, (a, b) in zip(_found(p), WATCH)]))


def compact(p: str = "profile") -> Column:
    """A profile in six short fields."""
    priced, _, released, _ = _found(p)
    field = lambda path: F.col(f"{p}.{path}")
    listed = lambda path, other: F.when(F.size(field(path)) > 0, F.array_join(field(path), ", ")).otherwise(other)
    return F.struct(
        F.coalesce(F.get(field("product_summary.value_props"), F.lit(0)), F.lit(UNCLEAR["what"])).alias("what_it_does"),
        listed("product_summary.target_customers", F.coalesce(field("product_summary.category"), F.lit(UNCLEAR["who"]))).alias("who_it_serves"),
        F.when(priced, F.concat(field("monetization.pricing_model"), F.lit(" pricing visible"))).when(field("monetization.pricing_visibility") == "contact_sales", UNCLEAR["sales"]).otherwise(UNCLEAR["price"]).alias("monetization"),
        F.coalesce(field("conversion.primary_cta"), F.lit(UNCLEAR["cta"])).alias("primary_cta"), listed("product_capabilities.feature_categories", F.lit(UNCLEAR["themes"])).alias("feature_themes"),
        F.when(released, UNCLEAR["updates"][0]).otherwise(UNCLEAR["updates"][1]).alias("update_presence"),
    )
