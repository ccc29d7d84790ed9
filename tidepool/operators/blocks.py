"""Blocks of pages: what each is for, how much it counts as evidence, its tree, groups of siblings, cards, dialogs, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as T

#: What blocks say, and what speaks against a block with the role it then has; fixed values.
PRICING = r"\b(?:pricing|price|prices|plans?|packages?|tiers?|billing|monthly|yearly|annually|subscription|upgrade|subscribe|checkout|starter|plus|pro|business|enterprise|free plan)\b|[$€£]\s?\d|\d\s?[$€£]|\b(?:usd|eur|gbp)\b"
FEATURE = r"\b(?:features?|capabilities|platform|workflow|automation|integrations?|dashboard|analytics|alerts|templates|collaboration|api|security|reports?|proposal|generator|personalized|client-ready|writing sample)\b"
ACTION = r"\b(?:start free|start trial|get started|sign up|signup|book demo|schedule demo|contact sales|talk to sales|try free|download|upgrade|buy now|get plus|get pro)\b"
CHANGELOG = r"\b(?:changelog|updates?|release notes?|releases?|shipped|fixed|improved|new in|version|v\d+(?:\.\d+)*)\b"
NEGATIVE = (
    ("navigation", "navigation", r"\b(?:nav|navbar|navigation|menu)\b"),
    ("footer", "footer", r"\b(?:footer|contentinfo|copyright|all rights reserved)\b"),
    ("legal", "legal", r"\b(?:privacy policy|terms of service|cookie policy|legal)\b"),
    ("cookie_banner", "cookie", r"\b(?:cookies?|consent|accept all|reject all)\b"),
    ("testimonial", "testimonial", r"\b(?:testimonial|review|rated|stars|what customers say)\b"),
    ("case_study", "case_study", r"\b(?:case study|customer story|client story)\b"),
    ("proposal_sample", "proposal_sample", r"\b(?:proposal sample|sample proposal|generated proposal|example proposal)\b"),
    ("example_output", "example_output", r"\b(?:example output|sample output|generated output|example result)\b"),
    ("job_example", "job_example", r"\b(?:upwork|freelancer|hiring|project budget|per article|hourly|/hr)\b"),
    ("blog_content", "blog", r"\b(?:blog|read more|published|author)\b"),
)
#: Signs that decide even beside prices, and finer signs of a role; fixed values.
DECIDING = ("proposal_sample", "job_example", "case_study", "testimonial", "example_output")
TOGGLE, PLAN_CARD, COMPARED = r"\b(?:toggle|monthly|yearly|annually)\b", r"\b(?:card|plan|tier|starter|plus|pro|business|enterprise|free)\b", r"\b(?:compare|comparison)\b"
RELEASE, CONNECTED, HERO, QUESTIONS = r"\b(?:release notes?|version|v\d+(?:\.\d+)*)\b", r"\b(?:integration|connect|api)\b", r"\bhero|masthead\b", r"\b(?:faq|frequently asked)\b"
#: Prices, plan words and words that speak against a price near a block, at most so many of each; fixed values.
NEAR_PRICES = r"(?:[$€£]\s?\d[\d,.]*|\d[\d,.]*\s?[$€£]|\b(?:usd|eur|gbp)\s?\d[\d,.]*|\d[\d,.]*\s?(?:usd|eur|gbp)\b)"
NEAR_PLANS = r"\b(?:free|starter|basic|plus|pro|premium|team|business|growth|scale|enterprise|custom|plan|tier|package)\b"
NEAR_NEGATIVE = r"\b(?:example|sample|proposal|testimonial|case study|customer story|job|budget|upwork|freelancer|article|quote|project)\b"
MOST_NEAR = 12
#: What a block's score gains or loses, and roles that never count for more than so much; fixed values.
GAINS = (("prices", 0.08), ("plan_words", 0.06), ("buttons", 0.04), ("negative_words", -0.25))
NEVER, NEVER_SCORE = ("testimonial", "case_study", "proposal_sample", "job_example", "example_output"), 0.25
#: The older kinds of blocks, the first whose words a block has; fixed values.
OLDER_PRICE = r"[$€£]\s?\d|\d\s?[$€£]|\b(?:eur|usd|gbp)\b\s?\d|\d\s?\b(?:eur|usd|gbp)\b|\b(?:pricing|price|prices|plan|plans|package|packages|tier|starter|plus|pro|premium|enterprise|upgrade|billing|subscription)\b"
OLDER_AUTH = r"\b(?:login|log in|sign in|password|account|dashboard)\b"
OLDER = (
    ("changelog", 0.82, r"\b(?:changelog|updates|release notes|release-notes|releases|shipped|fixed|improved|new in)\b"),
    ("features", 0.74, r"\b(?:feature|features|integration|automation|workflow|dashboard|analytics|templates|alerts|personalization|voice|proposal|generation|matching)\b"),
    ("faq", 0.70, QUESTIONS),
    ("comparison", 0.66, r"\b(?:compare|versus|alternative)\b"),
    ("cta", 0.68, r"\b(?:start free|sign up|signup|get started|book demo|schedule demo|contact sales|try free|upgrade|download|join|get plus)\b"),
)


def says(text: Column, pattern: str) -> Column:
    """Whether a lower-case text has the pattern."""
    return text.rlike(T.ascii_words(pattern))


#: What a text must have to have any of the signs of a role.
NEGATIVES = T.any_of(*[p for _, _, p in NEGATIVE])
SIGNS = T.any_of(PRICING, FEATURE, ACTION, CHANGELOG, QUESTIONS, *[p for _, _, p in NEGATIVE])


def classified(rows: DataFrame, page_type: Column) -> DataFrame:
    """Blocks with role, confidence, positive_signals and negative_signals: what speaks against a block counts first,
    beside prices only if it decides; then tables of prices, prices, releases, features, calls to action, place."""
    attrs = F.concat_ws(" ", "tag", F.nullif("id_attribute", F.lit("")), F.nullif("classes", F.lit("")), F.nullif("aria_label", F.lit("")), F.nullif("role_attribute", F.lit("")))
    rows = rows.withColumns({"_attrs": attrs, "_page": page_type}).withColumn("_all", F.lower(F.concat_ws("\n", "_attrs", "text")))
    #: One search for all signs; only texts that have one are searched for each. Toggles count beside prices only.
    rows = rows.withColumn("_any", F.col("_all").rlike(SIGNS))
    said = {f"_{name}": F.col("_any") & says(F.col("_all"), p) for name, p in (("pricing", PRICING), ("feature", FEATURE), ("action", ACTION), ("changelog", CHANGELOG), ("toggle", TOGGLE))}
    rows = rows.withColumns(said | {"_some": F.col("_any") & F.col("_all").rlike(NEGATIVES)})
    rows = rows.withColumns({f"_n{i}": F.col("_some") & says(F.col("_all"), p) for i, (_, _, p) in enumerate(NEGATIVE)})
    against = [F.col(f"_n{i}") & (F.lit(True) if signal in DECIDING else ~F.col("_pricing")) for i, (_, signal, _) in enumerate(NEGATIVE)]
    role, sure = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)

    def case(when: Column, name, confidence) -> None:
        nonlocal role, sure
        role, sure = role.when(when, name), sure.when(when, confidence)

    for (name, _, _), hit in zip(NEGATIVE, against):
        case(hit, name, 0.9)
    case(F.col("tag") == "nav", "navigation", 0.95)
    case(F.col("tag") == "footer", "footer", 0.95)
    case((F.col("table_rows") >= 2) & (F.col("table_columns") >= 2) & F.col("_pricing"), "pricing_table", 0.93)
    of = lambda kind, more, less: F.when(F.col("_page") == kind, more).otherwise(less)
    case(F.col("_pricing") & (says(F.col("_all"), PLAN_CARD) | (F.col("_page") == "pricing")), F.when(says(F.col("_all"), COMPARED), "plan_comparison").otherwise("pricing_card"), of("pricing", 0.92, 0.84))
    case(F.col("_pricing"), "pricing_section", 0.8)
    case(F.col("_changelog"), F.when(says(F.col("_all"), RELEASE), "release_note").otherwise("changelog_entry"), of("changelog", 0.9, 0.76))
    case(F.col("_feature"), F.when(says(F.col("_all"), CONNECTED), "integration_section").otherwise("feature_card"), of("features", 0.86, 0.74))
    case(F.col("_action"), "cta_section", F.when(F.col("place") <= 3, 0.82).otherwise(0.68))
    case(F.col("tag").isin("header", "main") | says(F.lower("_attrs"), HERO) | (F.col("place") <= 1), "hero", 0.72)
    case(F.col("_any") & says(F.col("_all"), QUESTIONS), "faq", 0.72)
    rows = rows.withColumns({"role": role.otherwise("unknown"), "confidence": sure.otherwise(0.42)})
    earlier = lambda i: F.coalesce(*[F.when(h, True) for h in against[:i]], F.lit(False)) if i else F.lit(False)
    negative = F.array_compact(F.array(*[F.when(F.col(f"_n{i}") & ~earlier(i), signal) for i, (_, signal, _) in enumerate(NEGATIVE)]))
    by_role = (
        F.when(F.col("role") == "pricing_table", F.array(F.lit("pricing_table"))).when(F.col("role").isin("plan_comparison", "pricing_card", "pricing_section"), F.array_compact(F.array(F.lit("pricing"), F.when(F.col("_toggle"), "billing_toggle"))))
        .when(F.col("role").isin("release_note", "changelog_entry"), F.array(F.lit("changelog"))).when(F.col("role").isin("integration_section", "feature_card"), F.array(F.lit("feature")))
        .when(F.col("role") == "cta_section", F.array(F.lit("cta"))).when(F.col("role") == "hero", F.array(F.lit("hero_position"))).otherwise(F.array().cast("array<string>"))
    )
    rows = rows.withColumns({"positive_signals": by_role, "negative_signals": negative})
    return rows.drop("_attrs", "_all", "_page", "_any", "_some", *said, *[f"_n{i}" for i in range(len(NEGATIVE))])


def evidence(rows: DataFrame) -> DataFrame:
    """Classified blocks with what is near (prices, plan_words, negative_words), evidence_score and block_score."""
    near = lambda p: F.slice(F.regexp_extract_all("text", F.lit("(?i)" + T.ascii_words(p)), F.lit(0)), 1, MOST_NEAR)
    rows = rows.withColumns({"prices": near(NEAR_PRICES), "plan_words": near(NEAR_PLANS), "negative_words": near(NEAR_NEGATIVE)})
    score = F.col("confidence")
    for name, gain in GAINS:
        score = score + F.when(F.size(name) > 0, gain).otherwise(0.0)
    score = F.when(F.col("role").isin(*NEVER), F.least(score, F.lit(NEVER_SCORE))).otherwise(score)
    own = F.least(F.lit(1.0), F.col("confidence") + F.size("buttons") * 0.02 + F.size("link_urls") * 0.01)
    return rows.withColumns({"evidence_score": F.round(own, 2), "block_score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)})


def older_kind(rows: DataFrame) -> DataFrame:
    """Blocks with the older kinds (kind, kind_confidence): navigation, footer, sign-in, pricing, then by words."""
    attrs = F.lower(F.concat_ws(" ", "tag", F.nullif("id_attribute", F.lit("")), F.nullif("classes", F.lit("")), F.nullif("role_attribute", F.lit("")), F.nullif("aria_label", F.lit(""))))
    rows = rows.withColumn("_every", F.lower(F.concat_ws("\n", attrs, "text", F.array_join("buttons", "\n"))))
    every = F.col("_every")
    kind, sure = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    cases = [
        ("nav", 0.92, (F.col("tag") == "nav") | attrs.rlike(T.ascii_words(r"\bnav(?:igation)?\b|navbar|menu"))), ("footer", 0.92, (F.col("tag") == "footer") | attrs.rlike(T.ascii_words(r"\bfooter|contentinfo\b"))),
        ("auth", 0.82, ~says(every, OLDER_PRICE) & says(every, OLDER_AUTH)), ("pricing", 0.88, says(every, OLDER_PRICE)), *[(k, c, says(every, p)) for k, c, p in OLDER],
        ("hero", 0.72, (F.col("tag") == "header") | attrs.rlike(T.ascii_words(HERO)) | (F.col("place") <= 1)),
    ]
    for name, confidence, when in cases:
        kind, sure = kind.when(when, name), sure.when(when, confidence)
    return rows.withColumns({"kind": kind.otherwise("unknown"), "kind_confidence": sure.otherwise(0.45)}).drop("_every")


#: Elements and words that make an older block, and how many of a page count; fixed values.
OLDER_TAGS, OLDER_CLASS, OLDER_MOST = ("nav", "footer", "header", "section", "article", "form", "dialog", "table"), r"modal|pricing|price|plan|feature|hero|cta|changelog", 120


def is_older() -> Column:
    return F.col("tag").isin(*OLDER_TAGS) | F.coalesce(F.concat_ws(" ", "classes", "id_attribute").rlike(OLDER_CLASS), F.lit(False)) | (F.col("role_attribute") == "dialog")


def block_id(page: Column) -> Column:
    return F.concat(page.cast("string"), F.lit(":"), F.col("block_hash"))


def tree(rows: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The skeleton of each page's blocks: the block around each one, heading chain, role, group, children."""
    chain = F.col("heading_chain")
    return rows.select(id_col, "place", F.col("inside").alias("inside_place"), F.get(chain, F.size(chain) - 2).alias("parent_heading"), chain, "role", "sibling_group", "child_count")


def sibling_groups(rows: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Blocks of a page by the group of siblings they stand in, with how many have which role."""
    group = F.coalesce("sibling_group", F.lit("ungrouped")).alias("sibling_group")
    counted = rows.groupBy(id_col, group, "role").agg(F.count("*").alias("n"), F.min("place").alias("_first"))
    roles = F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n"))))
    return counted.groupBy(id_col, "sibling_group").agg(F.sum("n").alias("blocks"), F.min("_first").alias("first_place"), roles.alias("roles"))


def is_card() -> Column:
    named = F.concat_ws(" ", "classes", "id_attribute", "heading")
    return named.rlike("(?i)card|tile|plan|tier") | F.col("role").isin("pricing_card", "feature_card")


def is_modal() -> Column:
    return (F.col("visibility") == "modal") | F.concat_ws(" ", "classes", "role_attribute").rlike("(?i)modal|dialog")


def is_table() -> Column:
    return (F.col("table_rows") >= 2) & (F.col("table_columns") >= 2)
