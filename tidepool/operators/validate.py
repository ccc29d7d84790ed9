"""What kind of page, product or line something is: scored types, categories, trust, signals, context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.functions import urls

#: Words of each type of page, in path and text; fixed values.
TYPE_WORDS = (
    ("homepage", r"(?i)\b(?:homepage|home)\b"),
    ("pricing", r"(?i)\b(?:pricing|price|prices|plans?|packages?|subscription|billing|tarifs|prix|choose plan|compare plans)\b"),
    ("features", r"(?i)\b(?:features?|capabilities|integrations?|workflow|automation|platform features)\b"),
    ("product", r"(?i)\b(?:product|platform|solution|use cases?|what it does)\b"),
    ("changelog", r"(?i)\b(?:changelog|updates|release notes?|releases|shipped|fixed|improved|new in)\b"),
    ("docs", r"(?i)\b(?:docs?|documentation|api reference|help center|support center|guides?)\b"),
    ("blog", r"(?i)\b(?:blog|articles?|news|guides?|tutorials?)\b"),
    ("case_study", r"(?i)\b(?:case stud(?:y|ies)|customer stor(?:y|ies)|success stor(?:y|ies))\b"),
)
#: What the root, the path and the text add to a type's score; scores from which a type is detected and verified; fixed values.
ROOT, IN_PATH, IN_TEXT, MOST, DETECTED, VERIFIED = 0.72, 0.45, 0.24, 0.98, 0.52, 0.58
#: Which detected types each requested one accepts besides itself; fixed values.
ACCEPTS = {"homepage": ("features", "pricing", "changelog")}
#: Types of a path for the administrator, first match counts, else product; fixed values.
ADMIN_TYPES = (("pricing", r"pricing|plans|packages|tarifs|prix|billing"), ("features", r"features|product|platform|solutions|use-cases"), ("changelog", r"changelog|updates|release-notes|releases"), ("docs", r"docs|help|support|api"))
#: Categories of features, first match counts; they match inside words, too; fixed values.
FEATURE_CATEGORIES = (
    ("AI", r"ai|generation|assistant|copilot|personaliz"), ("analytics", r"analytics|report|dashboard|metric"), ("collaboration", r"collaboration|team|permission|role"), ("integrations", r"integration|api|webhook|sync"),
    ("monitoring", r"alert|monitor|tracking|status|uptime"), ("payments", r"payment|billing|checkout|subscription"), ("content generation", r"template|content|editor|proposal|email"), ("automation", r"automat|workflow|runbook"),
)
#: Market categories by words, in order; fixed values.
MARKETS = (
    ("proposal software", r"proposal|freelance|client brief"), ("analytics", r"analytics|metrics|web analytics|dashboard"), ("website builder", r"website builder|landing page|no-code site"), ("monitoring", r"monitoring|alerts|uptime|status page|competitor"),
    ("email marketing", r"email|newsletter|transactional"), ("customer support", r"support|helpdesk|chat|inbox"), ("forms", r"forms|survey|submissions"), ("payments", r"payments|checkout|billing|subscription"), ("scheduling", r"calendar|scheduling|book meetings"),
)
#: Lines that speak of trust; fixed values.
TRUST = (
    ("user_counts", r"(?i)\b\d{2,6}(?:,\d{3})?\s+(?:customers|users|teams|companies|creators|agencies)\b"), ("review_mentions", r"(?i)\b(?:reviews?|rated|stars?|g2|capterra|testimonial)\b"),
    ("security_mentions", r"(?i)\b(?:security|secure|encryption|privacy|sso|audit)\b"), ("compliance_mentions", r"(?i)\b(?:soc\s?2|gdpr|hipaa|iso\s?27001|compliance|dpa)\b"),
)
#: Lines that show testimonials and customers' logos; signs of how a product is sold; fixed values.
TRUST_SIGNS = (("testimonials_detected", r"(?i)testimonial|customer story|what customers say"), ("customer_logos_detected", r"(?i)trusted by|used by|customers include"))
BUSINESS_SIGNS = (("sales-led", "contact sales"), ("free tier", "free"))
#: Signals of a block; what each adds to its score; roles that stay low; fixed values.
NEAR_PRICES = r"(?i)(?:[$€£]\s?\d[\d,.]*|\d[\d,.]*\s?[$€£]|\b(?:usd|eur|gbp)\s?\d[\d,.]*|\d[\d,.]*\s?(?:usd|eur|gbp)\b)"
NEAR_PLANS = r"(?i)\b(?:free|starter|basic|plus|pro|premium|team|business|growth|scale|enterprise|custom|plan|tier|package)\b"
NEAR_NEGATIVE = r"(?i)\b(?:example|sample|proposal|testimonial|case study|customer story|job|budget|upwork|freelancer|article|quote|project)\b"
SIGNALS_MOST = 12
LOW_ROLES = ("testimonial", "case_study", "proposal_sample", "job_example", "example_output")


def type_scores(url: Column, text: Column, boosts: dict[str, Column] | None = None) -> Column:
    """(type, score) of the eight types of a page, in their order."""
    signal, root = urls.path_signal(url), F.regexp_replace(urls.part(url, 3), "/+$", "") == ""
    out = []
    for name, words in TYPE_WORDS:
        score = F.when(signal.rlike(words), IN_PATH).otherwise(0.0) + F.when(text.rlike(words), IN_TEXT).otherwise(0.0)
        score = score + (F.when(root, ROOT).otherwise(0.0) if name == "homepage" else F.lit(0.0)) + ((boosts or {}).get(name, F.lit(0.0)))
        out.append(F.struct(F.lit(name).alias("type"), F.least(F.lit(MOST), score).alias("score")))
    return F.array(*out)


def detected(scores: Column) -> Column:
    """The type with the highest score, the first of equals, or unknown, with the score."""
    best = F.array_max(F.transform(scores, lambda x, i: F.struct(x["score"].alias("score"), (-i).alias("i"), x["type"].alias("type"))))
    return F.struct(F.when(best["score"] < DETECTED, "unknown").otherwise(best["type"]).alias("type"), F.round(best["score"], 2).alias("confidence"))


def type_status(requested: Column, found: Column, confidence: Column) -> Column:
    """verified, mismatch or unknown."""
    return F.when((requested == found) & (confidence >= VERIFIED), "verified").when(found == "unknown", "unknown").otherwise("mismatch")


def accepts(requested: Column, found: Column) -> Column:
    """Whether a page of the type found may stand for the one requested."""
    out = requested == found
    for name, others in ACCEPTS.items():
        out = out | ((requested == name) & found.isin(*others))
    return out | ((requested == "unknown") & ~found.isin("blocked", "missing"))


def first_match(text: Column, table, otherwise: str) -> Column:
    out = F.when(F.lit(False), "")
    for name, words in table:
        out = out.when(text.rlike(words), name)
    return out.otherwise(otherwise)


def admin_type(url: Column) -> Column:
    path = F.lower(urls.part(url, 3))
    return F.when(path.isin("", "/") & ~path.rlike("pricing"), "homepage").otherwise(first_match(path, ADMIN_TYPES, "product"))


def markets(text: Column) -> Column:
    """The categories whose words a text has, in order: the first is its market, the next three lie beside it."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(words), name) for name, words in MARKETS]))


def picked_lines(lines: Column, pattern: str, most: int = 6) -> Column:
    return F.slice(F.filter(lines, lambda x: F.char_length(x).between(4, 180) & x.rlike(pattern)), 1, most)


def near(text: Column, pattern: str) -> Column:
    """The first twelve matches of a block's signal."""
    return F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), 1, SIGNALS_MOST)


def block_score(role: Column, confidence: Column, text: Column, buttons: Column) -> Column:
    has = lambda pattern, weight: F.when(text.rlike(pattern), weight).otherwise(0.0)
    score = confidence + has(NEAR_PRICES, 0.08) + has(NEAR_PLANS, 0.06) + F.when(buttons > 0, 0.04).otherwise(0.0) + has(NEAR_NEGATIVE, -0.25)
    score = F.when(role.isin(*LOW_ROLES), F.least(score, F.lit(0.25))).otherwise(score)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)


def context_window(before: Column, match: Column, behind: Column) -> Column:
    """A match with its line and the lines beside it; of more than 180 characters 140 on either side."""
    squeezed = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    local = squeezed(F.concat(F.substring_index(before, "\n", -2), match, F.substring_index(behind, "\n", 2)))
    tail = F.substring(before, F.greatest(F.lit(1), F.char_length(before) - 139), F.lit(140))
    return F.when(F.char_length(local) > 180, squeezed(F.concat(tail, match, F.substring(behind, 1, 140)))).otherwise(local)


def html_escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def company(title: Column) -> Column:
    """What stands before the first bar, dash or colon of a title."""
    return F.nullif(F.trim(F.regexp_extract(title, r"^[^|:\-]*", 0)), F.lit(""))


def target_customer(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?i)\b(?:for|built for|made for)\s+([^.\n]{4,80})", 1)
    return F.nullif(F.trim(F.regexp_replace(found, r"\s+", " ")), F.lit(""))


def visible_text(html: Column) -> Column:
    """Markup without what isn't shown, navigation and footers, white space made single."""
    for tag in ("script", "style", "noscript", "svg", "template", "nav", "footer"):
        html = F.regexp_replace(html, f"(?is)<{tag}\\b[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def block_text(heading: Column, text: Column, *lists: Column) -> Column:
    """A block's heading, text and the texts of its buttons and links, a line each; nulls and empty ones left out."""
    return F.array_join(F.filter(F.concat(F.array(heading, text), *lists), lambda x: x != ""), "\n")


def analysis_blocks(pages: DataFrame, blocks: DataFrame, preferred: tuple[str, ...], id_col: str = "page_id") -> DataFrame:
    """(id, rank, role, text, confidence, source): blocks in the order in which analyses read them.

    Blocks (id, ord, role, text, confidence) of preferred roles come first, then the others, both by ord;
    navigation, footers and log-in forms take no part, null roles do. A page (id, text; ids unique and not
    null) of which nothing is left is one block of its text with confidence 0.4. Both sides meet in one shuffle.
    """
    kept = blocks.filter(~F.coalesce("role", F.lit("")).isin("nav", "footer", "auth")).select(id_col, "ord", "role", "text", F.col("confidence").cast("double").alias("confidence"), F.lit("model").alias("source"))
    whole = pages.select(id_col, F.lit(None).cast("int").alias("ord"), F.lit("unknown").alias("role"), "text", F.lit(0.4).alias("confidence"), F.lit("fallback").alias("source"))
    first = F.coalesce(F.col("role").isin(*preferred), F.lit(False))
    order = W.partitionBy(id_col).orderBy(F.col("source") == "fallback", ~first, "ord")
    rows = kept.unionByName(whole).withColumn("rank", F.row_number().over(order))
    return rows.filter("source = 'model' or rank = 1").select(id_col, "rank", "role", "text", "confidence", "source")


def business_signals(text: Column, features: Column) -> Column:
    """Categories of named features, then how the text says the product is sold, each once."""
    low = F.lower(text)
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(words)), name) for name, words in BUSINESS_SIGNS]))
    return F.array_distinct(F.concat(F.transform(features, lambda f: first_match(F.lower(f), FEATURE_CATEGORIES, "product")), found))
