"""Entities in blocks (prices, plans, calls to action, features, releases) and models of pages built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.functions import money
from tidepool.functions import text as T
from tidepool.operators import scoring

#: Roles in which an amount can be a price, and in which it never is; fixed values.
PRICE_ROLES = ("pricing", "table")
NEVER_ROLES = ("testimonial", "case_study", "footer", "nav", "cookie")
#: What an amount's context adds to its score or takes from it; fixed values.
PRICE_START, PRICE_ROLE, PRICE_PAGE, ACCEPTED, PARTIAL = 0.48, 0.28, 0.12, 0.8, 0.6
PRICE_SIGNS = (
    (r"(?i)\b(monthly|yearly|annually|per month|per year|billing)\b|/(mo|month)\b", 0.12),
    (r"(?i)\b(starter|plus|pro|business|enterprise|free|plan|tier|package)\b", 0.10),
    (r"(?i)\b(subscribe|upgrade|get started|start free|choose plan|buy|get plus|get pro)\b", 0.08),
    (r"(?i)\b(customers|users|uptime|support|integrations|reviews|stars|founded|employees|downloads)\b|%", -0.30),
    (r"(?i)\b(example|sample|proposal|job|budget|case study|testimonial|client|article|freelancer|quote|per hour)\b|/hr\b", -0.55),
)
#: Names of plans, offers by contact, free plans and limits in a text; fixed values.
PLAN_NAME = r"(?i)\b(Free|Starter|Start|Basic|Plus|Pro|Professional|Premium|Team|Teams|Business|Growth|Scale|Enterprise|Custom|Agency|Creator|Launch|Personal|Core)\b"
CONTACT = r"(?i)\b(contact sales|custom pricing|talk to sales|enterprise)\b"
FREE_PLAN = r"(?i)\b(free forever|free plan|free tier)\b|(^|\n)\s*Free\s*(\n|$)"
LIMIT = r"(?i)\b\d[\d.,]*\s?k?\+?\s+(?:users?|seats?|projects?|pageviews?|requests?|events?|sites?|gb)\b"
#: Intents of calls to action, the first whose words it has; those that sell nothing; fixed values.
INTENTS = (
    ("start_trial", r"(?i)\b(start trial|try free|start free)\b"), ("book_demo", r"(?i)\b(book demo|schedule demo|request demo)\b"), ("contact_sales", r"(?i)\b(contact sales|talk to sales)\b"),
    ("sign_up", r"(?i)\b(sign up|signup|join)\b"), ("download", r"(?i)\bdownload\b"), ("view_pricing", r"(?i)\b(pricing|plans)\b"), ("get_started", r"(?i)\bget started\b"),
    ("upgrade_buy", r"(?i)\b(upgrade|buy|get plus|get pro|subscribe)\b"),
)
#: Labels that sell nothing; the order of roles in which calls count; fixed values.
UTILITY = r"(?i)^(login|log in|sign in|docs|documentation|support|privacy|terms|legal|status|blog)$"
ROLE_ORDER = (("hero", 1), ("pricing", 2), ("cta", 3))
#: What is no feature, and how releases are dated; fixed values.
NO_FEATURE = r"(?i)\b(testimonial|trusted by|privacy|terms|login|sign up|start free|book demo|pricing|copyright)\b"
RELEASE_DATE = r"(?i)\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{1,2},?\s+20\d{2}\b|\b20\d{2}-\d{2}-\d{2}\b"
#: Marks of pages that scripts fill, arrays of objects that scripts assign, scripts and characters from which a page is one
#: of those if it shows less text than LITTLE; fixed values.
SHELL = r"""(?i)\b(?:__NEXT_DATA__|data-reactroot|vite|webpack|app-root|ng-version)\b|\bid=["'](?:root|__next)["']"""
SCRIPT_ARRAY = r"(?is)=\s*(\[\s*\{.*?\}\s*\])\s*;"
SHELL_SCRIPTS, SHELL_LENGTH, LITTLE = 5, 80000, 140


def price_score(role: Column, on_pricing_page: Column, context: Column) -> Column:
    score = F.lit(PRICE_START) + F.when(role.isin(*PRICE_ROLES), PRICE_ROLE).otherwise(0.0) + F.when(on_pricing_page, PRICE_PAGE).otherwise(0.0)
    for pattern, weight in PRICE_SIGNS:
        score = score + F.when(context.rlike(pattern), weight).otherwise(0.0)
    score = F.when(role.isin(*NEVER_ROLES), F.least(score, F.lit(0.2))).otherwise(score)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)


def prices(blocks: DataFrame) -> DataFrame:
    """Every amount with a currency in a block, with its context (its line, or with the lines beside it
    where that is short or nothing but the amount), score and whether it is accepted as a price."""
    near = F.transform("lines", lambda x, i: F.struct(x.alias("line"), F.concat_ws("\n", F.get("lines", i - 1), x, F.get("lines", i + 1)).alias("near")))
    rows = blocks.select("page_id", "block_id", "role", "page_type", "ord", F.posexplode(near).alias("line_no", "_l"))
    rows = rows.select("page_id", "block_id", "role", "page_type", "ord", "line_no", "_l.line", "_l.near", F.explode(money.prices(F.col("_l.line"))).alias("p")).filter("p.amount > 0 and p.currency is not null")
    bare = F.trim(F.regexp_replace("line", money.PRICE, "")) == ""
    rows = rows.withColumn("context", F.when(F.char_length("line").between(8, 220) & ~bare, F.col("line")).otherwise(F.col("near")))
    rows = rows.withColumn("score", price_score(F.col("role"), F.col("page_type") == "pricing", F.col("context")))
    return rows.select(
        "page_id", "block_id", "role", "line_no", F.col("p.text").alias("price_text"), F.col("p.amount").alias("amount"), F.col("p.currency").alias("currency"),
        money.period(F.col("context")).alias("period"), "context", "score", (F.col("score") >= ACCEPTED).alias("accepted"),
    )


def plan_name(heading: Column, body: Column) -> Column:
    """A plan's name in the heading, or else in the text; null if there is none."""
    found = F.coalesce(F.nullif(F.regexp_extract(heading, PLAN_NAME, 1), F.lit("")), F.nullif(F.regexp_extract(body, PLAN_NAME, 1), F.lit("")))
    return F.when(F.lower(found) == "start", "Starter").otherwise(found)


def plans(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Plans of pages: one per accepted price, free plans and those by contact in blocks without one."""
    own = blocks.filter(F.col("role").isin(*PRICE_ROLES))
    named = own.select("block_id", F.coalesce(plan_name(F.col("heading"), F.col("text")), F.lit("Unnamed")).alias("plan"), F.slice(F.regexp_extract_all("text", F.lit(LIMIT), F.lit(0)), 1, 8).alias("limits"))
    good = found.filter("accepted")
    paid = good.join(named, "block_id").select("page_id", "block_id", "plan", F.col("amount").alias("price"), "currency", F.col("period").alias("billing_period"), "limits", F.lit("paid").alias("kind"))
    rest = own.join(good.select("block_id").distinct(), "block_id", "left_anti").join(named, "block_id")
    none = lambda kind: F.lit(None).cast(kind)
    free = rest.filter(F.col("text").rlike(FREE_PLAN)).select("page_id", "block_id", F.lit("Free").alias("plan"), F.lit(0.0).alias("price"), none("string").alias("currency"), none("string").alias("billing_period"), "limits", F.lit("free").alias("kind"))
    contact = rest.filter(F.col("text").rlike(CONTACT)).select(
        "page_id", "block_id", F.when(F.col("text").rlike("(?i)enterprise"), "Enterprise").otherwise("Contact sales").alias("plan"), none("double").alias("price"), none("string").alias("currency"), none("string").alias("billing_period"), "limits", F.lit("contact").alias("kind")
    )
    return paid.unionByName(free).unionByName(contact)


def pricing_models(blocks: DataFrame, found: DataFrame, offered: DataFrame) -> DataFrame:
    """One row a page: status, kind of model, lowest and highest monthly price, plans, completeness 0 to 100."""
    month = money.monthly(F.col("price"), F.col("billing_period"))
    rows = offered.groupBy("page_id").agg(
        F.count("*").alias("plans"), F.count_if(F.col("price").isNotNull()).alias("priced"), F.bool_or(F.col("kind") == "contact").alias("contact_sales"), F.bool_or(F.col("kind") == "free").alias("free_plan"),
        F.min(F.when(F.col("price") > 0, month)).alias("lowest"), F.max(F.when(F.col("price") > 0, month)).alias("highest"), F.count_distinct("billing_period").alias("modes"), F.count_distinct("block_id").alias("evidence"),
        F.bool_or(F.exists("limits", lambda x: x.rlike("(?i)pageviews?|requests?|events?"))).alias("by_usage"), F.array_sort(F.collect_set("plan")).alias("plan_names"),
    )
    signs = found.groupBy("page_id").agg(F.max("score").alias("_best"))
    shown = blocks.groupBy("page_id").agg(F.bool_or(F.col("role").isin(*PRICE_ROLES)).alias("_shown"))
    rows = shown.join(rows, "page_id", "left").join(signs, "page_id", "left")
    has, contact = F.coalesce(F.col("priced") > 0, F.lit(False)), F.coalesce("contact_sales", F.lit(False))
    status = F.when(has, "public_pricing").when(contact, "contact_sales").when(F.col("_shown") | (F.coalesce("_best", F.lit(0.0)) >= PARTIAL), "pricing_unclear").otherwise("no_public_pricing")
    kind = F.when(~has & contact, "contact_sales").when(F.col("by_usage"), "usage_based").when(has & contact, "mixed").when(has, "fixed_plans").otherwise("unknown")
    number = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "page_id", status.alias("status"), kind.alias("model_type"), number("plans").alias("plans"), F.coalesce("free_plan", F.lit(False)).alias("free_plan"), contact.alias("contact_sales"),
        F.round("lowest", 4).alias("lowest"), F.round("highest", 4).alias("highest"), "plan_names", F.least(F.lit(100), number("evidence") * 18 + number("plans") * 16 + number("modes") * 8).cast("int").alias("completeness"),
    )


def cta_intent(label: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, words in INTENTS:
        out = out.when(label.rlike(words), name)
    return out.otherwise("unknown")


def calls_to_action(blocks: DataFrame) -> DataFrame:
    """Buttons with intent, place in the ranking of their page, and whether they sell something."""
    order = F.lit(8)
    for role, n in reversed(ROLE_ORDER):
        order = F.when(F.col("role") == role, n).otherwise(order)
    rows = blocks.select("page_id", "block_id", "role", "ord", F.posexplode("buttons").alias("i", "label"), order.alias("_role"))
    rows = rows.withColumns({"label": F.trim(F.regexp_replace("label", r"\s+", " ")), "priority": F.col("_role") + F.col("i") / 10})
    rows = rows.withColumn("intent", cta_intent(F.col("label")))
    rejected = F.when(F.col("label").rlike(UTILITY), "utility_or_legal").when(F.col("intent") == "unknown", "unknown_intent")
    score = F.when(rejected.isNull(), F.greatest(F.lit(0.72), 0.95 - F.col("_role") * 0.05)).otherwise(0.25)
    rows = rows.withColumns({"rejected": rejected, "score": F.round(score, 2)})
    rank = F.row_number().over(W.partitionBy("page_id").orderBy(F.col("rejected").isNotNull(), "priority", "ord", "i"))
    return rows.withColumn("rank", rank).select("page_id", "block_id", "label", "intent", "priority", "score", "rejected", "rank")


def features(blocks: DataFrame, most: int = 12) -> DataFrame:
    """Named capabilities of feature blocks, each once a page (the last block's words at the first place)."""
    good = lambda x: F.char_length(x).between(8, 120) & ~x.rlike(NO_FEATURE)
    line = F.get(F.filter("lines", lambda x: good(x) & ~x.rlike("[.!?]$")), F.lit(0))
    rows = blocks.filter("role = 'feature'").withColumn("name", F.when(good(F.col("heading")), F.col("heading")).otherwise(line)).filter("name is not null")
    described = F.get(F.filter("lines", lambda x: (x != F.col("name")) & F.char_length(x).between(20, 180)), F.lit(0))
    rows = rows.select("page_id", "ord", F.lower("name").alias("_key"), "name", described.alias("description"), F.when(F.col("page_type") == "features", 0.86).otherwise(0.72).alias("score"))
    rows = rows.groupBy("page_id", "_key").agg(F.min("ord").alias("ord"), F.max_by(F.struct("name", "description", "score"), "ord").alias("_f"))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy("ord"))).filter(F.col("rank") <= most)
    return rows.select("page_id", "rank", "_f.*")


def releases(blocks: DataFrame, most: int = 8) -> DataFrame:
    """Dated entries of changelog blocks, in their order."""
    rows = blocks.filter("role = 'changelog'").select("page_id", "ord", "heading", F.posexplode(F.regexp_extract_all("text", F.lit(RELEASE_DATE), F.lit(0))).alias("i", "date_text"))
    iso = F.when(F.col("date_text").rlike(r"^\d{4}-"), F.try_to_timestamp("date_text", F.lit("yyyy-MM-dd")))
    plain = F.regexp_replace(F.regexp_replace("date_text", ",", ""), r"^(\w{3})\w*", "$1")
    day = F.coalesce(iso, F.try_to_timestamp(F.initcap(plain), F.lit("MMM d yyyy"))).cast("date")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy("ord", "i"))).filter(F.col("rank") <= most)
    return rows.select("page_id", "rank", "heading", "date_text", F.date_format(day, "yyyy-MM-dd").alias("released"))


def positioning(blocks: DataFrame) -> DataFrame:
    """The main claim of each page: the heading of its hero, else the first heading that isn't boilerplate."""
    rows = blocks.filter((F.col("heading") != "") & ~F.col("role").isin(*NEVER_ROLES) & ~T.is_boilerplate(F.col("heading")))
    first = F.min_by(F.struct("heading", F.get("lines", F.lit(1)).alias("support"), "role"), F.struct((F.col("role") != "hero").alias("h"), "ord"))
    return rows.groupBy("page_id").agg(first.alias("_p")).select("page_id", F.col("_p.heading").alias("headline"), F.col("_p.support").alias("support"), F.when(F.col("_p.role") == "hero", 0.9).otherwise(0.68).alias("score"))


def shell_signs(markup: Column) -> Column:
    """Whether scripts fill a page, if it shows little: by marks of frameworks, many scripts, length, or data in a script.
    One script alone is no sign: most pages have one."""
    scripts = F.size(F.split(F.lower(markup), "<script")) - 1
    return (scripts >= SHELL_SCRIPTS) | (F.char_length(markup) > SHELL_LENGTH) | markup.rlike(SHELL) | markup.rlike(SCRIPT_ARRAY)


def page_validity(pages: DataFrame, found: DataFrame, status_col: str = "status_code") -> DataFrame:
    """blocked, missing, script_shell or ok, from status and what the page shows."""
    shown = found.groupBy("page_id").agg(F.sum(F.char_length("text")).alias("_n"))
    rows = pages.join(shown, "page_id", "left")
    few = F.coalesce("_n", F.lit(0)) < LITTLE
    state = (
        F.when(F.col(status_col).isin(401, 403, 429), "blocked").when((F.col(status_col) >= 400) | (F.coalesce("html", F.lit("")) == ""), "missing")
        .when(few & shell_signs(F.col("html")), "script_shell").otherwise("ok")
    )
    return rows.select("page_id", state.alias("validity"))


def model_changes(old: DataFrame, new: DataFrame, persisted: float = 0.82) -> DataFrame:
    """What differs between two versions of pricing models, with severity and whether it is written."""
    a, b = (df.select("page_id", *[F.col(c).alias(f"{p}_{c}") for c in ("status", "lowest", "highest", "free_plan", "contact_sales", "plan_names")]) for df, p in ((old, "old"), (new, "new")))
    rows = a.join(b, "page_id")
    differs = lambda c: ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    kinds = [("pricing_status_changed", "status", 0.9), ("lowest_price_changed", "lowest", 0.92), ("highest_price_changed", "highest", 0.88), ("free_plan_changed", "free_plan", 0.86), ("contact_sales_changed", "contact_sales", 0.8)]
    plain = [F.when(differs(c), F.struct(F.lit(k).alias("change"), F.col(f"old_{c}").cast("string").alias("old"), F.col(f"new_{c}").cast("string").alias("new"), F.lit(s).alias("score"))) for k, c, s in kinds]
    names = lambda kind, x, y: F.transform(F.array_except(F.coalesce(x, F.array().cast("array<string>")), F.coalesce(y, F.array().cast("array<string>"))), lambda n: F.struct(F.lit(kind).alias("change"), F.when(F.lit(kind == "plan_removed"), n).alias("old"), F.when(F.lit(kind == "plan_added"), n).alias("new"), F.lit(0.84).alias("score")))
    every = F.concat(F.array_compact(F.array(*plain)), names("plan_added", F.col("new_plan_names"), F.col("old_plan_names")), names("plan_removed", F.col("old_plan_names"), F.col("new_plan_names")))
    rows = rows.select("page_id", F.explode(every).alias("_c")).select("page_id", "_c.*")
    return rows.withColumns({"severity": scoring.severity(F.col("score")), "written": F.col("score") >= persisted})
