"""What changed between two versions of facts: calls to action, positioning, features, releases; summaries and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.functions import text as T

#: Texts that are less alike than this are different claims.
ALIKE = 0.82
#: Change type and severity by the claim that changed; fixed values.
CLAIMS = (("homepage_headline", "medium"), ("target_customer", "high"), ("product_category", "medium"), ("main_value_prop", "medium"))
#: Labels of changes by words in their type, first match counts; fixed values.
LABELS = (
    ("pricing", r"(?i)price|pricing|plan|free|contact_sales"), ("CTA", r"(?i)cta|demo|trial|signup|sign_up"), ("positioning", r"(?i)headline|position|customer|category|value_prop"),
    ("feature", r"(?i)feature"), ("changelog", r"(?i)changelog|release|update"),
)
#: Warnings that are shown in other words, first match counts; fixed values.
WARNINGS = (
    (r"(?i)openai|api key|api_key|ai summary unavailable", "Deterministic analysis shown. AI enhancement is disabled for this plan."),
    (r"(?i)http\s?(?:401|403)|unauthori[sz]ed|forbidden|blocked", "Some pages could not be retrieved."),
    (r"(?i)stack|trace|raw json|route|secret|env|supabase|stripe|token|timing|budget|ms\b", "Scan completed with limited coverage."),
    (r"(?i)pricing debug|rejected", "Some pricing-like text was ignored because it did not look like product pricing."),
)
#: What a found section contradicts; fixed values.
CONTRADICTED = (("pricing", r"(?i)no (?:reliable )?public pricing(?: block)? detected"), ("features", r"(?i)not enough feature information detected"), ("changelog", r"(?i)no changelog/update page detected"))
#: Sentences on what lines say, by kind and by whether lines that were added (+), removed (-) or both have it, in the
#: order in which they count; then on longer first lines, and on how many lines; fixed values.
SAID = (
    ("price", "+-", 'Changed {page} pricing language from "{old}" to "{new}".'),
    ("price", "+", 'Added {page} pricing language: "{new}".'),
    ("cta", "+-", 'Changed {page} CTA from "{old}" to "{new}".'),
    ("cta", "+", 'Added {page} CTA language: "{new}".'),
    ("launch", "+", 'Added {page} launch or release language: "{new}".'),
    ("feature", "+", 'Added {page} feature language: "{new}".'),
)
CLAIMED, CLAIM_LENGTH, QUOTED = 'Changed {page} positioning from "{old}" to "{new}".', 20, 90
BOTH, ONLY_ADDED, ONLY_REMOVED = "Updated {page} copy with {added} additions and {removed} removals.", "Added {added} new {page} text section{s}.", "Removed {removed} {page} text section{s}."
#: What the kinds of lines speak of.
SPEAKS = {"price": T.PRICING, "cta": T.CTA, "launch": T.LAUNCH, "feature": T.FEATURE}
#: Why changes matter: severe ones, those of types of pages, all others; fixed values.
SEVERE, ELSE = "This may affect competitive positioning, sales conversations, or pricing comparisons.", "Positioning changes can shift how customers understand the product."
MATTERS = (
    ("pricing", "Pricing page movement can change how prospects compare plans."),
    ("features", "Feature movement can signal roadmap or packaging changes."),
    ("changelog", "Release activity can reveal what the competitor is actively shipping."),
)
#: Summaries that say nothing; fixed values.
GENERIC = r"(?i)^(?:this is a saas product|they offer software solutions|software solutions|businesses improve productivity)$"
#: The order in which types of pages are shown; fixed values.
PAGE_ORDER = ("homepage", "pricing", "features", "changelog", "docs", "product")


def price_key(currency: Column, amount: Column, period: Column, unit: Column) -> Column:
    return F.concat_ws(":", currency, F.format_string("%.2f", amount), F.coalesce(period, F.lit("")), F.coalesce(unit, F.lit("")))


def cta_key(intent: Column, label: Column, destination: Column) -> Column:
    return F.concat_ws(":", intent, F.lower(F.trim(label)), F.coalesce(destination, F.lit("")))


def claim_differs(old: Column, new: Column) -> Column:
    """Whether two normalised claims differ in meaning; an absent one never does."""
    tokens = lambda x: T.tokens(x)
    return F.coalesce((old != new) & (T.jaccard(tokens(old), tokens(new)) < ALIKE), F.lit(False))


def first_added(new: Column, old: Column) -> Column:
    """The first value, in order, that the other version lacks."""
    return F.get(F.array_except(new, old), F.lit(0))


def first_matching(lines: Column, pattern: str) -> Column:
    return F.get(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(0))


def parts_of(sentence: str) -> list[tuple[bool, str]]:
    """A sentence with {names} as parts: (whether it is a name, text)."""
    return [(k % 2 == 1, x) for k, x in enumerate(re.split(r"\{(\w+)\}", sentence)) if x]


def filled(sentence: str, **named: Column) -> Column:
    return F.concat(*[named[x] if name else F.lit(x) for name, x in parts_of(sentence)])


def line_summary(page: Column, added: Column, removed: Column) -> Column:
    """One sentence on what added and removed lines of a page say, the weightiest first."""
    first = {(side, name): first_matching(lines, p) for side, lines in (("+", added), ("-", removed)) for name, p in SPEAKS.items()}
    cut = lambda x: T.truncated(x, QUOTED)
    out = F.when(F.lit(False), "")
    for name, sides, sentence in SAID:
        here = first["+", name].isNotNull() & (first["-", name].isNotNull() if "-" in sides else F.lit(True))
        out = out.when(here, filled(sentence, page=page, new=cut(first["+", name]), old=cut(first["-", name])))
    new, old = F.get(added, F.lit(0)), F.get(removed, F.lit(0))
    counts = lambda n: {"page": page, "added": F.size(added).cast("string"), "removed": F.size(removed).cast("string"), "s": F.when(F.size(n) == 1, "").otherwise("s")}
    out = out.when((F.char_length(new) > CLAIM_LENGTH) & (F.char_length(old) > CLAIM_LENGTH), filled(CLAIMED, page=page, new=cut(new), old=cut(old)))
    out = out.when((F.size(added) > 0) & (F.size(removed) > 0), filled(BOTH, **counts(added))).when(F.size(added) > 0, filled(ONLY_ADDED, **counts(added)))
    return out.otherwise(filled(ONLY_REMOVED, **counts(removed)))


def why_it_matters(page_type: Column, severity: Column) -> Column:
    out = F.when(severity == "high", SEVERE)
    for kind, words in MATTERS:
        out = out.when(page_type == kind, words)
    return out.otherwise(ELSE)


def change_label(change_type: Column, page_type: Column) -> Column:
    """What a change is about, by its type or else its page's."""
    value, out = F.coalesce(change_type, page_type), F.when(F.lit(False), "")
    for name, words in LABELS:
        out = out.when(value.rlike(words), name)
    return out.otherwise(F.initcap(page_type))


def shown_warnings(warnings: Column, found: dict[str, Column]) -> Column:
    """Warnings in plain words, each once, without those that a found section contradicts."""

    def plain(x):
        out = F.when(F.lit(False), "")
        for pattern, words in WARNINGS:
            out = out.when(x.rlike(pattern), words)
        return out.otherwise(x)

    def stays(x):
        out = F.lit(True)
        for section, pattern in CONTRADICTED:
            out = out & ~(found[section] & x.rlike(pattern))
        return out

    return F.filter(F.array_distinct(F.transform(warnings, plain)), stays)


def is_generic(summary: Column) -> Column:
    return F.trim(summary).rlike(GENERIC)


def page_order(page_type: Column) -> Column:
    out = F.lit(len(PAGE_ORDER))
    for k, name in enumerate(PAGE_ORDER):
        out = F.when(page_type == name, k).otherwise(out)
    return out


def fact(category: str, field: Column, value: Column, score: Column, evidence: Column) -> Column:
    """A fact with its normalised value, cut evidence and level of confidence."""
    level = F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")
    return F.struct(F.lit(category).alias("category"), field.alias("field"), T.truncated(value, 180).alias("value"), T.sentence_key(value).alias("normalized_value"), F.round(score, 2).alias("score"), level.alias("confidence"), T.truncated(evidence, 220).alias("evidence"))


def compact_order(rows: DataFrame, key: str, *parts: Column) -> DataFrame:
    """Rows with their place among those of their key, in the order of readers by composed parts (null is empty):
    facts by field and comparable value, calls to action by intent, value and destination, plans by name."""
    composed = F.concat_ws(":", *[F.coalesce(p, F.lit("")) for p in parts])
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(T.by_locale(composed), composed)))
