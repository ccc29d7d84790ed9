"""Amounts and prices in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.functions.text import any_of, ascii_words

#: Currency signs and codes; fixed values.
CURRENCIES = (("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("usd", "USD"), ("eur", "EUR"), ("gbp", "GBP"))
AMOUNT = r"\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?"
PRICE = "(?i)(?:[$€£]|\\b(?:usd|eur|gbp))\\s?(?:" + AMOUNT + ")|(?:" + AMOUNT + ")\\s?(?:[$€£]|(?:usd|eur|gbp)\\b)"
#: Contexts in which an amount is no price of the product, first match counts; then those in which it is.
NO_PRICE = (
    ("testimonial", r"(?i)\b(testimonial|customer story|quote from|said|says)\b"),
    ("case_study", r"(?i)\b(case study|success story|campaign budget|budget)\b"),
    ("funding", r"(?i)\b(raised|funding|series [a-e]\b|valuation|investors?)\b"),
    ("savings", r"(?i)\b(saved?|savings|roi|revenue|earned|worth)\b"),
    ("statistic", r"(?i)\b(customers|users|downloads|companies|teams) (worldwide|globally|trust)\b"),
)
A_PRICE = (("plan", r"(?i)\b(plan|tier|starter|pro|business|enterprise|premium|basic|team)\b"), ("period", r"(?i)(/\s?(mo|month|yr|year|user|seat)\b|per (month|year|user|seat)|monthly|yearly|annually)"))


def amount(text: Column) -> Column:
    """1,234.56 and 1.234,56 and 9,99 as numbers; null if it is none."""
    text = F.regexp_replace(text, r"\s", "")
    number = (
        F.when(text.rlike(r"^\d{1,3}(,\d{3})+(\.\d{1,2})?$"), F.regexp_replace(text, ",", ""))
        .when(text.rlike(r"^\d{1,3}(\.\d{3})+(,\d{1,2})?$"), F.replace(F.regexp_replace(text, r"\.", ""), F.lit(","), F.lit(".")))
        .when(text.rlike(r"^\d+,\d{1,2}$"), F.replace(text, F.lit(","), F.lit("."))).otherwise(F.regexp_replace(text, ",", ""))
    )
    return number.try_cast("double")


def currency(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for sign, code in reversed(CURRENCIES):
        out = F.when(F.lower(text).contains(sign), code).otherwise(out)
    return out


def prices(text: Column) -> Column:
    """(text, amount, currency) of every price in a text, in order."""
    found = F.regexp_extract_all(text, F.lit(PRICE), F.lit(0))
    return F.transform(found, lambda x: F.struct(x.alias("text"), amount(F.regexp_extract(x, AMOUNT, 0)).alias("amount"), currency(x).alias("currency")))


def period(text: Column) -> Column:
    return (
        F.when(text.rlike(r"(?i)(/\s?(mo|month)\b|per month|monthly)"), "month").when(text.rlike(r"(?i)(/\s?(yr|year)\b|per year|yearly|annually|annual)"), "year").otherwise("unknown")
    )


def price_context(text: Column) -> Column:
    """Why an amount in such a text is no price, or which kind it is, or unknown."""
    out = F.when(F.lit(False), "")
    for name, pattern in NO_PRICE + A_PRICE:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("unknown")


def monthly(value: Column, per: Column) -> Column:
    """A price by the month."""
    return F.when(per == "year", value / 12).otherwise(value)


#: What a text around an amount can be besides a price, in the order in which it counts; fixed values.
OTHER_CONTEXTS = (
    ("generated_sample", r"\b(?:generated output|generated proposal|generic ai proposal|sample output)\b"),
    ("proposal_sample", r"\b(?:proposal sample|sample proposal|same job post|same brief|client brief|proposal example)\b"),
    ("project_budget", r"\b(?:project budget|client project|per project|same brief|skincare brand|seo-first)\b"),
    ("article_budget", r"\b(?:article budget|per article|/\s?article|blog post|copywriting|content budget)\b"),
    ("job_budget", r"\b(?:job|salary|budget|freelance|freelancer|contractor|hiring|developer role|manager role|upwork|/\s?hr|\bhr\b|per hour|hourly)\b"),
    ("testimonial", r"\b(?:testimonial|review|quote|customer story|customer quote|what customers say|rated|stars?)\b"),
    ("case_study", r"\b(?:case study|case-study|success story)\b"),
    ("example_content", r"\b(?:example|sample|template|demo content|mock)\b"),
    ("blog_content", r"\b(?:blog|article|news|guide|tutorial)\b"),
    ("FAQ", r"\b(?:faq|frequently asked|question|answer)\b"),
)
#: What makes a text one about prices, in the element it stands in and in its words; fixed values.
PRICED_ELEMENT = r"\b(?:pricing|price|plans?|tier|billing|checkout|upgrade|subscription|modal|dialog)\b"
PRICED_WORDS = r"\b(?:pricing|price|prices|plans?|packages?|tiers?|subscription|billing|billed|paid|monthly|annual|annually|yearly|upgrade|checkout|seat|per user|usage|pageviews?|requests?|events?|visits?|choose plan|buy now|get plus|get pro|get business|start free)\b"
PLAN_LABEL = r"\b(?:free|starter|basic|plus|pro|premium|team|business|enterprise|custom|agency|creator|personal|core)\b"
#: Contexts of prices by the element and by words, the first that fits counts; fixed values.
PRICE_CONTEXTS = (
    ("pricing_table", r"table|row|cell", r"\b(?:pricing table|compare plans|plan comparison|included in)\b"),
    ("upgrade_modal", r"modal|dialog", r"\b(?:upgrade modal|pricing modal|checkout modal|dialog|subscribe)\b"),
    ("checkout_section", r"checkout|subscribe", r"\b(?:checkout|subscribe|buy now|choose plan|start plan|upgrade)\b"),
    ("billing_toggle", r"toggle|billing", r"\b(?:monthly|yearly|annual|annually|billed monthly|billed annually)\b"),
)
CARD_ELEMENT = r"card|plan|tier|price|pricing"
#: The context whose words are names of elements, too, so that most texts have one, and what a text must have for any other.
ELEMENT_CONTEXT = "blog_content"
CONTEXT_SIGNS = any_of(*[p for n, p in OTHER_CONTEXTS if n != ELEMENT_CONTEXT], PRICED_WORDS, *[p for _, _, p in PRICE_CONTEXTS])
#: Labels that name no plan, the words that only begin one, and the longest name; fixed values.
NO_LABEL, NO_START, LONGEST_LABEL = r"(?i)^(?:plan\s+\d+|plan|public pricing|public price|visible price|usage tier|pricing option)$", r"(?i)^(?:start|growth)$", 56


def classified_context(text: Column, element: Column, section: Column, page_type: Column) -> Column:
    """(classification, accepted, reason) of what stands around an amount: element is what its element is called. Texts
    that speak of something else than prices are rejected unless their element speaks of prices."""
    element = F.coalesce(element, F.lit(""))
    #: What is read more than once is bound once, as the only element of an array.
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.concat(element, F.lit(" "), F.coalesce(text, F.lit(""))), "[\u2013\u2014]", "-"), r"\s+", " ")))
    says = lambda x, pattern: x.rlike(ascii_words(pattern))

    def contexts(x: Column) -> Column:
        #: One search for all words; only texts that have one are searched for each.
        has = lambda pattern: x["some"] & says(x["plain"], pattern)
        other, priced = F.when(F.lit(False), ""), F.when(F.lit(False), "")
        for name, pattern in OTHER_CONTEXTS:
            other = other.when(says(x["plain"], pattern) if name == ELEMENT_CONTEXT else has(pattern), name)
        for name, named, words in PRICE_CONTEXTS:
            priced = priced.when(element.rlike(named) | has(words), name)
        verified = (section == "pricing") | (page_type == "pricing") | (has(PRICED_WORDS) & has(PLAN_LABEL))
        priced = priced.when(element.rlike(CARD_ELEMENT) | verified, "plan_card").when(has(PRICED_WORDS), "product_pricing")
        return F.struct(other.alias("other"), priced.alias("priced"))

    def told(x: Column) -> Column:
        rejected = x["other"].isNotNull() & ~says(F.lower(element), PRICED_ELEMENT)
        kind = F.when(rejected, x["other"]).otherwise(F.coalesce(x["priced"], x["other"], F.lit("unknown")))
        accepted = F.coalesce(x["priced"], F.lit("")).isin(*[n for n, _, _ in PRICE_CONTEXTS], "plan_card", "product_pricing") & ~rejected
        return F.struct(kind.alias("classification"), accepted.alias("accepted"), F.when(~accepted, F.concat(F.lit("non_product_pricing_"), kind)).alias("reason"))

    searched = once(plain, lambda x: F.struct(x.alias("plain"), x.rlike(CONTEXT_SIGNS).alias("some")))
    return once(once(searched, contexts), told)


def reliable_label(label: Column) -> Column:
    """Whether a label names a plan: not a placeholder, not a single starting word, not too long, no run of full stops."""
    plain = F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s+", " "))
    return (plain != "") & ~plain.rlike(NO_LABEL) & ~plain.rlike(NO_START) & (F.char_length(plain) <= LONGEST_LABEL) & ~plain.rlike("[.!?]{2,}")
