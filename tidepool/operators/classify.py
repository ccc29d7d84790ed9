"""What type of page a parsed page is, by its path and by what its blocks say, and whether it may be read as the one asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.functions import urls
from tidepool.operators import blocks
from tidepool.sources import dom

#: Types by path, first match counts, the root is the home page; fixed values.
PATHS = (
    ("pricing", r"/(?:pricing|plans|pricing-plans|packages?|subscribe|upgrade)(?:/|$)"), ("features", r"/(?:features?|product|platform|solutions?|use-cases?)(?:/|$)"), ("changelog", r"/(?:changelog|updates?|release-notes?|releases?)(?:/|$)"),
    ("docs", r"/(?:docs?|help|support|api)(?:/|$)"), ("blog", r"/(?:blog|articles?|resources?)(?:/|$)"), ("case_study", r"/(?:customers?|case-stud(?:y|ies)|stories)(?:/|$)"), ("login", r"/(?:login|signin|sign-in|account|dashboard)(?:/|$)"), ("checkout", r"/(?:checkout|cart)(?:/|$)"),
)
#: Types by content, first match counts: roles of blocks, or all of the words; fixed values.
CONTENT = (
    ("pricing", ("pricing_table", "pricing_card"), (r"\b(?:pricing|plans|billing|starter|enterprise|contact sales)\b", r"[$€£]\s?\d|\b(?:usd|eur|gbp)\s?\d")),
    ("changelog", ("changelog_entry", "release_note"), (r"\b(?:changelog|release notes|shipped|fixed|improved|version)\b",)),
    ("features", ("feature_grid", "feature_card"), (r"\b(?:features|capabilities|integrations|workflow|platform)\b",)),
    ("blog", ("blog_content",), (r"\b(?:blog|article|published by|read more)\b",)),
    ("case_study", ("case_study",), (r"\b(?:case study|customer story)\b",)),
    ("homepage", ("hero",), (r"\b(?:sign up|get started|book a demo)\b",)),
)
#: Confidence of each way to know a type, and types that a home page may turn out to be; fixed values.
BLOCKED, COPY, AGREED, BY_CONTENT, BY_PATH, HOME = 0.95, 0.96, 0.94, 0.84, 0.62, 0.9
HOME_MAY_BE = ("features", "pricing", "changelog")
#: Likeness of words from which a page is its home page once more, and their least length; fixed values.
ALIKE, WORD_LENGTH = 0.92, 3


def by_path(url: Column) -> Column:
    path = F.lower(urls.part(url, 3))
    out = F.when(F.lit(False), "")
    for name, pattern in PATHS:
        out = out.when(path.rlike(pattern), name)
    return out.when(F.coalesce(path, F.lit("")).isin("", "/"), "homepage").otherwise("unknown")


def by_content(roles: Column, text: Column) -> Column:
    """By the roles of a page's blocks or the words of its lower-case text."""
    out = F.when(F.lit(False), "")
    for name, known, words in CONTENT:
        said = F.lit(True)
        for w in words:
            said = said & blocks.says(text, w)
        out = out.when(F.arrays_overlap(roles, F.array(*[F.lit(r) for r in known])) | said, name)
    return out.otherwise("unknown")


def classified(pages: DataFrame, requested: str = "requested", home: DataFrame | None = None) -> DataFrame:
    """Pages (page_id, url, status_code, the requested type, and the parts elements and blocks of a parse) with page_type,
    type_confidence, reasons and allowed: blocked before missing before copies of the home page before content before path.

    home: (page_id, home_text) of the home page of each page's site, where it is another one. Whether the type found may
    stand for the requested one decides if the page is read at all."""
    found = blocks.classified(dom.part(pages.select("page_id", "blocks"), "blocks"), F.lit("unknown"))
    said = found.groupBy("page_id").agg(F.collect_set("role").alias("_roles"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("_text"))
    title = F.get(F.filter("elements", lambda e: e["tag"] == "title"), F.lit(0))["text"]
    about = F.get(F.filter("elements", lambda e: (e["tag"] == "meta") & (F.lower(e["attrs"]["name"]) == "description")), F.lit(0))["attrs"]["content"]
    rows = pages.join(said, "page_id", "left").withColumns({"_roles": F.coalesce("_roles", F.array().cast("array<string>")), "_text": F.coalesce("_text", F.lit(""))})
    rows = rows.withColumn("_body", F.lower(F.concat_ws("\n", title, about, "_text")))
    rows = rows.join(home, "page_id", "left") if home is not None else rows.withColumn("home_text", F.lit(None).cast("string"))
    rows = rows.withColumns({"_path": by_path(F.col("url")), "_content": by_content(F.col("_roles"), F.col("_body"))})
    asked, status = F.col(requested), F.col("status_code")
    blocked, missing = status.isin(401, 403, 429), status.isin(404, 410) | (F.size("elements") == 0)
    words = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.char_length(w) >= WORD_LENGTH))
    alike = (F.size(words("_text")) > 0) & (T.jaccard(words("_text"), words("home_text")) >= ALIKE)
    copied = F.coalesce((asked != "homepage") & ((F.col("_text") == F.col("home_text")) | alike), F.lit(False))
    home_page = (asked == "homepage") & (F.col("_path") == "homepage")
    best = F.when(home_page, "homepage").when(F.col("_content") != "unknown", F.col("_content")).otherwise(F.col("_path"))
    sure = F.when(F.col("_path") == F.col("_content"), AGREED).when(F.col("_content") != "unknown", BY_CONTENT).otherwise(BY_PATH)
    kind = F.when(blocked, "blocked").when(missing, "missing").when(copied, "duplicate_homepage").otherwise(best)
    matches = (asked == kind) | ((asked == "homepage") & kind.isin(*HOME_MAY_BE)) | ((asked == "unknown") & ~kind.isin("blocked", "missing"))
    allowed = ~blocked & ~missing & ~copied & (F.coalesce(status, F.lit(200)) < 400) & matches
    given = F.array(F.concat(F.lit("url_path:"), F.col("_path")), F.concat(F.lit("content:"), F.col("_content")))
    reasons = (
        F.when(blocked, F.array(F.lit("fetch_blocked"))).when(missing, F.array(F.lit("missing_or_empty"))).when(copied, F.array(F.lit("near_duplicate_homepage")))
        .when(allowed, given).otherwise(F.array_append(given, F.lit("page_type_mismatch_or_unavailable")))
    )
    confidence = F.when(blocked | missing, BLOCKED).when(copied, COPY).when(home_page, F.greatest(sure, F.lit(HOME))).otherwise(sure)
    return rows.withColumns({"page_type": kind, "type_confidence": confidence, "reasons": reasons, "allowed": F.coalesce(allowed, F.lit(False))}).drop("_roles", "_text", "_body", "_path", "_content", "home_text")
