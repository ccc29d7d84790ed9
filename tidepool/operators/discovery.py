"""Which pages of a site are worth watching: links, sitemaps of any depth and usual paths, ranked, fetched, judged again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.functions import urls
from tidepool.operators.sinks import stored

#: Paths that sites usually have; fixed values.
USUAL = (
    "/", "/pricing", "/plans", "/pricing-and-packaging", "/pricing-plans", "/plans-and-pricing", "/packages", "/subscription", "/billing", "/tarifs", "/prix", "/features", "/product",
    "/platform", "/solutions", "/use-cases", "/changelog", "/updates", "/release-notes", "/releases", "/docs", "/help", "/support", "/faq", "/api",
)
#: Paths that are never candidates, and where a site's sitemaps stand; fixed values.
EXCLUDED = r"(?i)/(?:login|log-in|signin|sign-in|signup|sign-up|auth|account|checkout|cart|privacy|terms|legal|careers|jobs)(?:/|$)"
SITEMAPS, NESTED, NO_PAGE = ("/sitemap.xml", "/sitemap_index.xml"), r"(?i)sitemap.*\.xml(?:\?|$)", r"(?i)\.xml(?:\?|$)"
#: Types by words in address and texts, in order; fixed values.
WORDS = (
    ("pricing", ("pricing", "plans", "packages", "subscription", "billing", "tarifs", "prix")),
    ("features", ("features", "solutions", "use-cases", "use cases")),
    ("product", ("product", "platform")),
    ("changelog", ("changelog", "updates", "release-notes", "release notes", "releases")),
    ("docs", ("docs", "help", "support", "api")),
)
#: Sources by rank, with what each adds to a score; fixed values.
SOURCES = (("submitted", 5, 60), ("homepage", 4, 55), ("homepage_link", 3, 16), ("sitemap", 2, 10), ("fallback", 1, 4))
#: What a word in address and texts counts for the type and for the score, what a fetched page adds, characters of text
#: a point, points at most; fixed values.
TYPE_ADDRESS, TYPE_TEXT, SCORE_ADDRESS, SCORE_TEXT, FETCHED, PER_POINT, MOST_POINTS = 4, 2, 14, 7, 8, 400, 8
#: Candidates of a type that are always fetched, candidates of a site at most, least text of a usable page; fixed values.
QUOTAS, MOST = {"pricing": 3, "features": 2, "product": 2, "changelog": 2, "docs": 2}, 15
LEAST_TEXT, LEAST_HOME = 80, 40


def sitemap_pages(roots: DataFrame, files: DataFrame) -> DataFrame:
    """(site, url) of all pages in a site's sitemaps: (site, origin) say where they begin, (url, xml) what they hold.

    Sitemaps that a sitemap names are read in turn, each once, as long as they lie on the site; a file that isn't there
    or names nothing ends there. There are as many rounds as sitemaps are nested.
    """
    start = F.explode(F.array(*[F.concat("origin", F.lit(p)) for p in SITEMAPS])).alias("url")
    front = roots.select("site", start).distinct()
    files = files.select("url", F.regexp_extract_all(F.coalesce("xml", F.lit("")), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)).alias("locs"))
    visited, pages = stored(front, "sitemaps-visited"), None
    front = visited
    while not front.isEmpty():
        named = stored(front.join(files, "url").select("site", F.explode("locs").alias("url")).filter("url <> ''").distinct(), "sitemap-entries")
        own = named.filter(urls.site(F.col("url")) == F.col("site"))
        found = own.filter(~F.col("url").rlike(NO_PAGE))
        pages = found if pages is None else pages.unionByName(found)
        front = stored(own.filter(F.col("url").rlike(NESTED)).join(visited, ["site", "url"], "left_anti"), "sitemaps-front")
        visited = visited.unionByName(front)
    return visited.limit(0) if pages is None else pages.distinct()


def candidates(sites: DataFrame, links: DataFrame, sitemap: DataFrame, submitted: DataFrame | None = None) -> DataFrame:
    """(site, url, link_text, source): the home page, its links, the sitemaps' pages, usual paths and submitted pages of
    (site, origin); on the site, not excluded, each canonical address once, from its best source."""
    usual = sites.select("site", F.explode(F.array(*[F.concat("origin", F.lit(p)) for p in USUAL])).alias("url"))
    row = lambda df, source, text=None: df.select("site", "url", (F.col(text) if text else F.lit(None)).cast("string").alias("link_text"), F.lit(source).alias("source"))
    parts = [row(sites.select("site", F.col("origin").alias("url")), "homepage"), row(links, "homepage_link", "text"), row(sitemap, "sitemap"), row(usual, "fallback")]
    every = parts[0]
    for p in parts[1:] + ([row(submitted, "submitted")] if submitted is not None else []):
        every = every.unionByName(p)
    #: Exploded, so that filters read the address instead of making it again.
    every = every.select("site", "link_text", "source", F.explode(F.array(urls.canonical(F.col("url")))).alias("url"))
    every = every.filter(urls.is_url(F.col("url")) & (urls.site(F.col("url")) == F.col("site")))
    every = every.filter(~urls.part(F.col("url"), 3).rlike(EXCLUDED) & ~urls.blocked_path(F.col("url")))
    best = F.max(F.struct(_of("source", 1).alias("rank"), F.col("link_text"), F.col("source")))
    return every.groupBy("site", "url").agg(best.alias("_b")).select("site", "url", "_b.link_text", "_b.source")


def _of(column: str, place: int) -> Column:
    out = F.lit(None).cast("int")
    for row in SOURCES:
        out = F.when(F.col(column) == row[0], row[place]).otherwise(out)
    return out


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)))


def scored(rows: DataFrame) -> DataFrame:
    """Candidates (site, url, link_text, source, and where fetched title, description, text_length, ok) with page_type
    and relevance: the type whose words address and texts name most often, the first of equals."""
    address = F.lower(F.concat_ws(" ", urls.part(F.col("url"), 3), urls.part(F.col("url"), 4)))
    texts = F.lower(F.concat_ws(" ", "link_text", *[c for c in ("title", "description") if c in rows.columns]))
    rows = rows.withColumns({"_address": address, "_texts": texts})
    named = [F.struct((_hits(F.col("_address"), w) * TYPE_ADDRESS + _hits(F.col("_texts"), w) * TYPE_TEXT).alias("s"), F.lit(-k).alias("k"), F.lit(t).alias("t"), (_hits(F.col("_address"), w) * SCORE_ADDRESS + _hits(F.col("_texts"), w) * SCORE_TEXT).alias("r")) for k, (t, w) in enumerate(WORDS)]
    rows = rows.withColumn("_best", F.array_max(F.array(*named)))
    home, known = F.regexp_replace(urls.part(F.col("url"), 3), "/+$", "") == "", F.col("_best.s") > 0
    rows = rows.withColumn("page_type", F.when(home, "homepage").when(known, F.col("_best.t")).otherwise("unknown"))
    fetched = F.when(F.col("ok"), FETCHED).otherwise(0) + F.least(F.floor(F.coalesce("text_length", F.lit(0)) / PER_POINT), F.lit(MOST_POINTS)) if "ok" in rows.columns else F.lit(0)
    score = _of("source", 2) + F.when(F.col("page_type").isin("homepage", "unknown"), 0).otherwise(F.col("_best.r")) + fetched
    return rows.withColumn("relevance", score.cast("int")).drop("_address", "_texts", "_best")


def selected(found: DataFrame, most: int = MOST) -> DataFrame:
    """The candidates of each site that are fetched, with place: home and submitted pages, the best of each type, then
    the best of all, at most `most`. Of a site's type no more than `most` can count, so the rest is cut off first."""
    best = [F.desc("relevance"), F.desc(_of("source", 1)), F.col("url")]
    rows = found.withColumn("_own", F.row_number().over(W.partitionBy("site", "page_type").orderBy(*best))).filter(F.col("_own") <= most)
    kinds = [t for t, _ in WORDS]
    quota, at = F.lit(0), F.lit(len(kinds))
    for k, t in enumerate(kinds):
        quota, at = F.when(F.col("page_type") == t, QUOTAS[t]).otherwise(quota), F.when(F.col("page_type") == t, k).otherwise(at)
    group = F.when(F.col("source").isin("homepage", "submitted"), -1).when(F.col("_own") <= quota, at).otherwise(len(kinds))
    place = F.row_number().over(W.partitionBy("site").orderBy(group, *best))
    return rows.withColumn("place", place).filter(F.col("place") <= most).drop("_own")


def discovered(chosen: DataFrame, fetched: DataFrame) -> DataFrame:
    """The page of each type that stays: of the chosen addresses that were fetched (url, title, description,
    text_length, ok) and hold enough text the one that is now most relevant, the first chosen of equals."""
    rows = scored(chosen.drop("page_type", "relevance").join(fetched, "url"))
    usable = F.col("ok") & (F.col("text_length") >= F.when(F.col("page_type") == "homepage", LEAST_HOME).otherwise(LEAST_TEXT))
    rows = rows.filter(usable & (F.col("page_type") != "unknown"))
    first = F.min(F.struct((-F.col("relevance")).alias("r"), "place", "url", "source", "title"))
    return rows.groupBy("site", "page_type").agg(first.alias("_f")).select("site", "page_type", "_f.url", "_f.source", (-F.col("_f.r")).alias("relevance"), "_f.title")


def with_currency(pages: DataFrame, currencies: DataFrame) -> DataFrame:
    """Pages (page_id, url, html, …) whose script takes its currency from an endpoint, with that currency written into
    the first literal: (url, currency) is what the endpoints say. Only an endpoint of the page's own origin and a
    currency that is known count; other pages come through as they are."""
    asked = F.regexp_extract(F.coalesce("html", F.lit("")), ENDPOINT, 1)
    rows = pages.withColumn("_endpoint", F.when(asked != "", urls.absolute(asked, F.col("url"))))
    rows = rows.withColumn("_endpoint", F.when(urls.origin(F.col("_endpoint")) == urls.origin(F.col("url")), F.col("_endpoint")))
    said = currencies.select(F.col("url").alias("_endpoint"), F.trim("currency").alias("_currency")).filter(F.col("_currency").isin(*SIGNS)).groupBy("_endpoint").agg(F.min("_currency").alias("_currency"))
    rows = rows.join(said, "_endpoint", "left")
    parts = lambda k: F.regexp_extract("html", LITERAL, k)
    changed = F.concat(parts(1), F.lit("currency: '"), F.col("_currency"), F.lit("'"), parts(2))
    return rows.select(*[F.when(F.col("_currency").isNotNull() & F.col("html").rlike(LITERAL), changed).otherwise(F.col("html")).alias(c) if c == "html" else c for c in pages.columns])


#: How a script takes its currency from an endpoint, the literal that it sets, currencies that are taken; fixed values.
ENDPOINT = r"(?is)fetch\(['\"]([^'\"]*currency[^'\"]*)['\"]\).{0,300}?currency\s*=\s*data\.currency"
LITERAL = r"(?s)^(.*?)currency:\s*['\"][^'\"]+['\"](.*)$"
SIGNS = ("$", "€", "£")
