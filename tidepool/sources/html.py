"""Pages as rows of elements: one Arrow stage over a standard HTML parser, everything after it native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.functions import text as T
from tidepool.functions import urls
from tidepool.sources import dom

SEGMENT_TAGS = ("h1", "h2", "h3", "h4", "p", "li", "td", "th", "blockquote", "summary")


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: list[str] | None = None, tags=dom.KEPT) -> DataFrame:
    """One row per element of each page with one of the tags, with the page's id and the columns carried
    along. Null pages have none."""
    return dom.part(dom.parsed(pages, id_col, html_col, carry, ("elements",), tags), "elements")


def links(found: DataFrame, base_col: str, id_col: str = "page_id") -> DataFrame:
    """Links with their absolute URL and the reason to leave them: anchor, scheme, external_domain, excluded_path."""
    base, href = F.col(base_col), F.trim(F.element_at("attrs", "href"))
    whole = urls.absolute(href, base)
    rows = found.filter("tag = 'a'").select(id_col, "ord", "text", base.alias("_base"), href.alias("href"), F.regexp_replace(whole, "#.*$", "").alias("target"))
    reason = (
        F.when(F.col("href").isNull() | (F.col("href") == "") | F.col("href").startswith("#"), "anchor")
        .when(F.col("href").rlike("(?i)^(mailto|tel|javascript|data):"), "scheme").when(~F.lower(urls.part(F.col("target"), 1)).isin("http", "https"), "invalid_url")
        .when(urls.site(F.col("target")) != urls.site(F.col("_base")), "external_domain").when(urls.blocked_path(F.col("target")), "excluded_path")
    )
    return rows.withColumn("rejected", reason).drop("_base")


def segments(found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Text of headings, paragraphs, items and cells outside navigation, each once a page, in order."""
    inside = ~F.col("path").rlike("(^|>)(nav|footer|aside|form|dialog|script|style)(>|$)")
    rows = found.filter(F.col("tag").isin(*SEGMENT_TAGS) & inside & (F.col("text") != ""))
    rows = rows.filter(~T.is_boilerplate(F.col("text"))).withColumn("segment_key", T.segment_key(F.col("text")))
    first = W.partitionBy(id_col, "segment_key").orderBy("ord")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(id_col, "ord", "tag", "text", "segment_key")


#: Times of day, and segments that mean nothing; segments from which no sentences are added, sentences at most; fixed values.
CLOCK = r"(?i)\b\d{1,2}:\d{2}(?::\d{2})?\s?(?:am|pm)?\b"
USELESS = (
    r"(?i)^(accept|reject|allow all|manage cookies|cookie settings|privacy policy|terms|terms of service|all rights reserved)$", r"(?i)^(facebook|twitter|x|linkedin|instagram|youtube|github|discord|slack)$",
    r"(?i)^(privacy|legal|security|status|careers|jobs)$", r"(?i)^©|\bcopyright\b|\ball rights reserved\b",
)
ENOUGH, MOST_SENTENCES = 8, 40


def meaningful(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page, place, text) of what a page's `meaningful` texts say, which come as dom.rows or as an array of the page: each once, without clock times and segments that
    mean nothing; pages with fewer than eight also get the first forty sentences of their body."""
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[\u200b-\u200d\ufeff]", ""), T.ascii_words(CLOCK), " "), r"\s+", " "))
    useful = lambda x: (F.char_length(x) >= 2) & ~x.rlike(USELESS[0]) & ~x.rlike(USELESS[1]) & ~x.rlike(USELESS[2]) & ~x.rlike(USELESS[3])

    def each_once(rows: DataFrame) -> DataFrame:
        first = W.partitionBy(id_col, "_key").orderBy("_at")
        return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")

    #: One pass over the parse: segments are cleaned and dealt by page once, with the page's body beside them under a null
    #: key; every window after that stays in the page's task.
    texts = (dom.part(pages, "meaningful") if "meaningful" in pages.columns else pages).select(id_col, F.col("ord").cast("long").alias("_at"), "kind", "text")
    #: Cleaned once: a filter on columns would clean the text anew for each of its patterns, one behind an explode doesn't.
    body = F.col("kind") == "body"
    read = lambda x: F.struct(x.alias("text"), F.when(~body, T.segment_key(x)).alias("_key"), (body | useful(x)).alias("_kept"))
    cleaned = F.get(F.transform(F.array(F.when(body, F.col("text")).otherwise(plain(F.col("text")))), read), F.lit(0))
    rows = texts.select(id_col, "_at", "kind", F.explode(F.array(cleaned)).alias("_r")).select(id_col, "_at", "kind", "_r.*")
    rows = rows.filter(F.col("_kept") & (body | (F.col("_key") != ""))).drop("_kept").repartition(id_col)
    rows = each_once(rows).withColumn("_own", F.count("_key").over(W.partitionBy(id_col)))
    cut = F.slice(F.split("text", r"[\n\r]+|(?<=[.!?])\s+(?=[A-Z0-9])"), 1, MOST_SENTENCES)
    own = F.col("kind") == "segment"
    rows = rows.filter(own | (F.col("_own") < ENOUGH)).withColumn("_cut", F.when(own, F.array("text")).otherwise(cut))
    rows = rows.select(id_col, "_at", "kind", "_key", F.posexplode("_cut").alias("_i", "text"))
    more = F.col("kind") == "body"
    rows = rows.withColumns({"_at": F.when(more, F.col("_i") + F.lit(1 << 40)).otherwise(F.col("_at")), "text": F.when(more, plain(F.col("text"))).otherwise(F.col("text"))})
    rows = rows.withColumn("_key", F.when(more, T.segment_key(F.col("text"))).otherwise(F.col("_key"))).filter(~more | ((F.col("_key") != "") & useful(F.col("text"))))
    return each_once(rows).select(id_col, F.row_number().over(W.partitionBy(id_col).orderBy("_at")).alias("place"), "text")


def metadata(found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """First title, description (or the one for sharing) and main heading of each page."""
    first = lambda when, value: F.min_by(F.when(when, value), F.when(when, F.col("ord")))
    named = lambda attr, name: (F.col("tag") == "meta") & (F.lower(F.element_at("attrs", attr)) == name)
    content = F.element_at("attrs", "content")
    return found.groupBy(id_col).agg(
        first(F.col("tag") == "title", F.col("text")).alias("title"),
        F.coalesce(first(named("name", "description"), content), first(named("property", "og:description"), content)).alias("description"),
        first(F.col("tag") == "h1", F.col("text")).alias("h1"), F.sum((F.col("tag") == "script").cast("int")).alias("scripts"), F.count("*").alias("elements"),
    )


def block_role(path: Column, classes: Column, body: Column) -> Column:
    """The first role whose signs a block has: where it stands, then what it says."""
    sign = lambda p: classes.rlike(p)
    return (
        F.when(path.rlike("(^|>)nav(>|$)") | sign("(?i)nav|menu"), "nav").when(path.rlike("(^|>)footer(>|$)") | sign("(?i)footer"), "footer")
        .when(sign("(?i)cookie|consent"), "cookie").when(sign("(?i)testimonial|review|quote"), "testimonial").when(sign("(?i)case-?study|customer-story"), "case_study")
        .when(path.rlike("(^|>)table$"), "table").when(sign("(?i)pric|plan|tier") | body.rlike("(?i)[$€£]\\s?\\d.*(/|per )\\s?(mo|month|user|year)"), "pricing")
        .when(body.rlike(r"(?i)\b(changelog|release notes|what's new)\b"), "changelog").when(sign("(?i)feature|benefit"), "feature").when(sign("(?i)hero"), "hero")
        .when(body.rlike(r"(?i)\b(faq|frequently asked)\b"), "faq").when(path.rlike("(^|>)(button|form)$"), "cta").otherwise("content")
    )


def evidence_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """Blocks of pages with heading, lines, button texts, role and an id that follows from place and content."""
    return with_roles(dom.part(dom.parsed(pages, id_col, html_col, carry, ("evidence",)), "evidence"), id_col)


def with_roles(rows: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Evidence of pages with its text, role and id."""
    body = F.array_join("lines", "\n")
    block = F.concat(F.col(id_col).cast("string"), F.lit(":"), F.substring(F.sha1(F.concat(F.col("ord").cast("string"), F.lit(":"), T.segment_key(body))), 1, 12))
    return rows.withColumns({"block_id": block, "text": body, "role": block_role(F.col("path"), F.col("classes"), body)})


def json_ld(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = 5) -> DataFrame:
    """The first five scripts of linked data of each page that parse, as VARIANT with type and name."""
    found = F.regexp_extract_all(html_col, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    rows = pages.select(id_col, F.posexplode(found).alias("ord", "_text")).withColumn("data", F.try_parse_json(F.trim("_text"))).filter("data is not null")
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(id_col).orderBy("ord"))).filter(F.col("_n") <= most)
    field = lambda path: F.try_variant_get("data", path, "string")
    return rows.select(id_col, "ord", field("$['@type']").alias("type"), field("$.name").alias("name"), "data")
