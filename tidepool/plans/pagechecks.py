"""Queries that judge pages and texts: addresses, types, categories, trust, signals, links, robots."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.functions import text as T
from tidepool.functions import urls
from tidepool.operators import matching, validate
from tidepool.plans.registry import query, table
from tidepool.sources import robots

URL = r"select page_id, url, html, lower(regexp_extract(trim(url), '^([A-Za-z]+)://', 1)) as scheme, lower(regexp_extract(trim(url), '^[^:]*://([^/?#]*)', 1)) as authority, regexp_extract(trim(url), '^[^:]*://[^/?#]*([^?#]*)', 1) as path, regexp_extract(trim(url), '^[^?#]*(\?[^#]*)', 1) as q from pages"
TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
STRIPPED = r"trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


def _title():
    return F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))


def _stripped():
    return F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"\s+", " "))


@query(f"with u as ({URL}) select page_id, trim(regexp_replace(path || ' ' || q, '[-_/]+', ' ', 'g')) as signal from u")
def url_path_signals(spark, sf_dir):
    """Path and query of each page as words."""
    return table(spark, sf_dir, "pages").select("page_id", urls.path_signal(F.col("url")).alias("signal"))


@query(
    "with h as (select page_id, page_id * 37 % 256 as a, page_id * 101 % 256 as b, case when page_id % 7 = 0 then 'db.internal' when page_id % 11 = 0 then 'shop.example.com' else (page_id * 37 % 256)::varchar || '.' || (page_id * 101 % 256)::varchar || '.0.1' end as host from pages) "
    "select page_id, host, case when host = 'db.internal' then true when host = 'shop.example.com' then false else a in (0, 10, 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 100 and b between 64 and 127) end as private from h"
)
def host_checks(spark, sf_dir):
    """Whether a host made from each page's number lies in one's own network."""
    octet = lambda k: (F.col("page_id") * k % 256).cast("string")
    host = F.when(F.col("page_id") % 7 == 0, "db.internal").when(F.col("page_id") % 11 == 0, "shop.example.com").otherwise(F.concat(octet(37), F.lit("."), octet(101), F.lit(".0.1")))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host")).withColumn("private", urls.private_host(F.col("host")))


@query(
    "select page_id, [null, 'empty', 'invalid', 'not_https', 'credentials', 'private_host'][(page_id % 6 + 1)::int] as error from pages"
)
def input_errors(spark, sf_dir):
    """Why an address that is typed in can't be taken; null if it can."""
    path = urls.part(F.col("url"), 3)
    typed = [F.concat(F.lit("shop.example.com"), path), F.lit("  "), F.concat(F.lit("https://a b"), path), F.concat(F.lit("http://shop.example.com"), path), F.concat(F.lit("https://me:pw@shop.example.com"), path), F.concat(F.lit("https://10.1.2.3"), path)]
    rows = table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(*typed), (F.col("page_id") % 6 + 1).cast("int")).alias("typed"))
    return rows.select("page_id", urls.input_error(F.col("typed")).alias("error"))


@query(f"with u as ({URL}) select page_id, scheme || '://' || authority || '/pricing?plan=pro' as built from u")
def built_urls(spark, sf_dir):
    """The address of another page of the same origin."""
    return table(spark, sf_dir, "pages").select("page_id", urls.built(F.col("url"), F.lit("/pricing/?utm_source=x&plan=pro#top")).alias("built"))


@query(
    f"with u as ({URL}), s as (select page_id, scheme, authority, regexp_replace(authority, '^www\\.', '') as site from u) "
    "select a.page_id, coalesce(a.site = b.site, false) as same_domain, coalesce(a.scheme || a.authority <> b.scheme || b.authority, true) as cross_origin from s a left join s b on b.page_id = a.page_id + 1"
)
def manual_pages(spark, sf_dir):
    """Whether the next page may be added by hand to a page's site, and whether a redirect to it leaves the origin."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    other = rows.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other"))
    rows = rows.join(other, "page_id", "left")
    return rows.select("page_id", urls.same_domain(F.col("url"), F.col("other")).alias("same_domain"), urls.cross_origin(F.col("url"), F.col("other")).alias("cross_origin"))


SCORES = " union all ".join(
    f"select page_id, requested, {k} as i, '{name}' as type, least({validate.MOST}, case when regexp_matches(signal, '{words}') then {validate.IN_PATH} else 0 end + case when regexp_matches(body, '{words}') then {validate.IN_TEXT} else 0 end"
    + (f" + case when regexp_replace(path, '/+$', '') = '' then {validate.ROOT} else 0 end" if name == "homepage" else "") + ") as score from s"
    for k, (name, words) in enumerate(validate.TYPE_WORDS)
)


def _cases(column: str, rows) -> str:
    """DuckDB's side of the first of (name, pattern) that a text has."""
    return "case " + " ".join(f"when regexp_matches({column}, '{p}') then '{n}'" for n, p in rows)


@query(
    f"with u as ({URL}), s as (select page_id, path, trim(regexp_replace(path || ' ' || q, '[-_/]+', ' ', 'g')) as signal, {TITLE} || chr(10) || substr({STRIPPED}, 1, 1600) as body, ['homepage', 'pricing', 'docs', 'blog'][(page_id % 4 + 1)::int] as requested from u), "
    f"x as ({SCORES}), b as (select page_id, any_value(requested) as requested, arg_max(type, score * 100 - i * 0.001) as t, max(score) as m from x group by 1), "
    "d as (select page_id, requested, case when m < 0.52 then 'unknown' else t end as page_type, round(m, 2) as confidence from b) "
    "select page_id, page_type, confidence, case when requested = page_type and confidence >= 0.58 then 'verified' when page_type = 'unknown' then 'unknown' else 'mismatch' end as status, "
    "requested = page_type or (requested = 'homepage' and page_type in ('features', 'pricing', 'changelog')) as compatible from d"
)
def page_type_scores(spark, sf_dir):
    """The scored type of each page, against the one that was asked for."""
    requested = F.element_at(F.array(*[F.lit(x) for x in ("homepage", "pricing", "docs", "blog")]), (F.col("page_id") % 4 + 1).cast("int"))
    body = F.concat(_title(), F.lit("\n"), F.substring(_stripped(), 1, 1600))
    rows = table(spark, sf_dir, "pages").select("page_id", requested.alias("requested"), validate.detected(validate.type_scores(F.col("url"), body)).alias("d"))
    kind, sure = F.col("d.type"), F.col("d.confidence")
    return rows.select("page_id", kind.alias("page_type"), sure.alias("confidence"), validate.type_status(F.col("requested"), kind, sure).alias("status"), validate.accepts(F.col("requested"), kind).alias("compatible"))


@query(
    f"with u as ({URL}), p as (select page_id, lower(path) as p from u) select page_id, case when p in ('', '/') then 'homepage' else {_cases('p', validate.ADMIN_TYPES)} else 'product' end end as page_type from p"
)
def admin_page_types(spark, sf_dir):
    """The type by path alone that the administrator's analysis starts from."""
    return table(spark, sf_dir, "pages").select("page_id", validate.admin_type(F.col("url")).alias("page_type"))


@query(
    f"with u as ({URL}), s as (select page_id, path, {STRIPPED} as t from u) select page_id, length(t)::int as n, length(t) >= case when regexp_replace(path, '/+$', '') = '' then 40 else 80 end as usable from s"
)
def usable_pages(spark, sf_dir):
    """Whether a page shows enough text: 40 characters on a homepage, 80 elsewhere."""
    least = F.when(urls.path_type(F.col("url")) == "homepage", 40).otherwise(80)
    return table(spark, sf_dir, "pages").select("page_id", F.char_length(_stripped()).alias("n"), (F.char_length(_stripped()) >= least).alias("usable"))


def _without(tags):
    sql = "html"
    for tag in tags:
        sql = rf"regexp_replace({sql}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({sql}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"select page_id, md5({_without(('script', 'style', 'noscript', 'svg', 'template', 'nav', 'footer'))}) as text_md5 from pages")
def page_visible_text(spark, sf_dir):
    """Digest of what a page shows, without navigation and footer."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(validate.visible_text(F.col("html")).cast("binary")).alias("text_md5"))


@query(
    f"with t as (select page_id, {TITLE} as title, {STRIPPED} as body from pages) select page_id, nullif(trim(regexp_extract(title, '^[^|:\\-]*')), '') as company, "
    r"nullif(trim(regexp_replace(regexp_extract(body, '(?i)\b(?:for|built for|made for)\s+([^.\n]{4,80})', 1), '\s+', ' ', 'g')), '') as target, "
    "replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') as escaped from t"
)
def page_companies(spark, sf_dir):
    """Company and audience as title and text name them, and the title as markup."""
    rows = table(spark, sf_dir, "pages").select("page_id", _title().alias("title"), _stripped().alias("body"))
    return rows.select("page_id", validate.company(F.col("title")).alias("company"), validate.target_customer(F.col("body")).alias("target"), validate.html_escaped(F.col("title")).alias("escaped"))


ANCHORS = "select page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2)) as label, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1), 1) as i from pages"


def _anchors(spark, sf_dir):
    found = lambda k: F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(k))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(F.arrays_zip(found(1).alias("href"), found(2).alias("label"))).alias("i", "a")).select("page_id", "url", "i", "a.href", "a.label")


@query(f"with a as ({ANCHORS}) select page_id, rtrim(href, '/') as target, count(*) as copies, min_by(trim(label), i) filter (where trim(label) <> '') as label from a where starts_with(href, '/') group by 1, 2")
def page_link_texts(spark, sf_dir):
    """Links of each page by where they lead, with the first text that isn't empty."""
    rows = _anchors(spark, sf_dir).filter(F.col("href").startswith("/")).withColumns({"target": F.regexp_replace("href", "/+$", ""), "label": F.trim("label")})
    some = F.col("label") != ""
    return rows.groupBy("page_id", "target").agg(F.count("*").alias("copies"), F.min_by(F.when(some, F.col("label")), F.when(some, F.col("i"))).alias("label"))


@query(
    f"with a as ({ANCHORS}), f as (select page_id, lower(trim(label)) as label, min_by(href, i) as destination from a group by 1, 2) "
    "select page_id, label, destination, regexp_matches(label, '^(login|log in|sign in|home|features|docs|blog|pricing|plans|packages)$') as weak from f"
)
def call_destinations(spark, sf_dir):
    """Where each text of a page leads, by its first link, and whether it is too weak for a call to action."""
    rows = _anchors(spark, sf_dir).groupBy("page_id", F.lower(F.trim("label")).alias("label")).agg(F.min_by("href", "i").alias("destination"))
    return rows.withColumn("weak", F.col("label").rlike("^(login|log in|sign in|home|features|docs|blog|pricing|plans|packages)$"))


SITE = "regexp_replace(regexp_replace(authority, ':\\d*$', ''), '^(www|m)\\.', '')"


@query(
    f"with u as ({URL}), s as (select page_id, {SITE} as site, path from u) select page_id, not starts_with(path, '/fr/') or starts_with(path, '/fr/1') as allowed from s"
)
def robots_decisions(spark, sf_dir):
    """Whether each page may be fetched, by the longest rule of its site's robots file."""
    rows = table(spark, sf_dir, "pages").select("page_id", urls.site(F.col("url")).alias("site"), urls.part(F.col("url"), 3).alias("path"))
    text = "User-agent: *\nDisallow: /fr/ # French pages\nAllow: /fr/1\nDisallow:\nUser-agent: otherbot\nDisallow: /"
    files = rows.select("site").distinct().withColumn("text", F.lit(text))
    return robots.allowed(rows, robots.rules(files, "site", "text"), "site", "path", "tidepool").select("page_id", "allowed")


@query(f"with u as ({URL}) select {SITE} as site, count(distinct trim(url)) as urls from u group by 1")
def sitemap_urls(spark, sf_dir):
    """Locations in each site's map, each once."""
    rows = table(spark, sf_dir, "pages").select(urls.site(F.col("url")).alias("site"), F.concat(F.lit("<url><loc> "), F.trim("url"), F.lit(" </loc></url>")).alias("entry"))
    return robots.sitemap(rows, "site", "entry").groupBy("site").agg(F.count("*").alias("urls"))


@query(
    f"with d as (select doc_id, list_filter({LINES}, lambda x: length(x) between 4 and 180) as ls, text from documents) select doc_id, "
    + ", ".join(f"len(list_filter(ls, lambda x: regexp_matches(x, '{p}'))[1:6])::int as {n}" for n, p in validate.TRUST)
    + "".join(f", len(list_filter({LINES}, lambda x: regexp_matches(x, '{p}'))) > 0 as {n}" for n, p in validate.TRUST_SIGNS)
    + ", case when len(list_filter(ls, lambda x: " + " or ".join(f"regexp_matches(x, '{p}')" for _, p in validate.TRUST) + ")) > 0 then 'medium' else 'low' end as confidence from d"
)
def doc_trust(spark, sf_dir):
    """How many lines of a text (six at the most) speak of users, reviews, security and compliance."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.lines(F.col("text")).alias("ls"))
    rows = rows.select("doc_id", *[F.size(validate.picked_lines(F.col("ls"), pattern)).alias(name) for name, pattern in validate.TRUST], *[F.exists("ls", lambda x: x.rlike(p)).alias(n) for n, p in validate.TRUST_SIGNS])
    some = F.lit(0)
    for name, _ in validate.TRUST:
        some = some + F.col(name)
    return rows.withColumn("confidence", F.when(some > 0, "medium").otherwise("low"))


@query(
    "with d as (select doc_id, lower(coalesce(text, '')) as t from documents), m as (select doc_id, list_filter(["
    + ", ".join(f"case when regexp_matches(t, '{p}') then '{n}' end" for n, p in validate.MARKETS)
    + "], lambda x: x is not null) as c, list_filter([case when contains(t, 'contact sales') then 'sales-led' end, case when contains(t, 'free') then 'free tier' end], lambda x: x is not null) as b from d) select doc_id, c[1] as market, array_to_string(c[2:4], ', ') as adjacent, array_to_string(b, ', ') as business_signals from m"
)
def doc_markets(spark, sf_dir):
    """The market that a text's words name, and up to three beside it."""
    rows = table(spark, sf_dir, "documents").select("doc_id", validate.markets(F.coalesce("text", F.lit(""))).alias("c"), validate.business_signals(F.coalesce("text", F.lit("")), F.array().cast("array<string>")).alias("b"))
    return rows.select("doc_id", F.get("c", F.lit(0)).alias("market"), F.array_join(F.slice("c", 2, 3), ", ").alias("adjacent"), F.array_join("b", ", ").alias("business_signals"))


@query(f"with p as (select p_partkey, lower(p_name || ' ' || p_type) as t from part) select p_partkey, {_cases('t', validate.FEATURE_CATEGORIES)} else 'product' end as category from p")
def feature_categories(spark, sf_dir):
    """The category of each named thing."""
    return table(spark, sf_dir, "part").select("p_partkey", validate.first_match(F.lower(F.concat_ws(" ", "p_name", "p_type")), validate.FEATURE_CATEGORIES, "product").alias("category"))




PRICES, PLANS, NEGATIVES = validate.NEAR_PRICES, validate.NEAR_PLANS, validate.NEAR_NEGATIVE


@query(
    f"with d as (select doc_id, unnest({LINES}) as x, generate_subscripts({LINES}, 1) as n from documents), s as (select doc_id, n, x, regexp_extract_all(x, '{PRICES}')[1:12] as p, regexp_extract_all(x, '{PLANS}')[1:12] as w, regexp_extract_all(x, '{NEGATIVES}')[1:12] as g from d where length(x) >= 4) "
    "select doc_id, count(*) as blocks, sum(len(p))::bigint as prices, sum(len(w))::bigint as plan_words, sum(len(g))::bigint as negative_words, "
    "round(max(greatest(0, least(1, 0.4 + case when len(p) > 0 then 0.08 else 0 end + case when len(w) > 0 then 0.06 else 0 end - case when len(g) > 0 then 0.25 else 0 end))), 2)::double as best_score from s group by 1"
)
def line_block_scores(spark, sf_dir):
    """Signals of a text's lines as blocks (those of four characters or more), and the best score among them."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.lines(F.col("text"))).alias("x")).filter("char_length(x) >= 4")
    number = lambda pattern, name: F.sum(F.size(validate.near(F.col("x"), pattern))).alias(name)
    score = validate.block_score(F.lit("content"), F.lit(0.4), F.col("x"), F.lit(0))
    return rows.groupBy("doc_id").agg(F.count("*").alias("blocks"), number(validate.NEAR_PRICES, "prices"), number(validate.NEAR_PLANS, "plan_words"), number(validate.NEAR_NEGATIVE, "negative_words"), F.max(score).alias("best_score"))


@query(
    r"with d as (select doc_id, text, regexp_extract(text, '(?s)^(.*?)\d{2,}', 1) as a, regexp_extract(text, '\d{2,}') as m from documents where regexp_matches(text, '\d{2,}')), "
    "e as (select *, substr(text, length(a) + length(m) + 1) as b from d), l as (select *, trim(regexp_replace(array_to_string(string_split(a, chr(10))[-2:], chr(10)) || m || array_to_string(string_split(b, chr(10))[1:2], chr(10)), '\\s+', ' ', 'g')) as local from e) "
    "select doc_id, case when length(local) > 180 then trim(regexp_replace(right(a, 140) || m || left(b, 140), '\\s+', ' ', 'g')) else local end as context from l"
)
def number_contexts(spark, sf_dir):
    """The first number of each text with the lines around it, or 140 characters on either side."""
    rows = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"\d{2,}"))
    rows = rows.select("doc_id", "text", F.regexp_extract("text", r"(?s)^(.*?)\d{2,}", 1).alias("a"), F.regexp_extract("text", r"\d{2,}", 0).alias("m"))
    rows = rows.withColumn("b", F.substring("text", F.char_length("a") + F.char_length("m") + 1, F.lit(1 << 30)))
    return rows.select("doc_id", validate.context_window(F.col("a"), F.col("m"), F.col("b")).alias("context"))


@query(
    f"with t as (select doc_id, {LINES} as ls from documents), c as (select doc_id, ls, unnest(list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '\\d'))) as i from t), "
    "x as (select *, row_number() over (partition by doc_id order by i) as number, array_to_string(ls[greatest(i - 1, 1):i + 1], ' ') as context from c), f as (select *, list_position(list_transform(ls, lambda l: contains(context, l)), true) as k from x) "
    "select doc_id, number, k::int as line_no, md5(ls[k]) as line, md5(case when k > 1 then ls[k - 1] end) as line_before from f"
)
def line_before_match(spark, sf_dir):
    """For each line with a number its context (with the lines beside it), the first line of the text that the context holds whole, and the line before that."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.lines(F.col("text")).alias("ls"))
    near = F.transform("ls", lambda x, i: F.when(x.rlike(r"\d"), F.array_join(F.slice("ls", F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), " ")))
    rows = matching.first_lines(rows.select("doc_id", "ls", F.array_compact(near).alias("contexts")), "doc_id", "ls", "contexts")
    return rows.select("doc_id", "number", "line_no", F.md5("line").alias("line"), F.md5("line_before").alias("line_before"))


@query(
    f"with d as (select doc_id, unnest({LINES}) as text, generate_subscripts({LINES}, 1) as ord from documents), "
    f"b as (select *, case when length(text) < 40 then 'nav' when regexp_matches(text, '{PRICES}') then 'pricing' when regexp_matches(text, '{NEGATIVES}') then 'testimonial' else 'content' end as role from d), "
    "k as (select *, row_number() over (partition by doc_id order by (role = 'pricing') desc, ord) as rank from b where role <> 'nav'), "
    "f as (select doc_id, concat_ws(chr(10), nullif(lang, ''), nullif(text, '')) as text from documents where doc_id not in (select doc_id from k)) "
    "select doc_id, rank::int as rank, role, md5(text) as text_md5, 0.6::double as confidence, 'model' as source from k union all select doc_id, 1, 'unknown', md5(text), 0.4::double, 'fallback' from f"
)
def analysis_order(spark, sf_dir):
    """Lines of texts as blocks in the order in which price analysis reads them: those with prices first, short ones (navigation) left out; whole texts where nothing is left."""
    docs = table(spark, sf_dir, "documents")
    x = F.col("text")
    role = F.when(F.char_length(x) < 40, "nav").when(x.rlike(validate.NEAR_PRICES), "pricing").when(x.rlike(validate.NEAR_NEGATIVE), "testimonial").otherwise("content")
    blocks = docs.select("doc_id", F.posexplode(T.lines(x)).alias("ord", "text")).select("doc_id", "ord", "text", role.alias("role"), F.lit(0.6).alias("confidence"))
    whole = docs.select("doc_id", validate.block_text(F.col("lang"), x).alias("text"))
    rows = validate.analysis_blocks(whole, blocks, ("pricing",), "doc_id")
    return rows.select("doc_id", "rank", "role", F.md5("text").alias("text_md5"), "confidence", "source")
