"""Queries that find a site's pages, and that write currencies into pages which take them from elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions import urls
from tidepool.operators import discovery
from tidepool.plans.registry import query, table
from tidepool.plans.web import URL_PARTS

#: Usual paths that pages get by their number; the last number keeps its own.
PATHS = ("/", "/pricing", "/product/tour", "/features?id=7", "/docs/help")
PLAIN = "[^<>\"]*"


def _made(spark, sf_dir):
    """Pages by canonical address with their site; each site's first page stands for its home page. Five of six pages
    get a usual path in place of their own, since the crawled ones name no type."""
    path = F.get(F.array(*[F.lit(p) for p in PATHS]), (F.col("page_id") % (len(PATHS) + 1)).cast("int"))
    url = F.coalesce(urls.built(F.col("url"), path), urls.canonical(F.col("url")))
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(path.isNull(), urls.canonical(F.col("url"))).otherwise(url).alias("url"), "html")
    pages = pages.withColumns({"site": urls.site(F.col("url")), "origin": urls.origin(F.col("url"))})
    sites = pages.groupBy("site").agg(F.min_by("origin", "page_id").alias("origin"), F.min_by("html", "page_id").alias("html"))
    return pages, sites


def _sitemaps(pages, sites):
    """Made sitemaps: an index that names itself and a first file, which holds even pages and names a second with the rest."""
    file = lambda rows, name: rows.select(F.concat("origin", F.lit(name)).alias("url"), F.col("x").alias("xml"))
    loc = lambda *parts: F.concat(F.lit("<url><loc> "), *parts, F.lit(" </loc></url>"))
    index = sites.select("origin", F.concat(loc(F.col("origin"), F.lit("/sitemap.xml")), loc(F.col("origin"), F.lit("/sitemap-a.xml")), loc(F.lit("https://elsewhere.test/sitemap-x.xml"))).alias("x"))
    held = pages.select("site", "url", "page_id").join(sites.select("site", "origin"), "site")
    some = lambda k: held.filter(F.col("page_id") % 2 == k).groupBy("origin").agg(F.array_join(F.array_sort(F.collect_set(loc(F.col("url")))), "").alias("y"))
    first = sites.select("origin").join(some(0), "origin", "left").select("origin", F.concat(loc(F.col("origin"), F.lit("/sitemap-b.xml?v=1")), F.coalesce("y", F.lit(""))).alias("x"))
    second = some(1).select("origin", F.col("y").alias("x"))
    return file(index, "/sitemap.xml").unionByName(file(first, "/sitemap-a.xml")).unionByName(file(second, "/sitemap-b.xml?v=1"))


def _hits(text: str, words) -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::int" for w in words) + ")"


def _scored_sql(name: str, rows: str, texts: str, more: str) -> str:
    """DuckDB's side of discovery.scored()."""
    of = lambda k: "case source " + " ".join(f"when '{s[0]}' then {s[k]}" for s in discovery.SOURCES) + " end"
    by = ", ".join(f"{_hits('address', w)} * {discovery.TYPE_ADDRESS} + {_hits('texts', w)} * {discovery.TYPE_TEXT} as s{k}, {_hits('address', w)} * {discovery.SCORE_ADDRESS} + {_hits('texts', w)} * {discovery.SCORE_TEXT} as r{k}" for k, (_, w) in enumerate(discovery.WORDS))
    top = "greatest(" + ", ".join(f"s{k}" for k in range(len(discovery.WORDS))) + ")"
    pick = lambda value: "case " + " ".join(f"when s{k} = top then {value(k, t)}" for k, (t, _) in enumerate(discovery.WORDS)) + " end"
    return (
        f"{name}0 as (select *, lower(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) || ' ' || coalesce(regexp_extract(url, '(\\?[^#]*)', 1), '')) as address, lower({texts}) as texts from {rows}), {name}1 as (select *, {by} from {name}0), {name}2 as (select *, {top} as top from {name}1), "
        f"{name}3 as (select *, case when regexp_replace(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/+$', '') = '' then 'homepage' when top > 0 then {pick(lambda k, t: chr(39) + t + chr(39))} else 'unknown' end as page_type, {pick(lambda k, t: f'r{k}')} as hits, {of(1)} as rank from {name}2), "
        f"{name} as (select *, ({of(2)} + case when page_type in ('homepage', 'unknown') then 0 else hits end{more})::int as relevance from {name}3)"
    )


KINDS = [t for t, _ in discovery.WORDS]
FOUND = (
    f"with {URL_PARTS}, p as (select page_id, coalesce(regexp_extract(canonical_url, '^[^:]*://[^/?#]*') || {[x.rstrip('/') for x in PATHS]}[(page_id % {len(PATHS) + 1} + 1)::int], canonical_url) as url, html, regexp_replace(host, '^(www|m)\\.', '') as site, regexp_extract(canonical_url, '^[^:]*://[^/?#]*') as origin from canon), "
    "sites as (select site, arg_min(origin, page_id) as origin, arg_min(html, page_id) as html from p group by 1), "
    f"l as (select site, origin, unnest(regexp_extract_all(html, '<a href=\"(/{PLAIN})\">({PLAIN})</a>', 1)) as h, unnest(regexp_extract_all(html, '<a href=\"(/{PLAIN})\">({PLAIN})</a>', 2)) as t from sites), "
    f"c as (select site, origin as url, null as link_text, 'homepage' as source from sites union all select site, origin || regexp_replace(regexp_replace(regexp_extract(h, '^[^?#]*'), '/{{2,}}', '/', 'g'), '/+$', ''), t, 'homepage_link' from l union all select site, url, null, 'sitemap' from p "
    f"union all select site, origin || regexp_replace(x, '/+$', ''), null, 'fallback' from sites, (select unnest({list(discovery.USUAL)}) as x)), "
    f"k as (select * from c where not regexp_matches(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '{discovery.EXCLUDED}') and not regexp_matches(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '{urls.BLOCKED_PATH}')), "
    "m as (select site, url, arg_max(link_text, w) as link_text, arg_max(source, w) as source from (select *, case source when 'homepage' then 4 when 'homepage_link' then 3 when 'sitemap' then 2 else 1 end * 1000000 + row_number() over (order by link_text nulls first) as w from k) group by 1, 2), "
    + _scored_sql("s", "m", "coalesce(link_text, '')", "")
    + ", o as (select *, row_number() over (partition by site, page_type order by relevance desc, rank desc, url) as own from s), "
    "g as (select *, case when source in ('homepage', 'submitted') then -1 when own <= case page_type " + " ".join(f"when '{t}' then {n}" for t, n in discovery.QUOTAS.items()) + " else 0 end then case page_type " + " ".join(f"when '{t}' then {k}" for k, t in enumerate(KINDS)) + f" end else {len(KINDS)} end as grp from o), "
    f"chosen as (select * from (select site, url, link_text, source, page_type, relevance, row_number() over (partition by site order by grp, relevance desc, rank desc, url)::int as place from g) where place <= {discovery.MOST}) "
)


def _chosen(spark, sf_dir):
    pages, sites = _made(spark, sf_dir)
    pattern = F.lit(f'<a href="(/{PLAIN})">({PLAIN})</a>')
    links = sites.select("site", "origin", F.explode(F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("h"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("t"))).alias("_l"))
    links = links.select("site", F.concat("origin", F.regexp_extract("_l.h", "^[^?#]*", 0)).alias("url"), F.col("_l.t").alias("text"))
    found = discovery.candidates(sites.select("site", "origin"), links, discovery.sitemap_pages(sites.select("site", "origin"), _sitemaps(pages, sites)))
    return pages, discovery.selected(discovery.scored(found))


@query(FOUND + "select site, place, url, page_type, source, relevance from chosen")
def candidate_pages(spark, sf_dir):
    """Addresses of each site that are worth fetching, from home page, its links, nested sitemaps and usual paths."""
    return _chosen(spark, sf_dir)[1].select("site", "place", "url", "page_type", "source", "relevance")


@query(
    FOUND + ", f as (select url, arg_min(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), page_id) as title, arg_min(length(regexp_replace(html, '<[^>]*>', '', 'g')), page_id) as text_length from p group by 1), "
    "j as (select site, url, link_text, source, place, title, text_length from chosen join f using (url)), " + _scored_sql("z", "j", "concat_ws(' ', link_text, title)", f" + {discovery.FETCHED} + least(text_length // {discovery.PER_POINT}, {discovery.MOST_POINTS})")
    + f", u as (select *, row_number() over (partition by site, page_type order by relevance desc, place) as n from z where page_type <> 'unknown' and text_length >= case when page_type = 'homepage' then {discovery.LEAST_HOME} else {discovery.LEAST_TEXT} end) "
    "select site, page_type, url, source, relevance, title from u where n = 1"
)
def pages_by_type(spark, sf_dir):
    """The page of each type that a site is watched at: the most relevant of those that were fetched and hold enough text."""
    pages, chosen = _chosen(spark, sf_dir)
    first = lambda c: F.min_by(c, "page_id")
    title, length = F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)), F.char_length(F.regexp_replace("html", "<[^>]*>", ""))
    fetched = pages.select("url", "page_id", title.alias("title"), length.alias("n")).groupBy("url").agg(first("title").alias("title"), F.lit(None).cast("string").alias("description"), first("n").alias("text_length"), F.lit(True).alias("ok"))
    return discovery.discovered(chosen, fetched)


@query(
    "with s as (select s_suppkey as page_id, s_suppkey % 4 as k, ['$', '€', '£', 'CHF'][(s_nationkey % 4 + 1)::int] as c from supplier) "
    "select page_id, case when k in (0, 1) and c <> 'CHF' then c when k = 3 then null else 'USD' end as currency from s"
)
def page_currencies(spark, sf_dir):
    """The currency literal of pages made of the suppliers, after that of their own endpoint has been written into it."""
    key, kind = F.col("s_suppkey"), F.col("s_suppkey") % 4
    origin = F.concat(F.lit("https://s"), key.cast("string"), F.lit(".example.com"))
    endpoint = F.when(kind == 0, F.lit("/api/currency")).when(kind == 1, F.concat(origin, F.lit("/api/currency"))).otherwise(F.lit("https://elsewhere.example.org/currency"))
    body = F.when(kind == 3, F.lit("<p>no script</p>")).otherwise(F.concat(F.lit("<script>fetch('"), endpoint, F.lit("').then(r => r.json()).then(data => { currency = data.currency; }); var a = { currency: 'USD' };</script>")))
    pages = table(spark, sf_dir, "supplier").select(key.alias("page_id"), F.concat(origin, F.lit("/pricing")).alias("url"), body.alias("html"), "s_nationkey")
    said = F.get(F.array(*[F.lit(x) for x in ("$", "€", "£", "CHF")]), (F.col("s_nationkey") % 4).cast("int"))
    own = pages.select(F.concat(F.regexp_replace("url", "/pricing$", ""), F.lit("/api/currency")).alias("url"), said.alias("currency"))
    other = pages.limit(1).select(F.lit("https://elsewhere.example.org/currency").alias("url"), F.lit("€").alias("currency"))
    rows = discovery.with_currency(pages, own.unionByName(other))
    return rows.select("page_id", F.nullif(F.regexp_extract("html", "currency: '([^']+)'", 1), F.lit("")).alias("currency"))
