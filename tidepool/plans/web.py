"""Queries over pages: canonical URLs, sites, page types, metadata."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.functions import money
from tidepool.functions import text as T
from tidepool.functions import urls
from tidepool.operators import blocks, classify, versions
from tidepool.plans.registry import query, table
from tidepool.sources import dom, html

#: DuckDB's side of urls.canonical().
URL_PARTS = r"""
parts as (
  select page_id, url, html, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme,
    lower(regexp_extract(trim(url), '^[^:]*://([^/?#]*)', 1)) as authority,
    regexp_extract(trim(url), '^[^:]*://[^/?#]*([^?#]*)', 1) as path,
    regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1) as q
  from pages),
params as (
  select *, regexp_replace(regexp_replace(authority, '^.*@', ''), ':\d*$', '') as host,
    list_filter(string_split(q, '&'), lambda p: p <> '') as ps from parts),
named as (
  select *, list_filter(ps, lambda p: not (starts_with(lower(regexp_extract(p, '^[^=]*')), 'utm_')
    or lower(regexp_extract(p, '^[^=]*')) in ('fbclid', 'gclid', 'gbraid', 'mc_cid', 'mc_eid', 'msclkid', 'wbraid'))) as kept from params),
canon as (
  select *, scheme || '://' || regexp_replace(regexp_replace(authority, '^.*@', ''), case scheme when 'http' then ':80$' when 'https' then ':443$' else '^$' end, '') || regexp_replace(regexp_replace(path, '/{2,}', '/', 'g'), '/+$', '')
    || case when len(kept) > 0 then '?' || array_to_string(list_sort(kept), '&') else '' end as canonical_url from named)
"""
PATH_TYPE = r"""case when regexp_replace(path, '/+$', '') = '' then 'homepage'
  when regexp_matches(path, '(?i)(pricing|plans?|billing|subscriptions?)') then 'pricing'
  when regexp_matches(path, '(?i)(changelog|release|updates?|whats-new)') then 'changelog'
  when regexp_matches(path, '(?i)(features?|products?|solutions?|platform)') then 'features'
  when regexp_matches(path, '(?i)(docs?|help|guides?|support)') then 'docs' else 'other' end"""


@query(f"with {URL_PARTS} select page_id, canonical_url, sha256(canonical_url) as url_hash, substr(sha256(url), 1, 12) as short_id from canon")
def url_canonical(spark, sf_dir):
    """Canonical URL and its hash, short id of the page."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", urls.canonical(F.col("url")).alias("canonical_url"))
    return rows.select("page_id", "canonical_url", F.sha2("canonical_url", 256).alias("url_hash"), F.substring(F.sha2("url", 256), 1, 12).alias("short_id"))


@query(f"with {URL_PARTS} select page_id, scheme || '://' || authority as origin, (len(ps) - len(kept))::int as stripped from canon")
def url_origin_and_stripped(spark, sf_dir):
    """Origin and the number of tracking parameters."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.origin(url).alias("origin"), F.size(urls.stripped_parameters(url)).alias("stripped"))


@query(f"with {URL_PARTS} select regexp_replace(host, '^(www|m)\\.', '') as site, count(*) as pages, count(distinct host) as hosts from canon group by 1")
def url_sites(spark, sf_dir):
    """Pages and hosts of each site."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").groupBy(urls.site(url).alias("site")).agg(F.count("*").alias("pages"), F.count_distinct(urls.host(url)).alias("hosts"))


@query(
    f"with {URL_PARTS} select page_id, {PATH_TYPE} as page_type, "
    "regexp_matches(path, '(?i)/(login|log-in|signin|sign-in|signup|sign-up|auth|account|checkout|cart|billing-portal|admin|dashboard)(/|$)') as blocked from canon"
)
def url_page_types(spark, sf_dir):
    """Page type by path, and whether a crawl leaves the path out."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.path_type(url).alias("page_type"), urls.blocked_path(url).alias("blocked"))


@query(
    f"with {URL_PARTS} select canonical_url, min(page_id) as first_page_id, count(*) as copies, min_by({PATH_TYPE}, page_id) as page_type, "
    "min_by(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), page_id) as title from canon group by 1"
)
def url_duplicate_groups(spark, sf_dir):
    """Pages of one canonical URL: the first one, its type and title, and how many there are."""
    url = F.col("url")
    rows = table(spark, sf_dir, "pages").select("page_id", urls.canonical(url).alias("canonical_url"), urls.path_type(url).alias("page_type"), F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))
    first = lambda c: F.min_by(c, "page_id").alias(c)
    return rows.groupBy("canonical_url").agg(F.min("page_id").alias("first_page_id"), F.count("*").alias("copies"), first("page_type"), first("title"))


@query(
    f"with {URL_PARTS}, typed as (select page_id, regexp_replace(host, '^(www|m)\\.', '') as site, {PATH_TYPE} as page_type, length(html) as n from canon), "
    "ranked as (select *, row_number() over (partition by site, page_type order by n desc, page_id) as rank from typed) "
    "select site, page_type, rank::int as rank, page_id from ranked where rank <= case when page_type = 'pricing' then 3 else 2 end"
)
def url_candidate_quota(spark, sf_dir):
    """Pages of a site that are worth fetching: three pricing pages, two of each other type, longest first."""
    rows = table(spark, sf_dir, "pages").select("page_id", urls.site(F.col("url")).alias("site"), urls.path_type(F.col("url")).alias("page_type"), F.char_length("html").alias("_n"))
    rows = versions.top(rows, ["site", "page_type"], [F.desc("_n"), F.col("page_id")], 3)
    return rows.filter((F.col("rank") <= 2) | (F.col("page_type") == "pricing")).select("site", "page_type", "rank", "page_id")


@query(
    "select page_id, (len(string_split(lower(html), '<script')) - 1)::int as scripts, length(html)::int as n_chars, "
    "length(html) > 80000 or len(string_split(lower(html), '<script')) - 1 >= 5 as shell_signs from pages"
)
def page_shell_signs(spark, sf_dir):
    """Scripts and size of a page: signs that it needs a browser."""
    scripts = F.size(F.split(F.lower("html"), "<script")) - 1
    return table(spark, sf_dir, "pages").select("page_id", scripts.alias("scripts"), F.char_length("html").alias("n_chars"), ((F.char_length("html") > 80000) | (scripts >= 5)).alias("shell_signs"))


@query("select page_id, count(*) as links from (select page_id, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\"')) as x from pages) group by 1")
def page_link_counts(spark, sf_dir):
    """Links in the markup of each page that has any."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="[^"]*"'), F.lit(0))))
    return rows.groupBy("page_id").agg(F.count("*").alias("links"))


#: The entities of the pages' markup; a parser takes them without their semicolon, too.
UNESCAPED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({0}, '&#x27;', chr(39)), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"
KEPT_TAGS = "title|meta|h[1-6]|p|li|a|button|td|th|summary|blockquote|article|section|nav|footer|header|aside|table|div|form|dialog|script"


@query(
    f"with {URL_PARTS}, a as (select page_id, scheme, authority, host, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) as h, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2)) as t from canon) "
    f"select page_id, trim(regexp_replace({UNESCAPED.format('t')}, '\\s+', ' ', 'g')) as text, trim({UNESCAPED.format('h')}) as href, regexp_replace(scheme || '://' || authority || trim({UNESCAPED.format('h')}), '#.*$', '') as target, "
    f"case when regexp_matches(h, '(?i)^/([^?#]*/)?(login|log-in|signin|sign-in|signup|sign-up|auth|account|checkout|cart|billing-portal|admin|dashboard)(/|$|\\?)') then 'excluded_path' end as rejected from a"
)
def page_links(spark, sf_dir):
    """Every link with its absolute URL and why it is rejected, if it is."""
    found = html.elements(table(spark, sf_dir, "pages"), "page_id", "html", ["url"], ("a",))
    return html.links(found, "url").select("page_id", "text", "href", "target", "rejected")


#: DuckDB's side of the pages' articles and of what a segment or line of text is.
def _plain(x: str) -> str:
    return f"trim(regexp_replace({UNESCAPED.format(f'regexp_replace({x}, {chr(39)}<[^>]*>{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')}, '\\s+', ' ', 'g'))"


ARTICLES = (
    "articles as (select page_id, html, regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1) as h1, regexp_extract(html, '(?s)<article><h1>.*?</h1>(.*?)</article>', 1) as body from pages)"
)
NO_SEGMENT = "length(t) < 2 or " + " or ".join(f"regexp_matches(t, '{p}')" for p in T.BOILERPLATE)


@query(
    f"with {ARTICLES}, s as (select page_id, 0 as i, 'h1' as tag, h1 as x from articles union all select page_id, k, 'p', regexp_extract(ps[k], '(?s)^(.*?)(?:</p>|$)', 1) from (select page_id, string_split(body, '<p>') as ps, unnest(range(2, len(string_split(body, '<p>')) + 1)) as k from articles)), "
    f"c as (select page_id, i, tag, {_plain('x')} as t from s), k as (select *, trim(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}$€£%]+', ' ', 'g')) as segment_key from c where t <> '' and not ({NO_SEGMENT})), "
    "f as (select *, row_number() over (partition by page_id, segment_key order by i) as n from k) select page_id, (row_number() over (partition by page_id order by i))::int as place, tag, t as text, segment_key from f where n = 1"
)
def page_segments(spark, sf_dir):
    """Distinct text segments of each page in document order, without navigation and boilerplate."""
    rows = html.segments(html.elements(table(spark, sf_dir, "pages"), "page_id", "html", tags=html.SEGMENT_TAGS))
    return rows.select("page_id", F.row_number().over(W.partitionBy("page_id").orderBy("ord")).alias("place"), "tag", "text", "segment_key")


@query(
    "select page_id, " + ", ".join(f"trim(regexp_replace({UNESCAPED.format(f'regexp_extract(html, {chr(39)}(?is)<{t}[^>]*>(.*?)</{t}>{chr(39)}, 1)')}, '\\s+', ' ', 'g')) as {t}" for t in ("title", "h1"))
    + f", null::varchar as description, len(regexp_extract_all(html, '<script'))::bigint as scripts, len(regexp_extract_all(html, '<(?:{KEPT_TAGS})[ >]'))::bigint as elements from pages"
)
def page_metadata(spark, sf_dir):
    """Title, description, first heading and language of each page."""
    return html.metadata(html.elements(table(spark, sf_dir, "pages"), "page_id", "html"))


def _says(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '(?i){pattern}')"


def _roles_sql() -> str:
    """DuckDB's side of blocks.classified() for pages of no known type."""
    cases = [(f"n{i}" + ("" if signal in blocks.DECIDING else " and not pricing"), f"'{role}'", "0.9") for i, (role, signal, _) in enumerate(blocks.NEGATIVE)]
    cases += [
        ("tag = 'nav'", "'navigation'", "0.95"), ("tag = 'footer'", "'footer'", "0.95"),
        (f"pricing and {_says('body', blocks.PLAN_CARD)}", f"case when {_says('body', blocks.COMPARED)} then 'plan_comparison' else 'pricing_card' end", "0.84"), ("pricing", "'pricing_section'", "0.8"),
        (_says("body", blocks.CHANGELOG), f"case when {_says('body', blocks.RELEASE)} then 'release_note' else 'changelog_entry' end", "0.76"), (_says("body", blocks.FEATURE), f"case when {_says('body', blocks.CONNECTED)} then 'integration_section' else 'feature_card' end", "0.74"),
        (_says("body", blocks.ACTION), "'cta_section'", "case when place <= 3 then 0.82 else 0.68 end"), (f"{_says('tag', blocks.HERO)} or place <= 1", "'hero'", "0.72"), (_says("body", blocks.QUESTIONS), "'faq'", "0.72"),
    ]
    rank = " ".join(f"when {when} then {k}" for k, (when, _, _) in enumerate(cases))
    pick = lambda i, otherwise: "case hit " + " ".join(f"when {k} then {c[i]}" for k, c in enumerate(cases)) + f" else {otherwise} end"
    signs = ", ".join(f"{_says('body', p)} as n{i}" for i, (_, _, p) in enumerate(blocks.NEGATIVE))
    near = lambda name, p: f"len(regexp_extract_all(text, '(?i){p}')[1:{blocks.MOST_NEAR}])::int as {name}"
    negative = "array_to_string(list_filter([" + ", ".join(f"case when n{i} and (hit is null or hit >= {i}) then '{s}' end" for i, (_, s, _) in enumerate(blocks.NEGATIVE)) + "], lambda x: x is not null), ',')"
    return f"""
with {ARTICLES}, made as (
  select page_id, 0 as raw, 'nav' as tag, array_to_string(list_filter(list_transform(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1), lambda x: {_plain('x')}), lambda x: x <> ''), chr(10)) as text, len(regexp_extract_all(html, '<a href="[^"]*">')) as a from articles
  union all select page_id, 2, 'article', array_to_string(list_filter(list_transform(string_split_regex('<h1>' || h1 || '</h1>' || body, '</?p>|</h1>|<br>|\\n'), lambda x: {_plain('x')}), lambda x: x <> ''), chr(10)), 0 from articles
  union all select page_id, 3, 'footer', array_to_string(list_filter(list_transform(string_split(replace(replace(regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1), '&copy;', '©'), '&middot;', '·'), chr(10)), lambda x: {_plain('x')}), lambda x: x <> ''), chr(10)), 0 from articles),
every as (
  select page_id, raw, tag, text, a, {_plain('h1')} as h1 from made join articles using (page_id)
  union all select page_id, 1, 'ul', text, a, '' from made join articles using (page_id) where tag = 'nav'),
placed as (
  select *, (row_number() over (partition by page_id order by raw) - 1)::int as place, tag || chr(10) || text as body, nullif(case when tag = 'article' then h1 else '' end, '') as heading,
    regexp_replace(lower(regexp_replace(tag || chr(10) || (case when tag = 'article' then h1 else '' end) || chr(10) || text, '\\s+', ' ', 'g')), '[^a-z0-9$€£]+', ' ', 'g') as key from every),
hits as (select *, {_says('body', blocks.PRICING)} as pricing, {signs}, {near('prices', blocks.NEAR_PRICES)}, {near('plan_words', blocks.NEAR_PLANS)}, {near('negative_words', blocks.NEAR_NEGATIVE)} from placed),
ranked as (select *, case {rank} end as hit from hits),
roled as (select *, {pick(1, "'unknown'")} as role, {pick(2, "0.42")} as confidence from ranked),
scored as (select *, confidence + case when prices > 0 then 0.08 else 0 end + case when plan_words > 0 then 0.06 else 0 end + case when a > 0 then 0.04 else 0 end - case when negative_words > 0 then 0.25 else 0 end as s from roled)
select page_id, place, tag, page_id || ':' || substr(sha1(raw || ':' || key), 1, 12) as block_id, role, confidence::double as confidence, {negative} as negative_signals,
  round(greatest(0, least(1, case when role in {blocks.NEVER} then least(s, 0.25) else s end)), 2)::double as score, heading, text, prices, plan_words, negative_words,
  least(a, 20)::int as links, case tag when 'nav' then a when 'ul' then a else 0 end::int as list_items, case tag when 'ul' then 0 end::int as inside_place
from scored"""


@query(_roles_sql())
def page_blocks(spark, sf_dir):
    """Blocks of each page: where they stand, role with confidence and signals, score, heading, lines of text, what is near."""
    rows = dom.rows(table(spark, sf_dir, "pages"), "blocks")
    rows = blocks.evidence(blocks.classified(rows, F.lit("unknown")))
    near = [F.size(c).alias(c) for c in ("prices", "plan_words", "negative_words")]
    return rows.select(
        "page_id", "place", "tag", blocks.block_id(F.col("page_id")).alias("block_id"), "role", "confidence", F.array_join("negative_signals", ",").alias("negative_signals"), F.col("block_score").alias("score"), "heading", "text", *near,
        F.size("link_urls").alias("links"), "list_items", F.col("inside").alias("inside_place"),
    )


_BLOCKS = _roles_sql()


def _kinds_sql() -> str:
    """DuckDB's side of blocks.older_kind() for navigation, articles and footers."""
    old = [("nav", "0.92", "tag = 'nav'"), ("footer", "0.92", "tag = 'footer'"), ("auth", "0.82", f"not {_says('body', blocks.OLDER_PRICE)} and {_says('body', blocks.OLDER_AUTH)}"), ("pricing", "0.88", _says("body", blocks.OLDER_PRICE))]
    old += [(k, str(c), _says("body", p)) for k, c, p in blocks.OLDER] + [("hero", "0.72", "place <= 1")]
    pick = lambda i, otherwise: "case " + " ".join(f"when {x[2]} then {x[i]}" for x in [(f"'{k}'", c, w) for k, c, w in old]) + f" else {otherwise} end"
    return f"with b as ({_BLOCKS}), k as (select *, tag || chr(10) || text as body from b where tag <> 'ul') select page_id, place, {pick(0, chr(39) + 'unknown' + chr(39))} as kind, {pick(1, '0.45')}::double as confidence from k"


@query(_kinds_sql())
def page_kinds(spark, sf_dir):
    """The older kinds of each page's blocks with the confidence in them."""
    rows = dom.rows(table(spark, sf_dir, "pages"), "blocks")
    rows = blocks.older_kind(rows.filter(blocks.is_older()).filter(F.col("place") < blocks.OLDER_MOST))
    return rows.select("page_id", "place", "kind", F.col("kind_confidence").alias("confidence"))


@query(
    f"with b as ({_BLOCKS}), r as (select page_id, case tag when 'ul' then 'NAV' else 'BODY' end as sibling_group, role, count(*) as n, min(place) as p from b group by 1, 2, 3) "
    "select page_id, sibling_group, sum(n)::bigint as blocks, min(p) as first_place, string_agg(role || '=' || n, ',' order by role) as roles from r group by 1, 2"
)
def block_groups(spark, sf_dir):
    """Blocks of each page by the siblings they stand among, with how many have which role."""
    rows = dom.rows(table(spark, sf_dir, "pages"), "blocks")
    rows = blocks.sibling_groups(blocks.classified(rows, F.lit("unknown")))
    roles = F.transform(F.array_sort(F.map_entries("roles")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.select("page_id", "sibling_group", "blocks", "first_place", F.array_join(roles, ",").alias("roles"))


ASKED = ("homepage", "pricing", "docs", "unknown", "features")


def _classes_sql() -> str:
    """DuckDB's side of classify.classified() for pages that were fetched, without home pages to compare with."""
    path = "case " + " ".join(f"when regexp_matches(lower(path), '{p}') then '{n}'" for n, p in classify.PATHS) + " when path in ('', '/') then 'homepage' else 'unknown' end"
    said = lambda roles, words: f"list_has_any(roles, {list(roles)}) or (" + " and ".join(f"regexp_matches(lower(body), '{w}')" for w in words) + ")"
    content = "case " + " ".join(f"when {said(roles, words)} then '{n}'" for n, roles, words in classify.CONTENT) + " else 'unknown' end"
    return (
        f"with {URL_PARTS}, b as ({_BLOCKS}), g as (select page_id, list(distinct role) as roles, string_agg(text, chr(10) order by place) as text from b group by 1), "
        f"t as (select page_id, path, {list(ASKED)}[(page_id % {len(ASKED)} + 1)::int] as asked, {_plain(f'regexp_extract(html, {chr(39)}(?is)<title[^>]*>(.*?)</title>{chr(39)}, 1)')} || chr(10) || g.text as body, g.roles as roles from canon join g using (page_id)), "
        f"c as (select *, {path} as by_path, {content} as by_content from t), k as (select *, case when asked = 'homepage' and by_path = 'homepage' then 'homepage' when by_content <> 'unknown' then by_content else by_path end as page_type, "
        f"case when by_path = by_content then {classify.AGREED} when by_content <> 'unknown' then {classify.BY_CONTENT} else {classify.BY_PATH} end as sure from c), "
        f"a as (select *, asked = page_type or (asked = 'homepage' and page_type in {classify.HOME_MAY_BE}) or asked = 'unknown' as allowed from k) "
        f"select page_id, page_type, case when asked = 'homepage' and by_path = 'homepage' then greatest(sure, {classify.HOME}) else sure end::double as type_confidence, 'url_path:' || by_path || ',content:' || by_content || case when allowed then '' else ',page_type_mismatch_or_unavailable' end as reasons, allowed from a"
    )


@query(_classes_sql())
def page_classes(spark, sf_dir):
    """The type of each page by content and path, why, and whether it may stand for the one that was asked for."""
    kinds = F.array(*[F.lit(x) for x in ASKED])
    pages = table(spark, sf_dir, "pages").withColumns({"requested": F.get(kinds, (F.col("page_id") % len(ASKED)).cast("int")), "status_code": F.lit(200), "url": urls.canonical(F.col("url"))})
    rows = classify.classified(dom.parsed(pages, carry=["url", "status_code", "requested"], parts=("elements", "blocks"), tags=("title", "meta")))
    return rows.select("page_id", "page_type", "type_confidence", F.array_join("reasons", ",").alias("reasons"), "allowed")


def _contexts_sql() -> str:
    """DuckDB's side of money.classified_context() for blocks, whose element is their tag."""
    case = lambda rows: "case " + " ".join(f"when {when} then '{n}'" for n, when in rows) + " end"
    has = lambda x, p: f"regexp_matches({x}, '{p}')"
    other = case([(n, has("plain", p)) for n, p in money.OTHER_CONTEXTS])
    priced = [(n, f"{has('tag', e)} or {has('plain', w)}") for n, e, w in money.PRICE_CONTEXTS]
    priced += [("plan_card", f"{has('tag', money.CARD_ELEMENT)} or ({has('plain', money.PRICED_WORDS)} and {has('plain', money.PLAN_LABEL)})"), ("product_pricing", has("plain", money.PRICED_WORDS))]
    return (
        f"with b as ({_BLOCKS}), n as (select page_id, place, tag, lower(trim(regexp_replace(regexp_replace(tag || ' ' || text, '[\u2013\u2014]', '-', 'g'), '\\s+', ' ', 'g'))) as plain, {has('tag', money.PRICED_ELEMENT)} as named from b), "
        f"c as (select *, {other} as other, {case(priced)} as priced from n) select page_id, place, case when other is not null and not named then other else coalesce(priced, other, 'unknown') end as classification, "
        "priced is not null and not (other is not null and not named) as accepted from c"
    )


@query(_contexts_sql())
def block_price_contexts(spark, sf_dir):
    """What an amount in each block of the crawled pages would be, and whether it would count as a price."""
    rows = dom.rows(table(spark, sf_dir, "pages"), "blocks", fields=("place", "tag", "text"))
    none = F.lit("unknown")
    return rows.select("page_id", "place", money.classified_context(F.col("text"), F.col("tag"), none, none).alias("c")).select("page_id", "place", "c.classification", "c.accepted")


def _meaningful_sql() -> str:
    """DuckDB's side of html.meaningful() for the crawled pages: title, navigation, heading, paragraphs, then sentences."""
    tidy = lambda x: f"trim(regexp_replace(regexp_replace({x}, '{html.CLOCK}', ' ', 'g'), '\\s+', ' ', 'g'))"
    bare = lambda x: UNESCAPED.format(f"replace(replace(regexp_replace(regexp_replace({x}, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·')")
    whole = UNESCAPED.format("replace(replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '<!--.*?-->|<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·')")
    useless = " or ".join(f"regexp_matches(t, '{p}')" for p in html.USELESS)
    once = lambda name, rows: f"{name}0 as (select *, trim(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}$€£%]+', ' ', 'g')) as key from {rows}), {name} as (select * from {name}0 where key <> '' and length(t) >= 2 and not ({useless}) qualify row_number() over (partition by page_id, key order by i) = 1)"
    return (
        f"with {ARTICLES}, s as (select page_id, 0 as i, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as x from pages union all select page_id, 10 + generate_subscripts(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1), 1), unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)) from pages "
        f"union all select page_id, 1000, h1 from articles union all select page_id, 1000 + k, regexp_extract(ps[k], '(?s)^(.*?)(?:</p>|$)', 1) from (select page_id, string_split(body, '<p>') as ps, unnest(range(2, len(string_split(body, '<p>')) + 1)) as k from articles)), "
        f"c as (select page_id, i, {tidy(bare('x'))} as t from s), {once('o', 'c')}, few as (select page_id, html from pages where page_id not in (select page_id from o group by 1 having count(*) >= {html.ENOUGH})), "
        f"w as (select page_id, list_filter(string_split_regex(regexp_replace({whole}, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(10) || '\\2', 'g'), '[\\n\\r]+'), lambda y: true)[1:{html.MOST_SENTENCES}] as ys from few), "
        f"m as (select page_id, 100000 + generate_subscripts(ys, 1) as i, {tidy('unnest(ys)')} as t from w), e as (select page_id, i, t from o union all select page_id, i, t from m), {once('f', 'e')} "
        "select page_id, (row_number() over (partition by page_id order by i))::int as place, t as text from f"
    )


@query(_meaningful_sql())
def page_texts(spark, sf_dir):
    """The meaningful text of each crawled page, segment by segment."""
    return html.meaningful(dom.rows(table(spark, sf_dir, "pages"), "meaningful"))
