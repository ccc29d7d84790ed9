"""Queries that compare versions: claims, calls to action, features, lines, warnings, facts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.functions import text as T
from tidepool.operators import compare, versions
from tidepool.plans.registry import query, table

KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9$€£]+', ' ', 'g'))"
TOKENS = r"list_distinct(list_filter(string_split_regex({0}, '\s+'), lambda t: length(t) > 2))"
SHORT = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def _cut(x, n):
    x = SHORT.format(x)
    return f"case when length({x}) <= {n} then {x} else trim(substr({x}, 1, {n - 3})) || '...' end"


@query(
    f"with t as (select conv_id, turn, text, {KEY.format('text')} as k from conversations), p as (select *, lag(k) over w as pk, lag(text) over w as ptext from t window w as (partition by conv_id order by turn)), "
    f"s as (select *, {TOKENS.format('k')} as a, {TOKENS.format('pk')} as b from p where pk is not null and pk <> k), j as (select *, len(list_distinct(list_concat(a, b))) as n, len(list_intersect(a, b)) as m from s) "
    "select conv_id, turn, ['main_value_prop', 'homepage_headline', 'target_customer', 'product_category'][(turn % 4 + 1)::int] || '_changed' as change_type, case when turn % 4 = 2 then 'high' else 'medium' end as severity from j where case when n = 0 then 1 else m / n end < 0.82"
)
def claim_changes(spark, sf_dir):
    """Claims that say something else than the version before: less than 82 % of their words are shared."""
    rows = versions.with_previous(table(spark, sf_dir, "conversations").withColumn("k", T.sentence_key(F.col("text"))), ["conv_id"], [F.col("turn")], ["k"])
    claims = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).alias("s")) for n, s in (compare.CLAIMS[3], *compare.CLAIMS[:3])])
    claim = F.get(claims, (F.col("turn") % 4).cast("int"))
    rows = rows.filter(compare.claim_differs(F.col("prev_k"), F.col("k")))
    return rows.select("conv_id", "turn", F.concat(claim["n"], F.lit("_changed")).alias("change_type"), claim["s"].alias("severity"))


@query(
    "with e as (select *, event_type || ':' || lower(trim(event_type)) || ':' || coalesce(case when user_id % 2 = 0 then '/start' end, '') as k, least(0.95, value / 20) as score from events), p as (select *, lag(k) over w as pk, lag(event_type) over w as ptype, lag(score) over w as ps from e window w as (partition by user_id order by ts, event_id)) "
    "select event_id, user_id, ptype as old_value, event_type as new_value, round(least(score, ps), 4) as confidence, 'Primary CTA changed from \"' || ptype || '\" to \"' || event_type || '\".' as summary from p where pk <> k"
)
def cta_changes(spark, sf_dir):
    """Changes of each user's primary call to action, with the lower confidence of both versions."""
    rows = table(spark, sf_dir, "events").withColumns({"k": compare.cta_key(F.col("event_type"), F.col("event_type"), F.when(F.col("user_id") % 2 == 0, "/start")), "score": F.least(F.lit(0.95), F.col("value") / 20)})
    rows = versions.with_previous(rows, ["user_id"], [F.col("ts"), F.col("event_id")], ["k", "event_type", "score"]).filter("prev_k <> k")
    summary = F.concat(F.lit('Primary CTA changed from "'), F.col("prev_event_type"), F.lit('" to "'), F.col("event_type"), F.lit('".'))
    return rows.select("event_id", "user_id", F.col("prev_event_type").alias("old_value"), F.col("event_type").alias("new_value"), F.round(F.least("score", "prev_score"), 4).alias("confidence"), summary.alias("summary"))


@query(
    "with b as (select l_orderkey, list(l_partkey order by l_linenumber, l_partkey) as ps from lineitem group by 1), o as (select o_custkey, o_orderkey, o_orderdate, ps, lag(ps) over (partition by o_custkey order by o_orderdate, o_orderkey) as old from orders join b on o_orderkey = l_orderkey) "
    "select o_orderkey, list_filter(ps, lambda x: not list_contains(old, x))[1] as feature_added, list_filter(old, lambda x: not list_contains(ps, x))[1] as feature_removed, o_orderdate as last_update, "
    "len(list_filter(ps, lambda x: not list_contains(old, x))) = 0 as date_only from o where old is not null"
)
def feature_changes(spark, sf_dir):
    """The first thing that each order adds to, and lacks of, the one before of its customer; whether only the date moved."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    baskets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(parts.alias("ps"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").join(baskets, "o_orderkey")
    rows = versions.with_previous(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["ps"]).filter("prev_ps is not null")
    new = compare.first_added(F.col("ps"), F.col("prev_ps"))
    return rows.select("o_orderkey", new.alias("feature_added"), compare.first_added(F.col("prev_ps"), F.col("ps")).alias("feature_removed"), F.col("o_orderdate").alias("last_update"), new.isNull().alias("date_only"))


LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"
def _filled(sentence: str, **named: str) -> str:
    """DuckDB's side of a sentence with names."""
    return " || ".join(named[x] if name else "'" + x.replace("'", "''") + "'" for name, x in compare.parts_of(sentence))


def _summaries_sql() -> str:
    firsts = ", ".join(f"list_filter({side}, lambda x: regexp_matches(x, '{p}'))[1] as {side}_{n}" for side in "ar" for n, p in compare.SPEAKS.items())
    cut = lambda x: _cut(x, compare.QUOTED)
    cases = [(f"a_{n} is not null" + (f" and r_{n} is not null" if "-" in sides else ""), _filled(text, page="role", new=cut(f"a_{n}"), old=cut(f"r_{n}"))) for n, sides, text in compare.SAID]
    counts = lambda n: {"page": "role", "added": "len(a)", "removed": "len(r)", "s": f"case when len({n}) = 1 then '' else 's' end"}
    long = f"length(a[1]) > {compare.CLAIM_LENGTH} and length(r[1]) > {compare.CLAIM_LENGTH}"
    cases += [(long, _filled(compare.CLAIMED, page="role", new=cut("a[1]"), old=cut("r[1]"))), ("len(a) > 0 and len(r) > 0", _filled(compare.BOTH, **counts("a"))), ("len(a) > 0", _filled(compare.ONLY_ADDED, **counts("a")))]
    return (
        f"with t as (select conv_id, turn, role, {LINES} as ls from conversations), p as (select *, lag(ls) over (partition by conv_id order by turn) as old from t), "
        "d as (select conv_id, turn, role, list_filter(ls, lambda x: not list_contains(old, x)) as a, list_filter(old, lambda x: not list_contains(ls, x)) as r from p where old is not null), "
        f"e as (select *, {firsts} from d) select conv_id, turn, case " + " ".join(f"when {when} then {then}" for when, then in cases) + f" else {_filled(compare.ONLY_REMOVED, **counts('r'))} end as summary from e"
    )


@query(_summaries_sql())
def line_summaries(spark, sf_dir):
    """One sentence on what each turn's lines add to and take from the turn before."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.lines(F.col("text")).alias("ls"))
    rows = versions.with_previous(rows, ["conv_id"], [F.col("turn")], ["ls"]).filter("prev_ls is not null")
    keep = lambda a, b: F.filter(a, lambda x: ~F.array_contains(b, x))
    rows = rows.select("conv_id", "turn", "role", keep(F.col("ls"), F.col("prev_ls")).alias("a"), keep(F.col("prev_ls"), F.col("ls")).alias("r"))
    return rows.select("conv_id", "turn", compare.line_summary(F.col("role"), F.col("a"), F.col("r")).alias("summary"))


@query(
    "with e as (select event_id, case when user_id % 3 = 0 then null when user_id % 3 = 1 then event_type || '_changed' else ['plan_added', 'main_value_prop_changed', 'feature_removed', 'last_update_date_changed'][(event_id % 4 + 1)::int] end as t, ['pricing', 'docs'][(event_id % 2 + 1)::int] as page_type, case when value > 15 then 'high' else 'low' end as severity from events), v as (select *, coalesce(t, page_type) as v from e) "
    "select event_id, case " + " ".join(f"when regexp_matches(v, '{p}') then '{n}'" for n, p in compare.LABELS) + " when page_type = 'docs' then 'Docs' else 'Pricing' end as label, "
    f"case when severity = 'high' then '{compare.SEVERE}' " + " ".join(f"when page_type = '{k}' then '{w}'" for k, w in compare.MATTERS) + f" else '{compare.ELSE}' end as why from v"
)
def change_labels(spark, sf_dir):
    """What each change is about, and why it matters."""
    kinds = F.array(*[F.lit(x) for x in ("plan_added", "main_value_prop_changed", "feature_removed", "last_update_date_changed")])
    third = F.col("user_id") % 3
    change = F.when(third == 1, F.concat("event_type", F.lit("_changed"))).when(third == 2, F.get(kinds, (F.col("event_id") % 4).cast("int")))
    page = F.when(F.col("event_id") % 2 == 0, "pricing").otherwise("docs")
    rows = table(spark, sf_dir, "events").select("event_id", change.alias("t"), page.alias("p"), F.when(F.col("value") > 15, "high").otherwise("low").alias("s"))
    return rows.select("event_id", compare.change_label(F.col("t"), F.col("p")).alias("label"), compare.why_it_matters(F.col("p"), F.col("s")).alias("why"))


@query("select l_orderkey, l_linenumber, 'USD:' || printf('%.2f', l_extendedprice) || ':' || case when l_returnflag = 'A' then 'month' else '' end || ':' || case when l_linestatus = 'O' then 'user' else '' end as price_key from lineitem")
def price_keys(spark, sf_dir):
    """What two versions of a price are matched by."""
    key = compare.price_key(F.lit("USD"), F.col("l_extendedprice"), F.when(F.col("l_returnflag") == "A", "month"), F.when(F.col("l_linestatus") == "O", "user"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key.alias("price_key"))


NOTES = ("HTTP 403 at checkout", "openai api key missing", "pricing debug: 3 rejected", "No public pricing detected", "Not enough feature information detected", "stack trace hidden", "All good")


_PLAIN = "case " + " ".join(f"when regexp_matches(w, '{p}') then '{words}'" for p, words in compare.WARNINGS) + " else w end"
_AGAINST = dict(compare.CONTRADICTED)


@query(
    f"with o as (select o_custkey, o_orderstatus, {list(NOTES)}[(o_orderkey % 7 + 1)::int] as w from orders), n as (select o_custkey, list({_PLAIN}) as ws, bool_or(o_orderstatus = 'F') as pricing, bool_or(o_orderstatus = 'O') as features from o group by 1) "
    f"select o_custkey, coalesce(array_to_string(list_sort(list_filter(list_distinct(ws), lambda x: not (pricing and regexp_matches(x, '{_AGAINST['pricing']}')) and not (features and regexp_matches(x, '{_AGAINST['features']}')))), '|'), '') as warnings from n"
)
def plain_warnings(spark, sf_dir):
    """Warnings of each owner in plain words, each once, without those that what was found contradicts."""
    notes = F.array(*[F.lit(x) for x in NOTES])
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.get(notes, (F.col("o_orderkey") % 7).cast("int"))).alias("ws"), F.bool_or(F.col("o_orderstatus") == "F").alias("p"), F.bool_or(F.col("o_orderstatus") == "O").alias("f"))
    return rows.select("o_custkey", F.array_join(F.array_sort(compare.shown_warnings(F.col("ws"), {"pricing": F.col("p"), "features": F.col("f"), "changelog": F.lit(False)})), "|").alias("warnings"))


@query(
    f"with d as (select doc_id, text, {KEY.format('text')} as k, n_chars / 20000.0 as score from documents where text is not null) select doc_id, {_cut('text', 180)} as value, k as normalized_value, round(least(0.99, score), 2)::double as score, "
    f"case when least(0.99, score) >= 0.8 then 'high' when least(0.99, score) >= 0.6 then 'medium' else 'low' end as confidence, {_cut('text', 220)} as evidence, regexp_matches(trim(text), '{compare.GENERIC}') as generic from d"
)
def doc_facts(spark, sf_dir):
    """A fact of each text: cut value, normalised value, level of confidence, cut evidence, and whether it says nothing."""
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    made = compare.fact("positioning", F.lit("headline"), F.col("text"), F.least(F.lit(0.99), F.col("n_chars") / 20000), F.col("text"))
    return rows.select("doc_id", made.alias("f"), compare.is_generic(F.col("text")).alias("generic")).select("doc_id", "f.value", "f.normalized_value", "f.score", "f.confidence", "f.evidence", "generic")


@query(
    "select event_type, count(*) as facts, sum(try_cast(json_extract_string(props, '$.k') as double)) as total from events where json_extract_string(props, '$.k') is not null and user_id % 4 <> 0 group by 1"
)
def parsed_facts(spark, sf_dir):
    """Facts read from JSON permissively: broken ones and those without the required field drop out."""
    text = F.when(F.col("user_id") % 4 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json(text, "k double", {"mode": "PERMISSIVE"}).alias("f")).filter("f.k is not null")
    return rows.groupBy("event_type").agg(F.count("*").alias("facts"), F.sum("f.k").alias("total"))


@query(
    "with v as (select conv_id, turn, case when turn % 5 = 4 then '' else coalesce(text, '') end as t from conversations), h as (select conv_id, turn, sha256(t) as text_hash, sha256(length(t)::varchar) as size_hash from v), p as (select *, lag(text_hash) over w as pt, lag(size_hash) over w as ps from h window w as (partition by conv_id order by turn)) "
    "select conv_id, turn, array_to_string(list_filter([case when pt <> text_hash then 'text' end, case when ps <> size_hash then 'size' end], lambda x: x is not null), ',') as changed from p where pt is not null"
)
def changed_models(spark, sf_dir):
    """Which hashed models differ from the follow-up before; an unavailable version has the empty text."""
    text = F.when(F.col("turn") % 5 == 4, "").otherwise(F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(text, 256).alias("text_hash"), F.sha2(F.char_length(text).cast("string"), 256).alias("size_hash"))
    rows = versions.with_previous(rows, ["conv_id"], [F.col("turn")], ["text_hash", "size_hash"]).filter("prev_text_hash is not null")
    named = F.array_compact(F.array(*[F.when(F.col(f"prev_{c}") != F.col(c), n) for n, c in (("text", "text_hash"), ("size", "size_hash"))]))
    return rows.select("conv_id", "turn", F.array_join(named, ",").alias("changed"))


@query(
    "with t as (select page_id, case page_id % 7 when 0 then 'docs' when 1 then 'homepage' when 2 then 'pricing' when 3 then 'blog' when 4 then 'features' when 5 then 'product' else 'changelog' end as page_type, lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) as authority from pages) "
    "select page_id, page_type, row_number() over (partition by authority order by case page_type when 'homepage' then 0 when 'pricing' then 1 when 'features' then 2 when 'changelog' then 3 when 'docs' then 4 when 'product' then 5 else 6 end, page_type, page_id)::int as place from t"
)
def page_places(spark, sf_dir):
    """Pages of each host in the order in which types are shown."""
    kinds = F.array(*[F.lit(x) for x in ("docs", "homepage", "pricing", "blog", "features", "product", "changelog")])
    rows = table(spark, sf_dir, "pages").select("page_id", F.get(kinds, (F.col("page_id") % 7).cast("int")).alias("page_type"), F.lower(F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1)).alias("_host"))
    return rows.select("page_id", "page_type", F.row_number().over(W.partitionBy("_host").orderBy(compare.page_order(F.col("page_type")), "page_type", "page_id")).alias("place"))


@query(
    "with w as (select doc_id, unnest(regexp_extract_all(text, '[^\\s.,;:!?]+')[1:40]) as value from documents), f as (select distinct doc_id, case when length(value) % 2 = 0 then 'cta' else 'price' end as field, value from w) "
    "select doc_id, string_agg(field || ':' || value, ' ' order by field || ':' || value collate en, field || ':' || value) as facts from f group by 1"
)
def facts_by_locale(spark, sf_dir):
    """The facts that each text's first forty words make, in the order of readers: accents and case count last."""
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[^\s.,;:!?]+"), F.lit(0)), 1, 40)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("value"))
    rows = rows.withColumn("field", F.when(F.char_length("value") % 2 == 0, "cta").otherwise("price")).distinct()
    rows = compare.compact_order(rows, "doc_id", F.col("field"), F.col("value"))
    listed = F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "field", "value").alias("fact"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["fact"]), " ").alias("facts"))
