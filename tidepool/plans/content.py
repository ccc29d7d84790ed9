"""Queries over documents and conversations: lines, comparable forms, duplicates, differences."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidepool.functions import text as T
from tidepool.operators import evaluate, versions
from tidepool.plans.registry import query, table

#: DuckDB's side of text.lines().
LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"


def _chain() -> str:
    """DuckDB's side of text.comparable(), for a column named s."""
    out = "s"
    for entity, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("euro", "€"), ("pound", "£"), ("#36", "$"), ("#39", "''"), ("amp", "&")):
        out = f"regexp_replace({out}, '(?i)&{entity};', '{char}', 'g')"
    for pattern, by in T.COMPARABLE:
        pattern = pattern.replace("'", "''").replace("​", r"\x{200b}").replace("‍", r"\x{200d}").replace("﻿", r"\x{feff}")
        by = by.replace("'", "''").replace("$1", r"\1").replace("$2", r"\2")
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    out = f"regexp_replace(lower({out}), '\\s+([,.;:!?/])', '\\1', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, '([,.;:!?/])', '\\1 ', 'g'), '\\s+', ' ', 'g'), ' ')"


BOILER = "length(t) < 2 or " + " or ".join(f"regexp_matches(t, '{p}')" for p in T.BOILERPLATE)


@query(f"select doc_id, len({LINES})::int as n_lines, sha256(coalesce(text, '')) as text_hash from documents")
def doc_lines(spark, sf_dir):
    """Lines that aren't empty, and the hash of the text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.lines(F.col("text"))).alias("n_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))


@query(
    "with seg as (select doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\n+')) as s from documents), "
    f"norm as (select doc_id, {_chain()} as t from seg), kept as (select distinct doc_id, t from norm where not ({BOILER})) "
    "select d.doc_id, sha256(coalesce(string_agg(t, chr(10) order by t), '')) as canonical_hash, count(t)::int as segments from documents d left join kept k using (doc_id) group by 1"
)
def doc_canonical_hash(spark, sf_dir):
    """Hash of the canonical content: distinct comparable segments, sorted, without boilerplate."""
    content = T.canonical_content(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", content.alias("_c"))
    return rows.select("doc_id", F.sha2("_c", 256).alias("canonical_hash"), F.when(F.col("_c") == "", 0).otherwise(F.size(F.split("_c", "\n"))).alias("segments"))


@query("select sha256(coalesce(text, '')) as text_hash, count(*) as copies, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def doc_exact_duplicates(spark, sf_dir):
    """Groups of equal texts with their first document."""
    rows = table(spark, sf_dir, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    return rows.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query("select doc_id, length(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9$€£]+', ' ', 'g'), ' '))::int as key_length, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9$€£]+', ' ', 'g'), ' ')) as key_hash from documents")
def doc_sentence_key(spark, sf_dir):
    """Length and hash of a text's key of letters, digits and currency signs."""
    key = T.sentence_key(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length(key).alias("key_length"), F.md5(key).alias("key_hash"))


@query(
    "with t as (select doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' ') as s from documents) "
    "select doc_id, case when length(s) <= 220 then s else trim(substr(s, 1, 217), ' ') || '...' end as evidence from t"
)
def doc_evidence(spark, sf_dir):
    """The text cut to 220 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", T.truncated(F.coalesce("text", F.lit(""))).alias("evidence"))


@query(
    f"with l as (select doc_id, {LINES} as ls from documents) "
    "select doc_id, (i - 1)::int as line_no, concat_ws(' ', ls[i - 1], ls[i], ls[i + 1]) as context from (select *, unnest(range(1, len(ls) + 1)) as i from l)"
)
def doc_line_context(spark, sf_dir):
    """Each line with the line before and the one behind it."""
    ls = T.lines(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(ls).alias("line_no", "_line"))
    w = W.partitionBy("doc_id").orderBy("line_no")
    return rows.select("doc_id", "line_no", F.concat_ws(" ", F.lag("_line").over(w), "_line", F.lead("_line").over(w)).alias("context"))


@query(
    f"with l as (select source, unnest({LINES}) as t from documents) "
    f"select source, count(*) as n_lines, round(count(*) filter (where {BOILER}) * 100.0 / count(*), 4) as boilerplate_percent from l group by 1"
)
def doc_boilerplate_rate(spark, sf_dir):
    """Share of lines by source that say nothing."""
    rows = table(spark, sf_dir, "documents").select("source", F.explode(T.lines(F.col("text"))).alias("t"))
    share = F.round(F.count_if(T.is_boilerplate(F.col("t"))) * 100.0 / F.count("*"), 4)
    return rows.groupBy("source").agg(F.count("*").alias("n_lines"), share.alias("boilerplate_percent"))


@query(
    "with t as (select doc_id, source, list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: length(x) > 2)) as ts, "
    "lead(doc_id) over w as next_id from documents window w as (partition by source order by doc_id)), "
    "p as (select a.doc_id, a.next_id, a.ts as x, b.ts as y from t a join t b on a.next_id = b.doc_id), "
    "s as (select doc_id, next_id, len(list_intersect(x, y)) as i, len(x) as m, len(y) as n from p) "
    "select doc_id, next_id, round(case when m + n = 0 then 1.0 else i::double / (m + n - i) end, 6) as similarity from s"
)
def doc_neighbour_similarity(spark, sf_dir):
    """Jaccard similarity of each document's words with those of the source's next document."""
    docs = table(spark, sf_dir, "documents")
    #: Only ids are put in order, in ranges, however large a source is; each text is cut into words once and goes to
    #: the pair with the document before it and to its own.
    order = versions.with_neighbour(docs.select("source", "doc_id"), "source", "doc_id", "before").select("doc_id", "before")
    words = docs.select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("w")).join(order, "doc_id")
    sides = F.explode(F.array(F.struct(F.col("doc_id").alias("pair"), F.lit(False).alias("later")), F.struct(F.col("before").alias("pair"), F.lit(True).alias("later"))))
    rows = words.select(F.col("doc_id").alias("own"), "w", sides.alias("s")).filter("s.pair is not null")
    side = lambda later, c: F.first(F.when(F.col("s.later") == later, F.col(c)), ignorenulls=True)
    rows = rows.groupBy(F.col("s.pair").alias("doc_id")).agg(side(True, "own").alias("next_id"), side(False, "w").alias("_t"), side(True, "w").alias("_next")).filter("next_id is not null")
    return rows.select("doc_id", "next_id", F.round(T.jaccard(F.col("_t"), F.col("_next")), 6).alias("similarity"))


@query(
    f"with l as (select conv_id, turn, {LINES} as ls from conversations), p as (select *, coalesce(lag(ls) over (partition by conv_id order by turn), []) as prev from l) "
    "select conv_id, turn, len(list_distinct(list_filter(ls, lambda x: not list_contains(prev, x))))::int as added, len(list_distinct(list_filter(prev, lambda x: not list_contains(ls, x))))::int as removed from p"
)
def conv_line_diff(spark, sf_dir):
    """Lines that each turn adds and drops against the turn before."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.lines(F.col("text")).alias("ls"))
    rows = versions.with_previous(rows, ["conv_id"], [F.col("turn")], ["ls"])
    old = F.coalesce("prev_ls", F.array().cast("array<string>"))
    return rows.select("conv_id", "turn", F.size(T.added(F.col("ls"), old)).alias("added"), F.size(T.added(old, F.col("ls"))).alias("removed"))


def _touched(pattern: str) -> str:
    return f"len(list_filter(touched, lambda x: regexp_matches(x, '{pattern}')))"


@query(
    f"with l as (select conv_id, turn, {LINES} as ls from conversations), p as (select *, coalesce(lag(ls) over (partition by conv_id order by turn), []) as prev from l), "
    "d as (select conv_id, turn, list_concat(list_distinct(list_filter(ls, lambda x: not list_contains(prev, x))), list_distinct(list_filter(prev, lambda x: not list_contains(ls, x)))) as touched from p where turn > 0) "
    f"select conv_id, turn, case when {_touched(T.PRICING)} >= 2 or len(touched) >= 12 then 'high' when {_touched(T.CTA)} > 0 or {_touched(T.LAUNCH)} > 0 or {_touched(T.FEATURE)} >= 2 then 'medium' else 'low' end as severity from d"
)
def conv_diff_severity(spark, sf_dir):
    """How much the change from turn to turn matters, by what the touched lines speak of."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.lines(F.col("text")).alias("ls"))
    rows = versions.with_previous(rows, ["conv_id"], [F.col("turn")], ["ls"]).filter("turn > 0")
    old = F.coalesce("prev_ls", F.array().cast("array<string>"))
    touched = F.concat(T.added(F.col("ls"), old), T.added(old, F.col("ls")))
    return rows.select("conv_id", "turn", touched.alias("_t")).select("conv_id", "turn", T.line_severity(F.col("_t"), F.lit("homepage")).alias("severity"))


@query(
    "with h as (select conv_id, turn, role, sha256(coalesce(text, '')) as hash from conversations), p as (select *, lag(hash) over (partition by conv_id, role order by turn) as prev from h) "
    "select role, count(*) as versions, count(*) filter (where prev is not null and prev = hash) as unchanged, count(*) filter (where prev is null) as first_versions from p group by 1"
)
def conv_change_flags(spark, sf_dir):
    """Versions of a role's text that equal the one before."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    rows = versions.with_previous(rows, ["conv_id", "role"], [F.col("turn")], ["hash"])
    return rows.groupBy("role").agg(F.count("*").alias("versions"), F.count_if(F.col("hash") == F.col("prev_hash")).alias("unchanged"), F.count_if("is_first").alias("first_versions"))


@query(
    "with p as (select l.quality, (d.n_chars >= 800)::int as predicted from labels l join documents d using (doc_id)), "
    "c as (select sum((predicted = 1 and quality = 1)::int)::double as tp, sum((predicted = 1 and quality = 0)::int)::double as fp, sum((predicted = 0 and quality = 1)::int)::double as fn, count(*) as cases from p) "
    "select cases, round(tp / (tp + fp), 3) as precision_score, round(tp / (tp + fn), 3) as recall_score, round(2 * tp / (2 * tp + fp + fn), 3) as f1 from c"
)
def eval_precision_recall(spark, sf_dir):
    """Scorecard of a rule on text length against the quality labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 800).alias("predicted"))
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").select("predicted", (F.col("quality") == 1).alias("expected"))
    return evaluate.scorecard(rows, "predicted", "expected")


@query(
    "with c as (select d.source, count(*) as cases, count(*) filter (where l.quality = 1) as passed from labels l join documents d using (doc_id) group by 1) "
    "select source, cases, passed, case when cases >= 10 then passed >= ceil(cases * 0.8) else passed = cases end as ships from c"
)
def eval_ship_gate(spark, sf_dir):
    """Sources that would pass: four in five cases from ten cases on, all below that."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    rows = rows.groupBy("source").agg(F.count("*").alias("cases"), F.count_if(F.col("quality") == 1).alias("passed"))
    return rows.select("*", evaluate.ships(F.col("cases"), F.col("passed")).alias("ships"))
