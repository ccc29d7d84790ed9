"""DuckDB SQL for the queries that SQL expresses over whole tables."""

from tidepool.llm import personal

#: The kinds' patterns without what only saves work (anchors, possessive loops), which the engine of the SQL hasn't.
PATTERNS = {k: p.removeprefix(r"(?:\G|(?<![A-Za-z0-9._%+-]))").removeprefix("(?<![0-9])").replace("++", "+") for k, p in personal.PROPOSED.items()}


def personal_sql() -> str:
    """SQL of op12_personal: matches and the pieces between them give the places, as in the query itself."""
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda j: (case when j % 2 = 1 then ord({digits}[-j]) - 48 else ((ord({digits}[-j]) - 48) * 2) % 10 + ((ord({digits}[-j]) - 48) * 2) // 10 end))) % 10 = 0"
    code = "replace(v, ' ', '')"
    moved = f"({code}[5:] || {code}[:4])"
    mod = f"list_reduce(list_prepend(0, list_transform(range(1, length({moved}) + 1), lambda j: ord({moved}[j])::bigint)), lambda r, x: case when x < 58 then (r * 10 + x - 48) % 97 else (r * 100 + x - 55) % 97 end) = 1"
    checks = {
        "email": "true", "ip": "list_max(list_transform(string_split(v, '.'), lambda y: cast(y as hugeint))) <= 255",
        "card": f"length({digits}) between 12 and 19 and {luhn}", "phone": f"length({digits}) between 9 and 15", "iban": mod, "ssn": "regexp_full_match(v, '[0-9]{3}-[0-9]{2}-[0-9]{4}')",
    }
    said = lambda words: f"case when regexp_matches(near, '(?:^|[^a-z0-9])(?:{words})(?:[^a-z0-9]|$)') then {personal.STEP} else 0.0 end"
    kinds = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        kinds.append(f"""
select k, {rank} as rank, '{kind}' as kind, s, s + length(v) as e, {personal.SCORES[kind]} + {said(personal.RAISING[kind])} - {said(personal.LOWERING[kind])} as score
from (select k, m[i] as v, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint as s,
    lower(right(p[i], {personal.CONTEXT}) || chr(10) || left(p[i + 1], {personal.CONTEXT})) as near
  from (select k, m, p, unnest(range(1, len(m) + 1)) as i from (
    select k, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as p from d)))
where {checks[kind]}""")
    joined = lambda fields, only="true": f"coalesce(string_agg({fields}, ',' order by s, rank) filter ({only}), '')"
    place = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) filter (rank = {i})::bigint as n_{k}" for i, k in enumerate(personal.BASE))
    return f"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents),
found as (select * from ({" union all ".join(kinds)}) where rank < {len(personal.BASE)} or score >= {personal.REPORTED})
select any_value(doc_id) as doc_id, {counts}, sha256({joined(place, f"rank < {len(personal.BASE)}")}) as base_sha256,
  {joined(place, "rank is not null")} as spans, {joined(place + " || printf(':%.2f', score)", "rank is not null")} as scored
from d left join found using (k) group by k"""


ORACLES = {
    "op3_warc": r"""
with d as (
  select page_id, strlen(coalesce(html, ''))::bigint as n, sha256(coalesce(html, '')) as sha from pages),
m as (select *, min(page_id) over (partition by sha) as first from d)
select page_id, n as payload_bytes, sha as payload_digest,
  case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> first then first end as refers_to, true as verified
from m""",
    "op7_source_mixing": r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5('1:' || coalesce(doc_id::varchar, '')) as k
  from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w, 2.0::double * source_size as cap
  from totals),
levels as (
  select *, cap / w as ratio,
    (1.5::double * sum(source_size) over () - coalesce(sum(cap) over below, 0)) / (sum(w) over () - coalesce(sum(w) over below, 0)) as level
  from weighed window below as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
level as (select level as l from levels where level <= ratio order by ratio, source nulls last limit 1),
targets as (select source, source_size, least(cap, l * w)::double as target, floor(least(cap, l * w) + 0.5)::bigint as goal from levels, level),
placed as (
  select s.*, t.source_size, t.target, t.goal, coalesce(sum(size) over (partition by s.source order by k, doc_id nulls last, size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
  case when source_size = 0 then 0 else (goal // source_size) * size + least(size, greatest(0, goal % source_size - before)) end::bigint as taken
from placed""",
    "op8_exact_dedup": r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t
  from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size,
  row_number() over w = 1 as kept, sha256(t) as text_sha256
from d window w as (partition by t order by n desc, doc_id nulls last)""",
    "op12_personal": personal_sql(),
    "op13_prefix_trie": r"""
with recursive own as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as r,
    length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') as what, strlen(coalesce(text, ''))::bigint as b
  from conversations where conv_id is not null),
convs as (
  select c, count(*) as n, c - c % 5 as base,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(c::varchar) + 1), lambda i: ord(substr(c::varchar, i, 1))::bigint)),
      lambda a, x: list_reduce(list_prepend(xor(a, x), [1, 2, 3, 4, 5, 6, 7, 8]), lambda u, k: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295) % 9 as h
  from own group by c),
path as (
  select k.c, o.r as d, o.what, o.b from convs k join own o on o.c = k.base and o.r <= k.h
  union all
  select k.c, o.r - k.h + least(k.h, coalesce(m.n, 0)), o.what, o.b from convs k left join convs m on m.c = k.base join own o on o.c = k.c and o.r > k.h),
pre as (
  select c, 0::bigint as d, 'root' as node, 0::bigint as b from convs
  union all
  select p.c, p.d::bigint, sha256(coalesce(x.node, '') || p.what), p.b from path p join pre x on x.c = p.c and p.d = x.d + 1),
nodes as (select d, node, min(c) as owner, count(*) as n, max(b) as b from pre group by d, node),
last as (select c, max(d) as d from pre group by c),
ends as (select p.d, p.node, sha256(string_agg(p.c::varchar, ',' order by p.c)) as sha from pre p join last l on l.c = p.c and l.d = p.d group by p.d, p.node),
up as (select n.d, n.node, x.node as above from nodes n join pre x on x.c = n.owner and x.d = n.d - 1),
kids as (select above as node, d - 1 as d, count(*) as k from up group by above, d),
below as (
  select a.d, a.node, sum(case when k.k is null then 1 else 0 end)::bigint as leaves, sum((n.n - 1) * n.b)::bigint as saved
  from nodes n join pre a on a.c = n.owner and a.d <= n.d left join kids k on k.node = n.node and k.d = n.d group by a.d, a.node)
select n.owner as conv_id, n.d as depth, m.owner as parent_conv_id, n.n::bigint as n_convs, coalesce(k.k, 0)::bigint as n_children,
  t.leaves as n_leaves, t.saved as saved_tokens, coalesce(e.sha, sha256('')) as ends_sha256
from nodes n join below t on t.d = n.d and t.node = n.node left join up u on u.d = n.d and u.node = n.node
left join nodes m on m.node = u.above and m.d = n.d - 1 left join kids k on k.node = n.node and k.d = n.d left join ends e on e.d = n.d and e.node = n.node""",
}
