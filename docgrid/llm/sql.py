"""The same results in SQL, where SQL can express them."""

EXACT = r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
), g as (select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256
from t join g on t.norm = g.norm
"""

URLS = r"""
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages
), s as (
  select page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') as path
  from u
), r as (
  select page_id, host, path, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/'
  end as rule from s
)
select page_id, host, path, rule, case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict from r
"""

NEGATIVES = """
with v as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where label is not null and embedding is not null and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), true)
), a as (select * from v where vec_id % 100 = 0), p as (
  select a.r, a.vec_id as anchor_id, a.label, a.e, b.vec_id as positive_id, b.r as b, list_inner_product(a.e, b.e)::bigint as positive_score
  from a join v b on a.label = b.label and a.r <> b.r
  qualify row_number() over (partition by a.r order by list_inner_product(a.e, b.e) desc, b.vec_id nulls last) <= 5
), s as (
  select a.r, a.label, b.label as other, b.vec_id as negative_id, list_inner_product(a.e, b.e)::bigint as negative_score from a join v b on a.label <> b.label
)
select anchor_id, positive_id, row_number() over w as rank, negative_id, positive_score, negative_score
from p join s on p.r = s.r and 80 * positive_score <= 100 * negative_score and 100 * negative_score <= 100 * positive_score
window w as (partition by p.r, p.b order by negative_score desc, negative_id nulls last)
qualify row_number() over w <= 5
"""

# the fold goes from a conversation's last row to its first; v holds, for each of the states start, system, user, assistant,
# the least (cost, edits) of what is still to come, with the turns that come of it
CONVERSATIONS = r"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, x: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)) as t
), keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations
), hashed as (
  select *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::bigint)), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)), 4294967295) % 20 as h
  from keyed, crc
), damaged as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role, case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from hashed, range(2) c(c) where h <> 0 and (c = 0 or h = 3)
), numbered as (
  select *, row_number() over (partition by conv_id, role, text order by n) as again
  from (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n from damaged)
), faulty as (
  select conv_id, turn, n, role, text, substr(role, 1, 1) as i, case
    when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when again > 1 then 'd' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 't' else 'n' end as f
  from numbered
), convs as (
  select conv_id, list({i: i, f: f, r: role, x: text} order by n) as rows, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (f = 'b') as blank, count(*) filter (f = 'd') as duplicate, count(*) filter (f = 't') as truncated
  from faulty group by conv_id
), illegal as (
  select conv_id, count(*) filter (p is not null and p || i not in ('su', 'ua', 'au')) as illegal
  from (select conv_id, i, lag(i) over (partition by conv_id order by n) as p from faulty) group by conv_id
), fold as (
  select conv_id, n, rows, [{c: 0, a: '', t: []::varchar[]}, {c: 4, a: 'II', t: ['user:', 'assistant:']}, {c: 2, a: 'I', t: ['assistant:']}, {c: 0, a: '', t: []::varchar[]}] as v from convs
  union all
  select conv_id, n - 1, rows, [
    list_sort([b[1], {c: b[3].c + 2, a: 'I' || b[3].a, t: list_prepend('user:', b[3].t)}, {c: b[4].c + 4, a: 'II' || b[4].a, t: list_prepend('user:', list_prepend('assistant:', b[4].t))}])[1],
    list_sort([b[2], {c: b[3].c + 2, a: 'I' || b[3].a, t: list_prepend('user:', b[3].t)}, {c: b[4].c + 4, a: 'II' || b[4].a, t: list_prepend('user:', list_prepend('assistant:', b[4].t))}])[1],
    list_sort([b[3], {c: b[4].c + 2, a: 'I' || b[4].a, t: list_prepend('assistant:', b[4].t)}])[1],
    list_sort([b[4], {c: b[3].c + 2, a: 'I' || b[3].a, t: list_prepend('user:', b[3].t)}])[1]]
  from (
    select conv_id, n, rows, list_transform([1, 2, 3, 4], lambda s: list_sort(list_filter([
      {c: v[s].c + 3, a: 'D' || v[s].a, t: v[s].t},
      case when q.f in ('n', 't') and (q.i = 'u' and s <> 3 or q.i = 's' and s = 1 or q.i = 'a' and s = 3) then
        {c: v[case q.i when 's' then 2 when 'u' then 3 else 4 end].c + (q.f = 't')::int, a: 'K' || v[case q.i when 's' then 2 when 'u' then 3 else 4 end].a, t: list_prepend(q.r || ':' || q.x, v[case q.i when 's' then 2 when 'u' then 3 else 4 end].t)} end,
      case when q.f in ('n', 't') then
        {c: v[case s when 3 then 4 else 3 end].c + 2 + (q.f = 't')::int, a: 'R' || v[case s when 3 then 4 else 3 end].a, t: list_prepend(case s when 3 then 'assistant:' else 'user:' end || q.x, v[case s when 3 then 4 else 3 end].t)} end
    ], lambda o: o is not null))[1]) as b
    from (select *, rows[n] as q from fold where n > 0)
  )
)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(v[1].c, 0) as cost, coalesce(v[1].a, '') as audit, sha256(coalesce(array_to_string(v[1].t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) e left join convs c on c.conv_id is not distinct from e.conv_id
left join illegal i on i.conv_id is not distinct from e.conv_id left join (select * from fold where n = 0) f on f.conv_id is not distinct from e.conv_id
"""

SQL = {"op3_exact_dedup": EXACT, "op7_url_filter": URLS, "op12_hard_negatives": NEGATIVES, "op13_conversations": CONVERSATIONS}
