"""DuckDB SQL for the queries that SQL can express."""

OP2_SQL = r"""
with recursive docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) end)) as s from docs),
nodes as (select s, len(s) as n, min(doc_id) as node from sets where len(s) > 0 group by s),
each as (select node, n, unnest(s) as h from nodes),
pairs as (select a.node as a, b.node as b from each a join each b on a.h = b.h and a.node < b.node and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.node, b.node, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways as (select a, b from pairs union all select b, a from pairs),
reach(node, far) as (select node, node from nodes union select r.node, e.b from reach r join both_ways e on r.far = e.a),
comp as (select node, min(far) as component_id from reach group by node)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(c.component_id, s.doc_id) as component_id, s.doc_id = coalesce(c.component_id, s.doc_id) as kept
from sets s left join nodes n on s.s = n.s left join comp c on n.node = c.node"""

OP7_SQL = r"""
with docs as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text, source as host from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from docs),
lines as (select rid, unnest(string_split(text, chr(10))) as l from docs),
dup as (select rid, count(*) - count(distinct l) as n from lines where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid),
win as (select rid, unnest(range(1, greatest(len(ws) - 1, 1))) as i, unnest(list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) as g from w),
again as (select rid, i from win qualify count(*) over (partition by rid, g) > 1),
cover as (select rid, sum(least(3, i - prev)) as n from (select rid, i, lag(i, 1, -5) over (partition by rid order by i) as prev from again) group by rid),
norm as (select rid, host, text, trim(l, ' ') as l from (select rid, host, text, unnest(string_split(lower(regexp_replace(regexp_replace(text, '[0-9]+', '0', 'g'), '[ \t\x0B\f\r]+', ' ', 'g')), chr(10))) as l from docs) where trim(l, ' ') <> ''),
hosts as (select host, count(distinct text) as n from docs group by host),
hot as (select n.host, n.l from norm n join hosts h on n.host is not distinct from h.host group by n.host, n.l, h.n having count(distinct n.text) > 20 and count(distinct n.text) * 100 > h.n * 2),
gone as (select n.rid, sum(len(n.l) - len(replace(n.l, ' ', '')) + 1) as n from norm n join hot h on n.l = h.l and n.host is not distinct from h.host group by n.rid),
base as (
  select w.doc_id, len(ws)::bigint as n_words, len(array_to_string(ws, ''))::bigint as word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(cover.n, 0)::bigint as n_repeat_words, coalesce(gone.n, 0)::bigint as n_removed_words
  from w left join dup using (rid) left join cover using (rid) left join gone using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, n_removed_words,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * n_removed_words <= 50 * n_words as kept
from base"""

OP12_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
each as (select lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') as w from pieces),
total as (select lang, sum(len(w))::bigint as n from each group by lang),
grams as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as g from each, unnest([1, 2, 3, 4]) as s(k) where len(w) >= k),
f as (select lang, k as size, g, count(*)::bigint as f from grams group by all having count(*) >= 30),
cands as (select lang, size, g, f as a, string_split(g, ' ') as w from f where size > 1),
cuts as (select lang, g, a, w, size, unnest(range(1, size)) as k from cands),
scored as (
  select c.lang, c.g, c.a, c.k, x.f as l, y.f as r, (2000000::hugeint * c.a // (x.f + y.f))::bigint as score
  from cuts c join f x on x.lang = c.lang and x.g = array_to_string(c.w[1:c.k], ' ') join f y on y.lang = c.lang and y.g = array_to_string(c.w[c.k + 1:c.size], ' ')),
best as (select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1),
within as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as g, max(a) as more
  from (select lang, a, w, size, m, unnest(range(1, size - m + 2)) as i from (select *, unnest(range(2, size)) as m from cands)) group by all),
kept as (select b.* from best b left join within x on x.lang = b.lang and x.g = b.g where x.more is null or 100::hugeint * x.more < 80::hugeint * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(g)) as rank from kept qualify rank <= 2000)
select r.lang, r.rank, r.g as phrase, r.a, r.l, r.r, t.n, r.score from ranked r join total t on t.lang = r.lang"""
