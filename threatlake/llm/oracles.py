"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_CONTROL = r"\|[A-Za-z0-9_]+\||/?s>|/?INST\]|/?SYS>>|<SYS>>|</SYS>>"
_ESCAPED = rf"[<\[]\\*(?:{_CONTROL})"
_ROLE = r"replace(replace(role, '\', '\\'), chr(10), '\n')"

#: Turns by number, then role and text; every control string inside a text costs one character.
OP7 = f"""with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized as (select *, length({_ROLE}) + len(regexp_extract_all({_ROLE}, '{_ESCAPED}')) + length(text) + len(regexp_extract_all(text, '{_ESCAPED}')) + 24 as chars from rows),
joined as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as whole,
  coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss, sum(chars) as chars from sized group by conv_id)
select conv_id, n_turns, sha256(whole) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, cast(chars as bigint) as formatted_chars from joined"""

#: All pairs that share a shingle, their similarity, and what is reachable over links.
OP10 = r"""with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, chr(31))] else list_distinct([concat_ws(chr(31), w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) for i in range(1, len(w) - 3)]) end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
sets as (select doc_id, n, md5(string_agg(s, chr(30) order by s)) as same from shingles join sizes using (doc_id) group by doc_id, n),
firsts as (select same, n, min(doc_id) as node from sets group by same, n),
entries as (select node, n, s from firsts join shingles on shingles.doc_id = node),
pairs as (select a.node as x, b.node as y from entries a join entries b on a.s = b.s and a.node < b.node and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) group by a.node, b.node, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links as (select x, y from pairs union all select y, x from pairs),
reach as (select node as root, node from firsts union select reach.root, links.y from reach join links on links.x = reach.node),
least_of as (select node, min(root) as component_id from reach group by node)
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id, coalesce(c.component_id, d.doc_id) = d.doc_id as kept
from documents d left join sets s on s.doc_id = d.doc_id left join firsts f on f.same = s.same and f.n = s.n left join least_of c on c.node = f.node"""

#: Every document's failures, and for each order and step what they mean.
OP12 = r"""with words as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
judged as (select doc_id, part, array_concat(
    case when len(w) < 50 then ['A'] else [] end, case when 100 * len(list_distinct(w)) < 65 * len(w) then ['B'] else [] end,
    case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) then ['C'] else [] end, case when regexp_matches(t, '[#$%&*|]') then ['D'] else [] end,
    case when doc_id > min(doc_id) over (partition by t) then ['E'] else [] end) as fails from words),
marked as (select j.*, coalesce(l.good, false) as good, coalesce(l.toxic, false) as toxic from judged j left join (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id) l using (doc_id)),
classes as (select part, fails, count(*) as n, count(*) filter (good) as g, count(*) filter (toxic) as x from marked group by part, fails),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps as (select filter_order, step, filter_order[step] as f, string_split(filter_order[1:step - 1], '') as before from orders, range(1, 6) s(step)),
cells as (select part, filter_order, step, f, sum(case when not list_has_any(before, fails) and not list_contains(fails, f) then n else 0 end) as kept,
    sum(case when not list_has_any(before, fails) and list_contains(fails, f) then n else 0 end) as removed,
    sum(case when list_has_any(before, fails) and list_contains(fails, f) then n else 0 end) as redundant,
    sum(case when fails = [f] then n else 0 end) as unique_fails,
    sum(case when not list_has_any(before, fails) and list_contains(fails, f) then g else 0 end) as good_lost,
    sum(case when not list_has_any(before, fails) and list_contains(fails, f) then x else 0 end) as toxic_lost from classes, steps group by part, filter_order, step, f)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley from cells"""
