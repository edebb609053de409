"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from nearfield.llm import line_dedup


def _op7() -> str:
    page = "coalesce(html, '')"
    for pattern in line_dedup.REMOVED:
        page = f"regexp_replace({page}, '{pattern}', ' ', 'g')"
    page = f"regexp_replace({page}, '{line_dedup.BREAKS}', chr(10), 'g')"
    page = f"regexp_replace({page}, '{line_dedup.TAGS}', '', 'g')"
    for name, value in line_dedup.ENTITIES:
        page = f"replace({page}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
    page = f"regexp_replace({page}, '{line_dedup.SPACES}', ' ', 'g')"
    return f"""
with rows as (
  select page_id, lower(regexp_extract(coalesce(url, ''), '{line_dedup.HOST}', 1)) as host,
    list_filter(list_transform(string_split({page}, chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines
  from pages),
counts as (select host, line, count(*) as n from (select host, unnest(list_distinct(lines)) as line from rows) group by host, line),
totals as (select host, count(*) as total from rows group by host),
dropped as (
  select host, list(line) as lines from counts join totals using (host)
  where n >= {line_dedup.MIN_PAGES} and n > {line_dedup.MAX_RATIO} * total group by host),
kept as (
  select page_id, r.host, len(r.lines) as n_lines, list_filter(r.lines, lambda x: not list_contains(coalesce(d.lines, []), x)) as kept
  from rows r left join dropped d on r.host = d.host)
select page_id, host, n_lines::bigint as n_lines, (n_lines - len(kept))::bigint as n_dropped, coalesce(array_to_string(kept, chr(10)), '') as text from kept
"""


#: Targets by sharing again and again until none is above its cap; the schedule by the points of each source's share.
_OP8 = """
with recursive rows as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source is null, encode(source)) - 1 as rnk from rows group by source),
weighed as (
  select *, case rnk % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as weight, 2.0::double * source_size as cap, (1.5::double * (select sum(source_size) from sources))::double as whole from sources),
fill as (
  select rnk, weight, cap, whole, false as full_now, -1.0::double as level, 0 as step from weighed
  union all
  select rnk, weight, cap, whole, full_now or weight * lv > cap, lv, step + 1 from (
    select *, (whole - coalesce(sum(cap) filter (full_now) over (), 0)) / (sum(weight) filter (not full_now) over ()) as lv from fill) as x where lv is not null and lv <> level),
goal as (
  select s.source, s.rnk, s.source_size, case when f.full_now then f.cap else f.weight * f.level end as target
  from weighed s join fill f using (rnk) where f.step = (select max(step) from fill)),
blocks as (select rnk, ceil(target / 4096)::bigint as n from goal where target > 0),
shares as (select rnk, n, (sum(n) over (order by rnk) - n)::hugeint as low, (sum(n) over (order by rnk))::hugeint as high, (sum(n) over ())::hugeint as total from blocks),
bits as (select greatest(1, ceil(log2(max(total)))::int) as b from shares),
points as (select rnk, n, b, unnest(range(((low * (1::hugeint << b) + total - 1) // total)::bigint, ((high * (1::hugeint << b) + total - 1) // total)::bigint)) as k from shares, bits),
slots as (select rnk, n, list_sum(list_transform(range(0, b), lambda i: ((k >> i) & 1) << (b - 1 - i)))::bigint as slot from points),
ranked as (select rnk, slot, row_number() over (partition by rnk order by slot) - 1 as place from slots qualify place < n),
placed as (
  select r.*, g.rnk, g.source_size, g.target,
    coalesce(sum(size) over (partition by g.rnk order by md5(coalesce(doc_id::varchar, '')), doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from rows r join goal g on r.source is not distinct from g.source),
cut as (
  select doc_id, rnk, start, start + source_size * k as low, least(start + source_size * k + size, floor(target)::bigint) as high
  from placed, (values (0), (1)) as e(k) where size > 0 and start + source_size * k < target),
taken as (
  select c.rnk, c.start, sum(greatest(0, least(high, (place + 1) * 4096) - greatest(low, place * 4096)))::bigint as taken, min(slot) as first_slot
  from cut c join ranked s on c.rnk = s.rnk and s.place between c.low // 4096 and greatest(c.low // 4096, (c.high - 1) // 4096)
  group by c.rnk, c.start)
select p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0)::bigint as taken, coalesce(t.first_slot, -1)::bigint as first_slot
from placed p left join taken t on p.size > 0 and p.rnk = t.rnk and p.start = t.start
"""


_OP9 = """
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(lower_ascii, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from documents)),
sets as (
  select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as k from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (
  select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * k >= 85 * (a.n + b.n - k)),
arcs as (select x, y from links union select y, x from links),
reach as (select x as node, x as root from (select distinct x from arcs) union select arcs.y, reach.root from reach join arcs on arcs.x = reach.node),
least_id as (select node, min(root) as component_id from reach group by node)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, coalesce(l.component_id, d.doc_id)::bigint as component_id, coalesce(l.component_id, d.doc_id) = d.doc_id as kept
from documents d left join sizes s on s.doc_id = d.doc_id left join least_id l on l.node = d.doc_id
"""


_OP11 = r"""
with lines as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as w, sha256('7:' || coalesce(doc_id::varchar, '')) as d from documents),
drawn as (
  select doc_id, t, w, len(w) as n, ('0x' || d[1:8])::bigint as h1, ('0x' || d[9:16])::bigint as h2, ('0x' || d[17:24])::bigint as h3, ('0x' || d[25:32])::bigint as h4 from lines),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from drawn),
parts as (
  select doc_id, t, n, form, array_to_string(w[1:low], '') as a, array_to_string(w[low + 1:high], '') as b, array_to_string(w[high + 1:], '') as c from cut)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(a) end::bigint as prefix_chars, case when form <> 'plain' then length(b) end::bigint as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || c || '<M>' || b else '<S>' || c || '<P>' || a || '<M>' || b end) as output_sha256, sha256(t) as restored_sha256
from parts
"""


_OP12 = r"""
with docs as (select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n_chars from documents),
pairs as (
  select *, coalesce(lead(t) over w, first_value(t) over (order by doc_id nulls first)) as follower from docs window w as (order by doc_id nulls first)),
cut as (select *, t[1:n_chars - n_chars // 2] || follower[1:n_chars // 2] as edited from pairs),
texts as (select t from cut union select edited from cut union select follower from cut),
words as (select t, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from texts),
sketches as (
  select t, case when len(w) = 0 then []::varchar[] else list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: md5(array_to_string(w[i:i + 4], ' '))[1:16])))[1:128] end as s from words),
rows as (
  select c.*, a.s as own, b.s as changed, n.s as next from cut c join sketches a on a.t = c.t join sketches b on b.t = c.edited join sketches n on n.t = c.follower),
unions as (
  select *, list_sort(list_distinct(list_concat(own, changed)))[1:128] as u, list_sort(list_distinct(list_concat(own, next)))[1:128] as v,
    len(list_filter(own, lambda x: len(changed) < 128 or x <= changed[-1])) as reach from rows)
select doc_id, n_chars, sha256(edited) as edited_sha256, coalesce(array_to_string(own, ''), '') as fingerprint, coalesce(array_to_string(changed, ''), '') as edited_fingerprint,
  case when len(u) = 0 then 1.0 else len(list_filter(u, lambda x: list_contains(own, x) and list_contains(changed, x)))::double / len(u) end::double as near_edited,
  case when len(v) = 0 then 1.0 else len(list_filter(v, lambda x: list_contains(own, x) and list_contains(next, x)))::double / len(v) end::double as near_next,
  case when len(own) = 0 then 1.0 when len(changed) = 0 or reach = 0 then 0.0 else len(list_filter(own, lambda x: list_contains(changed, x)))::double / reach end::double as held_by_edited,
  case when len(own) < 128 then len(own)::double else 127.0::double / (('0x' || own[-1][1:13])::bigint::double / 4503599627370496.0::double) end::double as shingles
from unions
"""


_OP13 = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
words as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
grams as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from words, (values (1), (2), (3)) as widths(k)),
freq as (select lang, k, phrase, count(*)::hugeint as f from grams group by all),
totals as (select lang, sum(f)::bigint as n from freq where k = 1 group by lang),
cand as (select lang, k, phrase, f, string_split(phrase, ' ') as w from freq where k > 1 and f >= 10),
sides as materialized (
  select lang, phrase, k, f, cut, lang || chr(10) || array_to_string(w[1:cut], ' ') as lkey, lang || chr(10) || array_to_string(w[cut + 1:], ' ') as rkey
  from cand, (values (1), (2)) as p(cut) where cut < k),
known as materialized (select lang || chr(10) || phrase as fkey, f from freq),
lefts as materialized (select s.*, n.f as l from sides s join known n on n.fkey = s.lkey),
cuts as materialized (select s.*, n.f as r, (1000000::hugeint * s.f * s.f) // (s.l * n.f) as score from lefts s join known n on n.fkey = s.rkey),
worst as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inner_parts as (
  select lang, f as longer, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase from cand where k = 3),
held as (
  select distinct i.lang, i.phrase from cand i join inner_parts p on p.lang = i.lang and p.phrase = i.phrase where i.k = 2 and 100 * p.longer >= 50 * i.f),
ranked as (
  select lang, row_number() over (partition by lang order by score desc, f desc, phrase)::bigint as rank, phrase, f::bigint as a, l::bigint as l, r::bigint as r, score::bigint as score
  from worst anti join held using (lang, phrase))
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": _op7(), "op8_source_mix": _OP8, "op9_near_duplicates": _OP9, "op11_fill_in_middle": _OP11, "op12_fingerprints": _OP12, "op13_collocations": _OP13}
