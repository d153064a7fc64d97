"""DuckDB SQL for the corpus operators that SQL can express.

The others rest on trained models, tokenizers or random seeds; their tests compare with brute force.
"""

WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

_LINES = f"""
with lines as (
  select doc_id, line - 1 as line, {WORDS.format("lower(body)")} as w
  from (select doc_id, unnest(string_split(text, chr(10))) as body, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from documents)
), worded as (select *, doc_id * 1000000 + line as place from lines where len(w) > 0
), firsts as (select w, len(w) as n, min(place) as place from worded group by w
), variants as (select w, place, i, list_concat(w[1:i - 1], w[i + 1:]) as v from (select *, unnest(range(1, n + 1)) as i from firsts where n >= 5)
), earliest as (select i, v, min(place) as e from variants group by i, v
), near as (
  select x.w from variants x join earliest e using (i, v) where e.e < x.place
  union select case when f.place < x.place then x.w else f.w end from variants x join firsts f on f.w = x.v and f.n >= 5
), judged as (
  select l.doc_id, l.line, case when near.w is not null then true when l.place <> f.place then false end as near
  from worded l join firsts f on f.w = l.w left join near on near.w = l.w
)
select doc_id, count(*) as n_lines, count(*) filter (not near) as n_equal, count(*) filter (near) as n_near, cast(coalesce(sum(line + 1) filter (near is not null), 0) as bigint) as gone_sum
from judged group by doc_id
"""

_NEAR = f"""
with recursive docs as (select doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents
), shingles as (select distinct doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as g from docs
), sizes as (select doc_id, count(*) as n from shingles group by doc_id
), shared as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by all
), links as (select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)
), both_ways as (select x, y from links union select y, x from links
), reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, b.y from reach r join both_ways b on b.x = r.other
), least_ids as (select doc_id, min(other) as component_id from reach group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from least_ids left join sizes using (doc_id)
"""

_MIX = f"""
with sized as (select doc_id, source, len({WORDS.format("coalesce(text, '')")}) as size, md5(coalesce(cast(doc_id as varchar), 'null ' || md5(coalesce(text, '')))) as digest from documents
), ranked as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as rank from sized group by source
), weighed as (select *, rank % 3 + 1 as weight, source_size * 3 as cap from ranked
), steps as (
  select *, sum(source_size) over () as total, coalesce(sum(cap) over before_it, 0) as capped, sum(weight) over () - coalesce(sum(weight) over before_it, 0) as open_weight
  from weighed window before_it as (order by cap / weight, rank rows between unbounded preceding and 1 preceding)
), level as (select cast(total - capped as double) / cast(open_weight as double) as lv from steps where cast(total - capped as double) / cast(open_weight as double) <= cap / weight order by capped, 1 limit 1
), targets as (select source, source_size, rank, least(cast(cap as double), (select lv from level) * weight) as target from weighed
), sloped as (select *, 0.5 * (1 - 2 * cast(rank as double) / greatest(max(rank) over (), 1)) as raw from targets
), slopes as (select *, raw - coalesce(sum(raw * target) over () / nullif(sum(target) over (), 0), 0) as a from sloped
), placed as (
  select doc_id, size, source_size, target, a, coalesce(sum(size) over (partition by s.source order by digest, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before_it, floor(coalesce(target / nullif(source_size, 0), 0)) as passes
  from sized s join slopes t on s.source is not distinct from t.source
), taken as (select *, cast(least(passes + case when before_it + size / 2 <= target - passes * source_size then 1 else 0 end, 3) as bigint) as takes from placed
), reached as (select *, least(coalesce((before_it + size / 2) / nullif(target, 0), 0), 1) as y0, least(coalesce(((takes - 1) * source_size + before_it + size / 2) / nullif(target, 0), 0), 1) as y1 from taken
)
select doc_id, cast(size as bigint) as size, source_size, target, cast(size * takes as bigint) as taken,
  case when takes > 0 then round(2 * y0 / (1 + a + sqrt(greatest((1 + a) * (1 + a) - 4 * a * y0, 0))), 6) end as first_position,
  case when takes > 0 then round(2 * y1 / (1 + a + sqrt(greatest((1 + a) * (1 + a) - 4 * a * y1, 0))), 6) end as last_position
from reached
"""


#: crc32 of a column of ASCII texts, from a one-row table ``crc`` of 256 remainders.
_CRC = """crc as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as tab from range(256) as t(i))"""
_CRC_OF = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"

_REPAIR = f"""
with recursive {_CRC}, hits as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_CRC_OF.format("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as hit from conversations, crc
), damaged as (
  select conv_id, turn, case when hit = 4 then 'user' else role end as role, case hit when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when hit = 3 then [0, 1] else [0] end) as copy from hits where hit <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, md5(length(role) || ':' || role || text), copy) as i from damaged
), judged as (
  select *, trim(text, ' \t\n\x0b\x0c\r') as body, row_number() over (partition by conv_id, role, text order by i) > 1 as again, lag(role) over (partition by conv_id order by i) as before from placed
), flags as (
  select *, substr(role, 1, 1) as letter, body = '' as blank, body <> '' and again as duplicate, body <> '' and not again and right(body, 1) not in ('.', '!', '?') as truncated from judged
), facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(blank) as blank, count_if(duplicate) as duplicate, count_if(truncated) as truncated,
    count_if(before is not null and substr(before, 1, 1) || letter not in ('su', 'ua', 'au')) as illegal, max(i) as n from flags group by conv_id
), steps as (  -- state: 0 nothing yet, 1 behind a system, 2 user, 3 assistant row; inserts of up to two rows
  select * from (values (0, 0, '', 0), (0, 2, 'I', 3), (0, 3, 'II', 6), (1, 1, '', 0), (1, 2, 'I', 3), (1, 3, 'II', 6), (2, 2, '', 0), (2, 3, 'I', 3), (3, 3, '', 0), (3, 2, 'I', 3)) as t(a, b, ins, paid)
), reached as (
  select conv_id, 0::bigint as i, b as state, paid as cost, ins as audit from facts, steps where a = 0
  union all
  select conv_id, i, state, b.c as cost, b.a as audit from (
    select r.conv_id, r.i + 1 as i, s.b as state, min({{'c': r.cost + e.paid + s.paid, 'a': r.audit || e.edit || s.ins}}) as b
    from reached r join flags f on f.conv_id is not distinct from r.conv_id and f.i = r.i + 1, lateral (
      select r.state as "to", 4 as paid, 'D' as edit
      union all select case letter when 's' then 1 when 'u' then 2 else 3 end, case when truncated then 3 else 0 end, 'K' where not blank and not duplicate and ((r.state = 0 and letter in ('s', 'u')) or (r.state in (1, 3) and letter = 'u') or (r.state = 2 and letter = 'a'))
      union all select case when r.state = 2 then 3 else 2 end, case when truncated then 6 else 3 end, 'R' where not blank and not duplicate
    ) e join steps s on s.a = e."to" group by r.conv_id, r.i, s.b
  )
), best as (
  select f.conv_id, min({{'c': r.cost, 'a': r.audit}}) as b from facts f join reached r on r.conv_id is not distinct from f.conv_id and r.i = f.n where r.state in (0, 3) group by f.conv_id
), solved as (select conv_id, b.c::bigint as cost, b.a as audit from best
), edits as (
  select conv_id, k, substr(audit, k, 1) as edit, count(*) filter (substr(audit, k, 1) <> 'I') over (partition by conv_id order by k) as i from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as k from solved)
), kept as (
  select e.conv_id, e.k, e.edit, f.role, case when e.edit = 'I' then '' else f.text end as text, row_number() over (partition by e.conv_id order by e.k) as place,
    max(case when e.edit = 'K' and f.letter = 's' then 1 else 0 end) over (partition by e.conv_id) as led
  from edits e left join flags f on f.conv_id is not distinct from e.conv_id and f.i = e.i where e.edit <> 'D'
), lines as (
  select conv_id, sha256(string_agg(case when edit = 'K' then role when (place - led) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by place)) as sha from kept group by conv_id
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c left join facts f on f.conv_id is not distinct from c.conv_id left join solved s on s.conv_id is not distinct from c.conv_id left join lines l on l.conv_id is not distinct from c.conv_id
"""

ORACLES: dict[str, str] = {"op4_line_dedup": _LINES, "op8_minhash": _NEAR, "op10_mixing": _MIX, "op13_conversation_repair": _REPAIR}
