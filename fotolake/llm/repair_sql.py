"""The SQL twin of operator 11: a left-to-right pass over each conversation's rows that keeps, for each state of the pattern,
the least cost and audit so far. It shares nothing with the charts but the contract."""

from __future__ import annotations


def crc32_sql(codes: str) -> str:
    """The unsigned crc32 of a list of bytes; its table is built in the query."""
    table = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"
    return f"(select xor(list_reduce(list_concat([4294967295::bigint], {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) from (select {table} as t))"


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _after(state: str, cost: int, edit: str, when: str = "") -> str:
    """The state's pair after an edit of a row; no pair where the condition fails."""
    pair = f"{{'c': {state}.c + {cost} + (case when fault = 'truncated' then 1 else 0 end), 'a': {state}.a || '{edit}'}}"
    usable = "fault is null or fault = 'truncated'" if edit != "D" else "true"
    return f"case when ({usable}){when} then {pair} else {{'c': 1000000000000000::bigint, 'a': ''}} end"


def _gone(state: str) -> str:
    return f"{{'c': {state}.c + 3, 'a': {state}.a || 'D'}}"


def _inserted(state: str) -> str:
    return f"{{'c': {state}.c + 2, 'a': {state}.a || 'I'}}"


_KEEP = {who: f" and initial = '{who}'" for who in "sua"}

OP11_SQL = rf"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
harmed as (select *, {crc32_sql("list_transform(string_split(k, ''), lambda x: ord(x)::bigint)")} % 20 as harm from keyed),
fixed as (
  select coalesce(conv_id::varchar, ' ') as conv, turn, case when harm = 4 then 'user' else role end as role,
    case when harm = 1 then '' when harm = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when harm = 3 then [1, 2] else [1] end) as again
  from harmed where harm <> 0),
placed as (select *, row_number() over (partition by conv order by turn nulls first, role, text) as i from fixed),
judged as (
  select *, left(role, 1) as initial,
    case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
      when row_number() over (partition by conv, role, text order by i) > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' end as fault,
    left(role, 1) || lead(left(role, 1)) over (partition by conv order by i) as pair
  from placed),
steps as (
  select distinct conv, 0::bigint as i, {{'c': 0::bigint, 'a': ''}} as n, {{'c': 1000000000000000::bigint, 'a': ''}} as s,
    {{'c': 2::bigint, 'a': 'I'}} as u, {{'c': 4::bigint, 'a': 'II'}} as a from judged
  union all
  select conv, i, n, s, u, {_least("a", _inserted("u"))} as a
  from (
    select conv, i, n, s, a, {_least("u", _inserted("n"), _inserted("s"), _inserted("a"))} as u
    from (
      select j.conv, j.i, {_gone("n")} as n, {_least(_gone("s"), _after("n", 0, "K", _KEEP["s"]))} as s,
        {_least(_gone("u"), *(_after(p, 0, "K", _KEEP["u"]) for p in "nsa"), *(_after(p, 2, "R") for p in "nsa"))} as u,
        {_least(_gone("a"), _after("u", 0, "K", _KEEP["a"]), _after("u", 2, "R"))} as a
      from steps p join judged j on j.conv = p.conv and j.i = p.i + 1))),
best as (
  select conv, {_least("n", "a")} as b from (select *, row_number() over (partition by conv order by i desc) as last from steps) where last = 1),
edits as (
  select conv, b.a as audit, unnest(string_split(b.a, '')) as edit, generate_subscripts(string_split(b.a, ''), 1) as p from best where b.a <> ''),
walked as (
  select *, count(*) filter (edit <> 'I') over w as i, count(*) filter (edit <> 'D') over w as place,
    count(*) filter (edit <> 'D') over (partition by conv) % 2 as odd
  from edits window w as (partition by conv order by p)),
lines as (
  select w.conv, p, case when edit = 'K' then j.role when (place - 1 - odd) % 2 = 0 then 'user' else 'assistant' end
    || ':' || case when edit = 'I' then '' else j.text end as line
  from walked w left join judged j on j.conv = w.conv and j.i = w.i where edit <> 'D'),
digests as (select conv, sha256(string_agg(line, chr(10) order by p)) as h from lines group by conv),
stats as (
  select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as n_rows
  from judged group by conv)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(b.c, 0)::bigint as cost, coalesce(b.a, '') as audit,
  coalesce(h, sha256('')) as repaired_sha256, coalesce(n_rows, 0) as n_rows
from (select distinct conv_id from conversations) o
left join stats on stats.conv = coalesce(o.conv_id::varchar, ' ') left join best on best.conv = coalesce(o.conv_id::varchar, ' ')
left join digests on digests.conv = coalesce(o.conv_id::varchar, ' ')
"""
