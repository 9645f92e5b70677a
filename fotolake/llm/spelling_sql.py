"""The SQL twin of operator 12: near words meet by the strings that are left when one letter goes."""

from __future__ import annotations

from .repair_sql import crc32_sql

_BYTES = "flatten(list_transform(string_split(id || ':' || run, ''), lambda x: case when ord(x) < 128 then [ord(x)::bigint] else [(192 + (ord(x) >> 6))::bigint, (128 + (ord(x) & 63))::bigint] end))"

OP12_SQL = rf"""
with recursive runs as (
  select coalesce(doc_id::varchar, '') as id,
    translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents),
hashed as (select run, {crc32_sql(_BYTES)} as h from runs),
words as (
  select case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, count(*) as n
  from hashed group by 1 having length(word) >= 5 and n >= 3),
gaps as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
pairs as (
  select a.word, b.word as other, b.n as other_n from gaps a join gaps b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from gaps a join words b on a.rest = b.word
  union select b.word, a.word, a.n from gaps a join words b on a.rest = b.word),
best as (
  select word, count(*) as n_near, max(other_n) as top from pairs group by word),
forms as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when top >= 2 * w.n then top end as form_n,
    case when top >= 2 * w.n then (select min(other) from pairs p where p.word = w.word and p.other_n = top) end as form
  from words w left join best using (word)),
ways as (
  select word, word as root, 0 as step from forms
  union all select ways.word, form, step + 1 from ways join forms on forms.word = root where form is not null)
select f.word, f.form, (select arg_max(root, step) from ways where ways.word = f.word) as root, f.n, f.n_near, f.form_n from forms f
"""
