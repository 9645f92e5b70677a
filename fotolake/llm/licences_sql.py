"""The SQL twin of operator 13: the same index as a table of values, looked up and lined up by joins over all words."""

from __future__ import annotations

from .licences import PHRASES, RARE, SHARE, TEMPLATES, mandatory, postings


def _values(rows: list[tuple]) -> str:
    return "values " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in row) + ")" for row in rows)


_WORDS = sorted({w for w, _, _ in postings()} | {w for p in PHRASES for w in p.split()})
_NEEDED = [(t, p + j, w, k) for k, (t, p, words) in enumerate(mandatory()) for j, w in enumerate(words)]
_BASE = " ".join(
    f"when {' and '.join(f'w{j} = ' + chr(39) + w + chr(39) for j, w in enumerate(phrase.split()))} then '{label}'" for phrase, label in PHRASES.items()
)

OP13_SQL = rf"""
with docs as (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as ws
  from documents),
toks as (select rid, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as pos from docs),
three as (
  select rid, pos, word as w0, lead(word) over w as w1, lead(word, 2) over w as w2 from toks window w as (partition by rid order by pos)),
bases as (select rid, pos, case {_BASE} end as label from three),
base as (
  select rid, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as found from bases where label is not null group by rid),
names(template, label) as ({_values([(t, label) for t, (label, _, _) in enumerate(TEMPLATES)])}),
post(word, template, place) as ({_values(postings())}),
lex(word) as ({_values([(w,) for w in _WORDS])}),
needed(template, place, word, phrase) as ({_values(_NEEDED)}),
held as (select distinct rid, word from toks join lex using (word)),
weighed as (
  select word, greatest(1, floor(100 * ln(((select count(*) from docs) + 1) / (count(rid) + 0.5)) + 0.5))::bigint as weight
  from lex left join held using (word) group by word),
rare as (select rid, word, weight from held join weighed using (word) qualify row_number() over (partition by rid order by weight desc, word) <= {RARE}),
lined as (
  select t.rid, template, t.pos - place as start, sum(weight) as met
  from toks t join rare r on r.rid = t.rid and r.word = t.word join post p on p.word = t.word group by all),
stands as (
  select l.rid, l.template, l.start, l.met from lined l join needed n on n.template = l.template
    join toks t on t.rid = l.rid and t.pos = l.start + n.place and t.word = n.word
    join (select template, count(*) as n from needed group by template) m on m.template = l.template
  group by l.rid, l.template, l.start, l.met, m.n having count(*) = m.n),
asked as (select rid, template, sum(weight) as most from rare join post using (word) group by all),
totals as (select template, sum(weight) as total from post join weighed using (word) group by all),
best as (select rid, template, max(met) as met from stands group by all),
scored as (
  select rid, label, met / total as score from best join asked using (rid, template) join totals using (template) join names using (template)
  where met * 100 >= most * {SHARE}),
own as (select rid, list(distinct label) as found, max(score) as score, count(*) as n_templates from scored group by rid)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(b.found), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(coalesce(b.found, []) || coalesce(o.found, []))), ','), '') as labels,
  coalesce(score, 0)::double as score, coalesce(n_templates, 0) as n_templates
from docs d left join base b using (rid) left join own o using (rid)
"""
