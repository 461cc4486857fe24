"""SQL of the queries that SQL can express: every pair compared, every chain followed, on whole tables."""

from __future__ import annotations

from peerlume.functions.keys import ABSTRACT_STAND_INS, DASHES, DOI_PREFIX_OF_SOURCE, INVISIBLE
from peerlume.llm.overlap import SIMILAR

_SQUEEZED = f"regexp_replace(replace(lower(regexp_replace({{c}}, '{INVISIBLE}', '', 'g')), '%2f', '/'), '{DASHES}', '-', 'g')"
_ABSTRACTS = ", ".join(f"'{x}'" for x in ABSTRACT_STAND_INS)
_PREFIXES = " ".join(f"when split_part(i, ':', 1) = '{s}' then '{p}' || substr(i, strpos(i, ':') + 1)" for s, p in DOI_PREFIX_OF_SOURCE.items())

# canonical spellings as macros would be: each is one expression over a column
_DOI = f"""(select case when x <> '' and x not like '10.0000/%' then x end
  from (select regexp_extract({_SQUEEZED.format(c='{c}')}, '(10\\.\\d{{{{4,9}}}}/.*[^\\s./,;:)\\]])', 1) as x))"""
_ID = f"""(select case when s = '' then null when strpos(s, ':') = 0 then s
    when substr(s, strpos(s, ':') + 1, 3) = '10.' then split_part(s, ':', 1) || ':' || regexp_replace(substr(s, strpos(s, ':') + 1), '^(10\\.\\d{{{{4,9}}}})_', '\\1/')
    else s end
  from (select {_SQUEEZED.format(c='{c}')} as s))"""


def _doi(c: str) -> str:
    return _DOI.format(c=c)


def _id(c: str) -> str:
    return _ID.format(c=c)


def _unversioned(c: str) -> str:
    return f"regexp_replace({c}, '^(.*\\d{{4,}})(?:\\.v?|v)\\d{{1,3}}$', '\\1')"


def _words(c: str) -> str:
    plain = f"regexp_replace(regexp_replace(coalesce({c}, ''), '<[^<>]{{0,200}}>', ' ', 'g'), '&(?:amp|nbsp|lt|gt|quot|#\\d{{1,6}});', ' ', 'g')"
    return f"list_distinct(list_filter(regexp_split_to_array(lower({plain}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"


def _texts(table: str, number: str, more: str = "") -> str:
    """(number, more, t, a, b): different words of title, abstract and both."""
    in_order = "array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(coalesce(abstract, ''), '<[^<>]{0,200}>', ' ', 'g'), '&(?:amp|nbsp|lt|gt|quot|#\\d{1,6});', ' ', 'g')), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), ' ')"
    return f"""(select *, list_distinct(list_concat(t, a)) as b from (
  select {number}{more}, {_words('title')} as t, case when {in_order} in ({_ABSTRACTS}) then []::varchar[] else {_words('abstract')} end as a from {table}))"""


_NEAR = " and ".join(
    f"case when len(x.{w}) + len(y.{w}) = 0 then true else len(list_intersect(x.{w}, y.{w})) >= {SIMILAR} * (len(x.{w}) + len(y.{w}) - len(list_intersect(x.{w}, y.{w}))) end" for w in "tab"
) + " and len(x.b) > 0 and len(y.b) > 0"

SQL: dict[str, str] = {}

SQL["p1_found"] = f"""
with recursive i as (select entry_no, {_id('id')} as i, {_unversioned(_doi('doi'))} as of_doi from articles),
named as (select entry_no, of_doi, {_unversioned(f"case when substr(i, strpos(i, ':') + 1, 3) = '10.' then substr(i, strpos(i, ':') + 1) {_PREFIXES} else i end")} as of_id from i),
keys as (select entry_no, of_doi as key from named where of_doi is not null union select entry_no, of_id from named where of_id is not null),
reach as (select entry_no, key from keys union select r.entry_no, k2.key from reach r join keys k1 on k1.key = r.key join keys k2 on k2.entry_no = k1.entry_no),
groups as (select r.entry_no, min(k.entry_no) as group_no, count(distinct k.entry_no) as n from reach r join keys k using (key) group by 1)
select entry_no, group_no from groups where n > 1
"""

_PAIRS = f"""
with x as materialized {_texts('articles', 'entry_no', f", split, {_doi('doi')} as d")},
pairs as (
  select x.entry_no as train_no, y.entry_no as eval_no from x join x y on x.split = 'train' and y.split in ('val', 'test') and (x.d = y.d or ({_NEAR}))
)"""

SQL["p3_found"] = f"{_PAIRS} select least(train_no, eval_no) as entry_no_a, greatest(train_no, eval_no) as entry_no_b from pairs"

SQL["p3_report"] = f"""{_PAIRS}, hits as (select eval_no as entry_no, count(*) as n from pairs group by 1)
select split, coalesce(nullif(replace(trim(regexp_replace(lower(source), '[\\s\u00a0_-]+', ' ', 'g')), ' ', '_'), ''), 'unknown') as source,
  count(*)::bigint as eval_rows, count(n)::bigint as overlapping_rows, coalesce(sum(n), 0)::bigint as overlapping_pairs
from articles left join hits using (entry_no) where split in ('val', 'test') group by 1, 2
"""

SQL["p6_found"] = f"""
with x as materialized {_texts('incoming', 'incoming_no', f", {_id('id')} as i, {_doi('doi')} as d")},
y as materialized (
  select -1 as no, i, d, t, a, b from {_texts('articles', 'entry_no', f", {_id('id')} as i, {_doi('doi')} as d")}
  union all select incoming_no, i, d, t, a, b from x
  union all select -1, {_id('c')}, null, [], [], [] from (select unnest(collected_ids) as c from source_state)
)
select incoming_no from x where exists (select 1 from y where y.no < x.incoming_no and (y.i = x.i or y.d = x.d or ({_NEAR})))
"""

_LABEL = "nullif(replace(trim(regexp_replace(lower({c}), '[\\s\u00a0_-]+', ' ', 'g')), ' ', '_'), '')"


def agreement_sql(classes: dict[str, list[str]]) -> str:
    """Fleiss' kappa of the latest answers; an item none of whose latest answers says anything falls back on earlier ones."""
    fields = " union all ".join(f"select '{f}' as field, concern_no, annotator_id, {_LABEL.format(c=f)} as label, labelled_at, label_no from concern_labels" for f in classes)
    known = " or ".join(f"(field = '{f}' and label in ({', '.join(repr(c) for c in cs)}))" for f, cs in classes.items())
    return f"""
with f as (select *, row_number() over w = 1 as latest, row_number() over (partition by field, concern_no, annotator_id, label is null order by labelled_at desc, label_no desc) = 1 and label is not null as told
  from ({fields}) where concern_no is not null and annotator_id is not null window w as (partition by field, concern_no, annotator_id order by labelled_at desc, label_no desc)),
silent as (select field, concern_no from f where latest group by 1, 2 having count_if({known}) = 0),
votes as (
  select field, concern_no, label from f anti join silent using (field, concern_no) where latest and ({known})
  union all select field, concern_no, label from f semi join silent using (field, concern_no) where told and ({known})
),
cells as (select field, concern_no, label, count(*) as n from votes group by 1, 2, 3),
items as (select field, concern_no, sum(n) as m, sum(n * (n - 1)) as same from cells group by 1, 2 having sum(n) > 1),
shares as (select field, label, sum(n) as n from cells semi join items using (field, concern_no) group by 1, 2),
expected as (select field, sum((n / t) ** 2) as expected from (select *, sum(n) over (partition by field) as t from shares) group by 1),
observed as (select field, count(*) as items, avg(same / (m * (m - 1))) as observed from items group by 1)
select field, items, round(observed, 9) as observed, round(expected, 9) as expected, round(case when expected < 1 then (observed - expected) / (1 - expected) end, 9) as kappa
from observed join expected using (field)
"""


SQL["p7_roundtrip"] = "select doc_id from documents where false"  # nothing is lost
