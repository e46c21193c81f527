"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from panelwright.llm import licenses


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
with recursive w as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as words from documents),
s as (
  select distinct doc_id, unnest(case when len(words) >= 3
    then list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))
    when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as sh
  from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * shared >= 90 * (x.n + y.n - shared)),
e as (select a as u, b as v from l union all select b, a from l),
r as (
  select doc_id as node, doc_id as reached from documents
  union
  select r.node, e.v from r join e on e.u = r.reached)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id
from documents d left join n using (doc_id)
join (select node, min(reached) as component_id from r group by node) c on c.node = d.doc_id
"""

QUALITY = rf"""
with t as (select doc_id, coalesce(text, '') as text, {_WORDS} as words from documents),
base as (
  select doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols
  from t),
lines as (
  select doc_id, cast(sum(k - 1) as bigint) as n_dup_lines from (
    select doc_id, line, count(*) as k from (select doc_id, unnest(string_split(text, chr(10))) as line from t)
    where regexp_matches(line, '[^\x20\x09-\x0D]') group by all)
  group by doc_id),
win as (
  select doc_id, unnest(range(1, len(words) - 6)) as i, words from t where len(words) >= 8),
eight as (select doc_id, i, array_to_string(words[i:i + 7], ' ') as ws from win),
twice as (select doc_id, i, ws from eight qualify count(*) over (partition by doc_id, ws) > 1),
marked as (select distinct doc_id, i + k as p from twice, range(8) r(k)),
covered as (
  select m.doc_id, count(*) as n_repeat_words, cast(sum(length(t.words[m.p])) as bigint) as n_repeat_chars
  from marked m join t using (doc_id) group by m.doc_id),
diagonal as (
  select a.doc_id, a.i, b.i - a.i as gap, a.i - row_number() over (partition by a.doc_id, b.i - a.i order by a.i) as island
  from twice a join twice b on a.doc_id = b.doc_id and a.ws = b.ws and a.i < b.i),
longest as (
  select doc_id, max(k) + 7 as n_longest_repeat from (select doc_id, count(*) as k from diagonal group by doc_id, gap, island) group by doc_id),
m as (
  select doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    coalesce(n_repeat_chars, 0) as n_repeat_chars, coalesce(n_longest_repeat, 0) as n_longest_repeat
  from base left join lines using (doc_id) left join covered using (doc_id) left join longest using (doc_id))
select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 100 * n_repeat_chars > 30 * word_chars
    or (n_longest_repeat >= 8 and 100 * n_longest_repeat > 25 * n_words)) as kept
from m
"""


def _license_sql() -> str:
    """The rule list as a table of values; RE2 has no look-ahead, so the blank after a match is matched too."""
    values = ",\n    ".join(
        "('{}', {}, '{}', {}, {}, '{}')".format(k, n, r.label, r.priority, r.confidence, f"^(?:{r.pattern})(?: |$)".replace("'", "''"))
        for n, r in enumerate(licenses.rules()) for k in r.keywords)
    phrases = ", ".join(f"('{p}', '{label}', {p.count(' ') + 1})" for p, label in licenses.BASE.items())
    return rf"""
with rules(keyword, rule, label, priority, confidence, pattern) as (values
    {values}),
phrases(phrase, label, n) as (values {phrases}),
w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
pos as (select doc_id, unnest(range(1, len(words) + 1)) as i, words from w),
base as (
  select doc_id, count(*) as n_base, min(i) - 1 as first_word, max(i) - 1 as last_word, list_distinct(list(label)) as labels
  from pos join phrases on words[i] = string_split(phrase, ' ')[1] and array_to_string(words[i:i + n - 1], ' ') = phrase group by doc_id),
hits as (
  select doc_id, i, i + len(string_split(rtrim(regexp_extract(win, pattern), ' '), ' ')) as stop, rule, label, priority, confidence
  from (select doc_id, i, words[i] as keyword, array_to_string(words[i:i + 15], ' ') as win from pos
        where words[i] in (select keyword from rules)) join rules using (keyword)
  where regexp_matches(win, pattern)),
kept as (
  select doc_id, label, confidence from (
    select *, max(stop) over (partition by doc_id order by i, stop desc, priority desc, rule
      rows between unbounded preceding and 1 preceding) as reach from hits)
  where reach is null or stop > reach),
own as (select doc_id, list_distinct(list(label)) as labels, max(confidence) as confidence from kept group by doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') as labels,
  cast(greatest(coalesce(confidence, 0), case when n_base > 0 then 0.5 else 0 end) as double) as score
from w left join base using (doc_id) left join own using (doc_id)
"""


LICENSES = _license_sql()


def _tree_levels(name: str, rows: str, levels: int) -> str:
    """CTEs <name>0.. of (s, idx, d, last, run): nodes level by level, a finished tree stays as it is."""
    parts = [f"{name}0 as materialized (select s, idx, d, max(idx) over (partition by s) as last, cast([] as varchar[]) as run from ({rows}))"]
    for k in range(levels):
        parts.append(f"""{name}{k + 1} as materialized (
  select s, idx, d, max(idx) over (partition by s) as last, run from (
    select s, idx // 16 as idx, case when last = 0 then min(d) else sha256(string_agg(d, '' order by idx)) end as d,
      case when last = 0 then cast([] as varchar[]) else list(d order by idx) end as run
    from {name}{k} group by s, idx // 16, last))""")
    return ",\n".join(parts)


def _folds(name: str, tree: str, levels: int) -> str:
    """CTEs <name>1.. that take leaves (s, idx, f, sib) of <name>0 up the levels of <tree>."""
    parts = []
    for k in range(levels):
        left, right = "array_to_string(run[1:l.idx % 16], '')", "array_to_string(run[l.idx % 16 + 2:], '')"
        parts.append(f"""{name}{k + 1} as materialized (
  select l.* exclude (idx, f, sib), l.idx // 16 as idx, case when len(run) = 0 then f else sha256({left} || f || {right}) end as f,
    case when len(run) = 0 then sib else sib || {left} || {right} end as sib
  from {name}{k} l join {tree}{k + 1} t on t.s = l.s and t.idx = l.idx // 16)""")
    return ",\n".join(parts)


def _field(column: str) -> str:
    return f"coalesce(strlen(cast({column} as varchar)) || ':' || cast({column} as varchar), '-')"


_HEAD_FIELDS = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_TREE_LEVELS = 6
_CRC = (
    "xor(4294967295, list_reduce(list_concat([cast(4294967295 as bigint)], list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: cast(ascii(ch) as bigint))), "
    "lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))")
MERKLE = f"""
with r as materialized (
  select doc_id, case when source is null then '' else 'x' || source end as s, sha256({_HEAD_FIELDS} || {_field('text')}) as leaf,
    case when {_CRC} % 5 = 0 then sha256({_HEAD_FIELDS} || {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) end as other
  from documents),
p as materialized (
  select *, row_number() over (partition by s order by doc_id nulls first, leaf) - 1 as idx from r),
{_tree_levels('n', 'select s, idx, leaf as d from p', _TREE_LEVELS)},
h as materialized (select s as tree, d as subroot, row_number() over (order by s) - 1 as place from n{_TREE_LEVELS}),
{_tree_levels('m', "select '' as s, place as idx, subroot as d from h", _TREE_LEVELS)},
a0 as materialized (select doc_id, leaf, s, idx, coalesce(other, leaf) as f, '' as sib from p),
{_folds('a', 'n', _TREE_LEVELS)},
b0 as materialized (
  select doc_id, leaf, subroot, '' as s, place as idx, f, sib from a{_TREE_LEVELS} join h on tree = s),
{_folds('b', 'm', _TREE_LEVELS)}
select doc_id, leaf, subroot, d as root, sha256(sib) as proof_sha256, f as folded_root, f = d as verified
from b{_TREE_LEVELS} cross join (select d from m{_TREE_LEVELS})
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
SEARCH = rf"""
with d as materialized (select row_number() over () as r, doc_id, {_TERMS} as t from documents),
s as materialized (select count(*) filter (len(t) > 0) as n, cast(sum(len(t)) as bigint) as l from d),
q as materialized (
  select item_id, text, term, count(*) as c
  from (select item_id, text, unnest({_TERMS}) as term from (select distinct item_id, text from benchmark)) group by all),
p as materialized (
  select r, doc_id, n, term, count(*) as tf
  from (select r, doc_id, cast(len(t) as bigint) as n, unnest(t) as term from d) where term in (select term from q) group by all),
w as materialized (
  select term, cast(floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1))) as bigint) as w from p cross join s group by term),
z as (
  select item_id, text, r, doc_id, cast(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * s.n) // s.l)))) as bigint) as score
  from q join w using (term) join p using (term) cross join s group by all)
select item_id, cast(row_number() over (partition by item_id, text order by score desc, doc_id nulls first) as integer) as rank, doc_id, score
from z where score > 0
qualify row_number() over (partition by item_id, text order by score desc, doc_id nulls first) <= 10
"""

WARC = """
with p as (select page_id, coalesce(html, '') as payload from pages),
g as (select *, case when strlen(payload) >= 1000 then max(page_id) over (partition by payload) end as response from p)
select page_id, cast(strlen(payload) as bigint) as payload_bytes, sha1(payload) as payload_digest,
  case when response is not null and response is distinct from page_id then 'revisit' else 'response' end as record_type,
  case when response is distinct from page_id then response end as refers_to
from g
"""
