"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from evidentia.llm import licenses, mixing

_LOWER = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
with d as (select doc_id, {_WORDS.format(c='text')} w from documents),
b as (select coalesce(cast(item_id as varchar), '') item, {_WORDS.format(c='text')} w from benchmark),
bw as (
  select distinct item, least(10, len(w)) size, list_slice(w, i, i + least(10, len(w)) - 1) win
  from (select item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) i from b where len(w) > 0)),
sizes as (select distinct size from bw),
dw as (
  select doc_id, size, i, list_slice(w, i, i + size - 1) win
  from (select doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) i from d, sizes where len(w) >= size)),
hits as (select dw.doc_id, dw.i, dw.size, bw.item from dw join bw on dw.size = bw.size and dw.win = bw.win),
covered as (select doc_id, count(distinct p) n from (select doc_id, unnest(generate_series(i, i + size - 1)) p from hits) group by doc_id),
found as (select doc_id, count(distinct item) n, string_agg(distinct item, ',' order by item) items from hits group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(covered.n, 0) n_hit, coalesce(found.n, 0) n_items,
  sha256(coalesce(items, '')) items_sha256, covered.n is not null contaminated
from d left join covered using (doc_id) left join found using (doc_id)
"""

_RULES = ", ".join(f"({k}, {r.tier}, {licenses.CONFIDENCE[r.tier]!r}, '{r.label}', '{r.keyword}', '{r.pattern}')" for k, r in enumerate(licenses.rules()))
_BASE = ", ".join(f"('{label}', '{licenses.wrapped(phrase)}')" for phrase, label in licenses.BASE)
_PLACES = """
  select {keep}, len(regexp_extract_all(norm, pattern)) m, string_split_regex(norm, pattern) pieces, regexp_extract_all(norm, pattern) texts
  from {source} where regexp_matches(norm, pattern)"""
_STARTS = """
  select *, cast(list_sum(list_transform(pieces[1:k], lambda x: (len(x) - len(replace(x, ' ', ''))) // 2)) + coalesce(list_sum(list_transform(texts[1:k-1], lambda x: (len(x) - len(replace(x, ' ', ''))) // 2)), 0) as bigint) lo
  from (select *, unnest(generate_series(1, m)) k from {source})"""

OP2 = rf"""
with d as (
  select doc_id, len(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) n_words, ' ' || trim(regexp_replace(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g'), ' ') || ' ' norm
  from (select doc_id, {_LOWER.format(c='text')} t from documents)),
base as (select * from (values {_BASE}) b(label, pattern)),
rules as (select * from (values {_RULES}) r(nr, tier, conf, label, keyword, pattern)),
bm as ({_PLACES.format(keep='doc_id, label', source='d, base')}),
bs as ({_STARTS.format(source='bm')}),
rm as ({_PLACES.format(keep='doc_id, nr, conf, label', source='(select * from d, rules where contains(norm, keyword))')}),
rs as (select doc_id, nr, conf, label, lo, lo + (len(texts[k]) - len(replace(texts[k], ' ', ''))) // 2 hi from ({_STARTS.format(source='rm')})),
hits as (select * from rs a where not exists (select 1 from rs b where b.doc_id = a.doc_id and b.nr < a.nr and b.lo <= a.lo and b.hi >= a.hi)),
bagg as (select doc_id, count(*) n, min(lo) f, max(lo) l, string_agg(distinct label, ',' order by label) labels from bs group by doc_id),
every as (select doc_id, label, conf from hits union all select doc_id, label, {licenses.BASE_CONFIDENCE} from bs),
lagg as (select doc_id, string_agg(distinct label, ',' order by label) labels, max(conf) score from every group by doc_id)
select d.doc_id, cast(n_words as bigint) n_words, coalesce(n, 0) n_base, f first_word, l last_word, coalesce(bagg.labels, '') base_labels,
  coalesce(lagg.labels, '') labels, cast(coalesce(score, 0) as double) score
from d left join bagg using (doc_id) left join lagg using (doc_id)
"""

_MIX = mixing.Mix()


def _case(column: str, weights: dict) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in weights.items()) + f" else {_MIX.other} end" if weights else str(_MIX.other)


def _shares(nodes: str, parent: str, own: str) -> str:
    by = f"partition by {parent}" if parent else ""
    return f"""
  select *, case when isfull then cap else (weight * (total - taken)) // open end budget from (
    select *, min(before) filter (where not isfull) over ({by}) taken, max(weights) filter (where not isfull) over ({by}) open from (
      select *, cap * weights <= weight * (total - before) isfull from (
        select *, coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)::bigint before,
          sum(weight) over (o rows between current row and unbounded following)::bigint weights
        from ({nodes}) window o as ({by} order by cap / weight, {own}))))"""


OP4 = rf"""
with t as (
  select doc_id, coalesce(lang, 'und') lang, coalesce(source, 'unknown') source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint n_tokens,
    try_cast(regexp_extract(coalesce(source, ''), '^[a-z]+([0-9]{{1,6}})$', 1) as int) // {_MIX.per_domain} nth
  from documents),
r as (select doc_id, coalesce({list(_MIX.domains)}[nth + 1], 'other') "domain", lang, source, n_tokens from t),
sizes as (select "domain", lang, source, sum(n_tokens)::bigint tokens, (sum(n_tokens) * {_MIX.epochs})::bigint cap from r group by all having sum(n_tokens) > 0),
langs as (select "domain", lang, sum(cap)::bigint cap from sizes group by all),
tops as ({_shares(f'select "domain", sum(cap)::bigint cap, {_case(chr(34) + "domain" + chr(34), _MIX.domain_weights)} weight, (select sum(n_tokens)::bigint * {_MIX.share} // 100 from r) total from langs group by "domain"', '', '"domain"')}),
l2 as ({_shares(f'select langs.*, {_case("lang", _MIX.lang_weights)} weight, tops.budget total from langs join tops using ("domain")', '"domain"', 'lang')}),
l3 as ({_shares(f'select sizes.*, {_case("source", _MIX.source_weights)} weight, l2.budget total from sizes join l2 using ("domain", lang)', '"domain", lang', 'source')}),
p as (
  select r.*, budget // tokens whole, budget % tokens rest, md5('{_MIX.seed}:' || (budget // tokens) || ':' || coalesce(doc_id::varchar, '')) place
  from r join l3 using ("domain", lang, source) where budget > 0),
c as (select *, sum(n_tokens) over (partition by "domain", lang, source order by place, doc_id, n_tokens range between unbounded preceding and current row) upto from p)
select doc_id, "domain", lang, source, unnest(generate_series(0, whole + (upto <= rest)::int - 1))::bigint epoch, n_tokens from c
"""

OP9 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
win as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) h from (select doc_id, w, unnest(generate_series(1, len(w) - 49)) i from d where len(w) >= 50)),
low as (select h, min(doc_id) low from win group by h having min(doc_id) < max(doc_id)),
gone as (select doc_id, list(distinct p) p from (select doc_id, unnest(generate_series(i, i + 49)) p from win join low using (h) where low < doc_id) group by doc_id),
k as (select d.doc_id, len(w) n, coalesce(len(p), 0) r, case when p is null then w else list_filter(w, lambda x, i: not list_contains(p, i)) end kept from d left join gone using (doc_id))
select doc_id, n::bigint n_words, r::bigint n_removed, sha256(array_to_string(kept, ' ')) kept_sha256 from k
"""

OP1 = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER.format(c='text')}, '[^\x20\x09-\x0D]+') w from documents),
g as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 3), ' ') s
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from g group by doc_id),
links as (
  select a, b from (select x.doc_id a, y.doc_id b, count(*) common from g x join g y on x.s = y.s and x.doc_id < y.doc_id group by all)
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * common >= 85 * (na.n + nb.n - common)),
reach as (
  select a x, b y from links union select b, a from links
  union select r.x, l.b from reach r join (select a, b from links union select b, a from links) l on r.y = l.a),
low as (select x, min(y) y from reach group by x)
select d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(low.y, d.doc_id)) component_id
from d left join n using (doc_id) left join low on low.x = d.doc_id
"""

_FAR = "{c: 1000000000, a: '', r: ''}"


def _grown(state: str, cost: str, letter: str, row: str) -> str:
    return f"{{c: {state}.c + {cost}, a: {state}.a || {letter}, r: {state}.r || {row}}}"


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


_NEW_USER, _NEW_ANSWER = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_INS_U = _least("u", *[_grown(x, "2", "'I'", _NEW_USER) for x in ("o", "s", "a")])
_INS_A = _least("a", _grown("u", "2", "'I'", _NEW_ANSWER))
_ENTER = "(case when ini = '{0}' then 'K' else 'R' end)", "(t + case when ini = '{0}' then 0 else 2 end)", "chr(10) || case when ini = '{0}' then role else '{1}' end || ':' || text"


def _entered(state: str, initial: str, role: str) -> str:
    letter, cost, row = (x.format(initial, role) for x in _ENTER)
    return f"case when must then {_FAR} else {_grown(state, cost, letter, row)} end"


OP11 = rf"""
with recursive tab as materialized (
  select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t),
src as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, xor(list_reduce(list_concat([4294967295], list_transform(string_split(
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ord(x) as bigint))), lambda c, b: xor(c >> 8, tab.t[1 + (xor(c, b) & 255)])), 4294967295) % 20 k
  from conversations, tab),
dam as (
  select conv_id, turn, case k when 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case k when 3 then [1, 2] else [1] end) nth
  from src where k != 0),
convs as materialized (select row_number() over () conv, conv_id from (select distinct conv_id from conversations)),
ord as (
  select conv, turn, role, text, row_number() over w i, lag(role[1]) over w || role[1] pair,
    row_number() over (partition by conv, role, text order by turn nulls first, nth) > 1 seen, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') bare
  from dam join convs on dam.conv_id is not distinct from convs.conv_id
  window w as (partition by conv order by turn nulls first, role, sha256(text), nth)),
rows as materialized (
  select *, role[1] ini, bare = '' blank, bare != '' and seen dup, bare != '' and not seen and right(bare, 1) not in ('.', '!', '?') cut,
    bare = '' or seen must, case when right(bare, 1) in ('.', '!', '?') then 0 else 1 end t from ord),
sums as (
  select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (blank) blank, count(*) filter (dup) dup, count(*) filter (cut) cut,
    count(*) filter (pair not in ('su', 'ua', 'au')) illegal, max(i) n
  from rows group by conv),
dp as (
  select conv, 0 i, {{c: 0, a: '', r: ''}} o, {_FAR} s, {_FAR} u, {_FAR} a from convs
  union all
  select conv, i, {_grown('o', '3', "'D'", "''")} o,
    {_least(_grown('s', '3', "'D'", "''"), f"case when must or ini != 's' then {_FAR} else {_grown('o', 't', repr('K'), "chr(10) || role || ':' || text")} end")} s,
    {_least(_grown('u', '3', "'D'", "''"), *[_entered(x, 'u', 'user') for x in ('o', 's', 'a')])} u,
    {_least(_grown('a', '3', "'D'", "''"), _entered('u', 'a', 'assistant'))} a
  from (
    select conv, i, role, text, must, t, ini, o, s, u, {_INS_A} a from (
      select dp.conv, rows.i, role, text, must, t, ini, o, s, {_INS_U} u, a from dp join rows on dp.conv = rows.conv and rows.i = dp.i + 1))),
best as (
  select conv, {_least('o', 'a')} b from (
    select conv, o, {_INS_A} a from (select dp.conv, o, {_INS_U} u, a from dp left join sums using (conv) where dp.i = coalesce(n, 0))))
select conv_id, cast(coalesce(gaps, 0) as bigint) gaps, coalesce(blank, 0) blank, coalesce(dup, 0) duplicate, coalesce(cut, 0) truncated, coalesce(illegal, 0) illegal,
  cast(b.c as bigint) cost, b.a as audit, sha256(b.r[2:]) repaired_sha256
from convs left join sums using (conv) join best using (conv)
"""

OP12 = rf"""
with d as (
  select doc_id, coalesce(cast(source as varchar), '') part, coalesce(text, '') t from documents),
f as (
  select doc_id, part, len(w) < 50 a, 100 * len(list_distinct(w)) < 65 * len(w) b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) c, regexp_matches(t, '[#$%&*|]') d,
    coalesce(doc_id > min(doc_id) over (partition by t), false) e
  from (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w from d)),
l as (select doc_id, max(coalesce(quality = 1, false)) good, max(coalesce(toxic = 1, false)) toxic from labels group by doc_id),
r as (select f.*, coalesce(good, false) good, coalesce(l.toxic, false) toxic from f left join l using (doc_id)),
parts as (select distinct part from d),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
orders as (select a.x || b.x || c.x || d.x || e.x filter_order from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
long as (
  select part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) fails from r),
counted as (select part, fails, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from long group by all),
steps as (select filter_order, step, filter_order[step] own, filter_order[:step - 1] before from orders, (select unnest([1, 2, 3, 4, 5]) step)),
seen as (
  select part, filter_order, step, own, n, good, toxic, fails, list_contains(fails, own) failing,
    len(list_filter(fails, lambda x: contains(before, x))) > 0 gone
  from steps, parts left join counted using (part)),
out as (
  select part, filter_order, step, own, coalesce(sum(n) filter (not failing and not gone), 0) kept, coalesce(sum(n) filter (failing and not gone), 0) removed,
    coalesce(sum(n) filter (failing and gone), 0) redundant, coalesce(sum(n) filter (fails = [own]), 0) unique_fails,
    coalesce(sum(good) filter (failing and not gone), 0) good_lost, coalesce(sum(toxic) filter (failing and not gone), 0) toxic_lost
  from seen group by all)
select part, filter_order, cast(step as integer) step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant,
  cast(unique_fails as bigint) unique_fails, cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost,
  cast(sum(removed) over (partition by part, own) as bigint) shapley
from out
"""

ORACLES: dict[str, str] = {
    "op1_jaccard": OP1,
    "op2_licenses": OP2,
    "op4_mixing": OP4,
    "op5_decontamination": OP5,
    "op9_substrings": OP9,
    "op11_repair": OP11,
    "op12_audit": OP12,
}
