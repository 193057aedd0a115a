"""SQL, for an engine other than Spark, that gives the rows of queries on whole tables.

No SQL is given for fingerprints, packing and trained models; tests compare those with brute force, round trips and held-out labels.
"""

from .rules import MEASURES, SPREAD, STEADY, UNIT
from .secret_scan import ACCESS, ASSIGN, ASSIGN_KEPT, ENDPOINT, HEX, IDENTIFIER, KEY, KEY_KEPT, KINDS, SCOPE

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind(rank: int, pattern: str, kept: tuple[str, ...] = ()) -> str:
    tests = "".join(f" and regexp_matches(m, {_quoted(x)})" for x in kept)
    return f"""
      select doc_id, {rank} as rank, upto - length(m) as s, upto as e from (
        select doc_id, m, sum(length(p) + length(m)) over (partition by doc_id order by i) as upto from (
          select doc_id, i, pieces[i] as p, matches[i] as m from (
            select doc_id, pieces, matches, unnest(range(1, len(matches) + 1)) as i from (
              select doc_id, regexp_split_to_array(text, {_quoted(pattern)}) as pieces, regexp_extract_all(text, {_quoted(pattern)}) as matches from d))))
      where true{tests}"""


_FOUND = "\n union all ".join([_kind(0, ASSIGN, ASSIGN_KEPT), _kind(1, ACCESS), _kind(2, HEX), _kind(3, IDENTIFIER), _kind(4, KEY, KEY_KEPT), _kind(5, ENDPOINT)])
_NAMES = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_TEXT = f"string_agg({_NAMES}[rank + 1] || ':' || s::bigint || ':' || e::bigint, ',' order by s, rank, e)"

OP2 = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
found as ({_FOUND}),
base as (select * from found where rank < 3),
weak as (select * from found f where rank > 2 and not exists (select 1 from base b where b.doc_id = f.doc_id and f.s < b.e and b.s < f.e)),
near as (
  select w.doc_id, w.rank, w.s, w.e, bool_or(x.rank in (1, 3)) as has_id, bool_or(x.rank not in (1, 3)) as has_secret
  from weak w join (select * from base union all select * from weak where rank < 5) x
    on w.doc_id = x.doc_id and w.s < x.e + {SCOPE} and x.s < w.e + {SCOPE}
  group by all),
spans as (select * from base union all
  select doc_id, rank, s, e from near where case rank when 3 then has_secret when 4 then has_id else has_id and has_secret end),
b as (select doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex, {_TEXT} as t from base group by 1),
a as (select doc_id, {_TEXT} as t from spans group by 1)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(b.t, '')) as base_sha256, coalesce(a.t, '') as spans
from d left join b using (doc_id) left join a using (doc_id)"""

_ESCAPED = r"regexp_replace({}, '\\|</?turn', '\\\0', 'g')"
_ROLE = r"regexp_replace(role, '[\\>\n]', '\\\0', 'g')"
OP3 = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, turn, role, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) t(turn, role))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('<turn ' || {_ROLE} || '>' || chr(10) || {_ESCAPED.format('text')} || '</turn>' || chr(10)))::bigint as formatted_chars,
  false as rewrites
from c group by conv_id"""

OP4 = f"""
with recursive w as (select doc_id, {_WORDS} as ws from documents),
n as (select doc_id, ws, array_to_string(ws, ' ') as node from w),
u as (select node, min(doc_id) as rep, count(*) as copies, any_value(ws) as ws from n group by node),
s as (select distinct rep, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as g from u),
k as (select rep, count(*) as size from s group by rep),
p as (select a.rep as a, b.rep as b, count(*) as both_have from s a join s b on a.g = b.g and a.rep <> b.rep group by 1, 2),
l as (select a, b from p join k x on x.rep = a join k y on y.rep = b where 5 * both_have >= 4 * (x.size + y.size - both_have)),
reach as (select rep as a, rep as b from u union select r.a, l.b from reach r join l on l.a = r.b),
classes as (select a, min(b) as class_id from reach group by a),
links as (select l.a, sum(u.copies)::bigint as links from l join u on u.rep = l.b group by l.a)
select n.doc_id, c.class_id, u.copies - 1 as n_copies, u.copies - 1 + coalesce(links.links, 0) as n_links
from n join u using (node) join classes c on c.a = u.rep left join links on links.a = u.rep"""

_MEASURED = ", ".join(f"'{m}': {sql.replace(' div ', ' // ')}" for m, (sql, _, _) in MEASURES.items())
_BOUNDS = " union all ".join(
    f"select l.lang, l.source, l.measure, {'q1 - ' + f'({SPREAD} * (q3 - q1) + {slack})' if low else '0'} as low, q3 + {SPREAD} * (q3 - q1) + {slack} as high from q l where measure = '{m}'"
    for m, (_, slack, low) in MEASURES.items())
OP5 = f"""
with w as (select doc_id, lang, source, coalesce(text, '') as text, {_WORDS} as ws from documents),
tri as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2)),
twice as (select doc_id, i from tri qualify count(*) over (partition by doc_id, g) > 1),
cover as (select doc_id, count(distinct i + k) as n from twice, (values (0), (1), (2)) t(k) group by doc_id),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from w),
counted as (
  select w.doc_id, lang, source, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines,
    coalesce(cover.n, 0) as n_repeat_words
  from w join lines using (doc_id) left join cover using (doc_id)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted),
v as (select doc_id, lang, source, unnest(map_entries(map {{{_MEASURED}}})) as m from judged where not base_failed),
vals as (select doc_id, lang, source, m.key as measure, m.value as value from v),
each as (select lang, source, measure, value - value % (1::bigint << greatest(length(bin(value)) - 6, 0)) as bucket, count(*) as n from vals group by all),
by_lang as (select lang, measure, bucket, sum(n) as n from each group by all),
whole as (select measure, bucket, sum(n) as n from each group by all),
lang_share as (select lang, measure, bucket, n * {STEADY * UNIT} // sum(n) over (partition by lang, measure) as weight from by_lang),
whole_share as (select measure, bucket, n * {STEADY * UNIT} // sum(n) over (partition by measure) as weight from whole),
groups as (select distinct lang, source from each),
parts as (select lang, source, measure, bucket, n * {UNIT} as weight from each
  union all select g.lang, g.source, measure, bucket, weight from groups g join lang_share s on g.lang is not distinct from s.lang
  union all select g.lang, g.source, measure, bucket, weight from groups g, whole_share),
merged as (select lang, source, measure, bucket, sum(weight) as n from parts group by all),
ranked as (select *, sum(n) over (partition by lang, source, measure order by bucket) as upto, sum(n) over (partition by lang, source, measure) as total from merged),
q as (select lang, source, measure, min(bucket) filter (4 * upto >= total) as q1, min(bucket) filter (4 * upto >= 3 * total) as q3 from ranked group by lang, source, measure),
chosen as ({_BOUNDS}),
bad as (select doc_id, bool_or(value not between low and high) as outside from vals x join chosen c
  on x.lang is not distinct from c.lang and x.source is not distinct from c.source and x.measure = c.measure group by doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(outside, false) as kept
from judged left join bad using (doc_id)"""

_DIGITS = "list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, (k // 4) * 5 + 1, 5))::bigint >> (15 - (k % 4) * 5)) % 32 + 1, 1))"
OP6 = f"""
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages),
f as (select page_id, body, h, min(page_id) over (partition by body) as first_id from p)
select page_id, strlen(body) as payload_bytes, array_to_string({_DIGITS}, '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to
from f"""

OP7 = """
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size,
    (('0x' || substr(md5('mix:' || doc_id), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
t as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from s),
x as (select *, sum(source_size) over () * 1.0::double - coalesce(sum(source_size) over b, 0) * 3 as rest, sum(weight) over () - coalesce(sum(weight) over b, 0) as among
  from t window b as (order by source_size::double / weight, source nulls last rows between unbounded preceding and 1 preceding)),
o as (select *, source_size * 3 * among > weight * rest as is_open from x),
lv as (select rest as lr, among as la from o where is_open order by source_size::double / weight, source nulls last limit 1),
g as (select source, source_size, least(case when is_open then (weight * lr)::double / la else (source_size * 3)::double end, (source_size * 3)::double) as target from o left join lv on true),
h as (select d.*, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as scale from d join g on d.source is not distinct from g.source),
e as (select *, floor(least(3.0, scale)) as whole, least(3.0, scale) - floor(least(3.0, scale)) as f from h),
r as (select *, (u / (1 - u)) / (f / (1 - f)) as q, target - source_size * whole as rest from e where f > 0 and f < 1),
c as (select doc_id, rest, size, sum(size) over (partition by source order by q / (1 + q), doc_id, size rows unbounded preceding) as upto from r where rest > 0),
k as (select doc_id from c where upto + (upto - size) <= 2 * rest)
select e.doc_id, e.size, e.source_size, e.target, e.size * (e.whole + case when k.doc_id is not null then 1 else 0 end)::bigint as taken
from e left join k on k.doc_id = e.doc_id"""

OP11 = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from documents),
grams as (select lang, w, size, unnest(range(1, len(w) - size + 2)) as i from pieces, (values (1), (2), (3)) s(size) where len(w) >= size),
f as (select lang, size, w[i : i + size - 1] as p, count(*) as a from grams group by all),
totals as (select lang, sum(a)::bigint as n from f where size = 1 group by 1),
candidates as (select * from f where size > 1 and a >= 10),
inner_ones as (
  select lang, p[1 : 2] as p, a from candidates where size = 3
  union all select lang, p[2 : 3], a from candidates where size = 3),
kept as (select c.* from candidates c left join (select lang, p, max(a) as longer from inner_ones group by all) i using (lang, p)
  where longer is null or 100 * longer < 50 * c.a),
cuts as (select kept.*, unnest(range(1, size)) as k from kept),
scored as (
  select c.lang, c.p, c.a, k, l.a as l, r.a as r, (1000000::hugeint * c.a * c.a) // (l.a::hugeint * r.a) as score
  from cuts c join f l on l.lang = c.lang and l.p = c.p[1 : k] join f r on r.lang = c.lang and r.p = c.p[k + 1 : c.size]),
worst as (select * from scored qualify row_number() over (partition by lang, p order by score, k) = 1),
ranked as (select *, array_to_string(p, ' ') as phrase, row_number() over (partition by lang order by score desc, a desc, array_to_string(p, ' ')) as rank from worst)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join totals using (lang) where rank <= 2000"""

OP12 = r"""
with recursive d as (select coalesce(cast(doc_id as varchar), '') as k, regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+') as runs from documents),
r as (select k, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from (select k, unnest(runs) as run from d) group by all),
steps as (select list(c order by i) as t from (
  select i, list_reduce(range(8), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as c from range(256) s(i))),
bytes as (select run, n, list_transform(range(strlen(k) + 1 + strlen(run)), lambda i: cast('0x' || substr(hex(k || ':' || run), 2 * i + 1, 2) as bigint)) as b from r),
hashed as (select run, n, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::bigint), 4294967295) as h from bytes, steps),
spoilt as (select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed),
v as (select word, sum(n)::bigint as n from spoilt where length(word) >= 5 group by 1 having sum(n) >= 3),
cut as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from v)),
pairs as (
  select a.word as x, b.word as y from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word from cut a join v b on a.rest = b.word
  union select b.word, a.word from cut a join v b on a.rest = b.word),
near as (select x as word, count(*) as n_near, arg_min(y, struct_pack(m := -v.n, w := y)) as best, max(v.n) as best_n from pairs join v on v.word = y group by 1),
forms as (select v.word, n, coalesce(n_near, 0) as n_near, case when best_n >= 2 * n then best end as form, case when best_n >= 2 * n then best_n end as form_n from v left join near using (word)),
ways as (select word, word as at from forms union all select w.word, f.form from ways w join forms f on f.word = w.at where f.form is not null)
select f.word, f.form, w.at as root, f.n, f.n_near, f.form_n from forms f join ways w using (word) join forms g on g.word = w.at where g.form is null"""

ORACLES = {"op2_secret_scan": OP2.strip(), "op3_chat_format": OP3.strip(), "op4_jaccard_join": OP4.strip(), "op5_quality_rules": OP5.strip(),
           "op6_warc": OP6.strip(), "op7_pareto_mix": OP7.strip(),
           "op11_collocations": OP11.strip(), "op12_spelling_variants": OP12.strip()}
