"""DuckDB SQL with the same results as the queries that SQL can express."""

from __future__ import annotations

from .mixing import WEIGHTS
from .quality import CLASSES, COMMON_WORDS

WORD = r"[^\x20\x09-\x0D]+"

_sums = lambda c, k: ", ".join(f"sum({c}[{i + 1}])" for i in range(k))
_JS = """sqrt(greatest(list_sum(list_transform(list_zip({c}, {r}), lambda z:
      (case when z[1] > 0 then z[1] / list_sum({c}) * log2(2 * (z[1] / list_sum({c})) / (z[1] / list_sum({c}) + z[2] / list_sum({r}))) else 0 end)
    + (case when z[2] > 0 then z[2] / list_sum({r}) * log2(2 * (z[2] / list_sum({r})) / (z[1] / list_sum({c}) + z[2] / list_sum({r}))) else 0 end))) / 2, 0))"""


def _class_counts() -> str:
    left, out = "coalesce(text, '')", []
    for _, pattern in CLASSES:
        rest = f"regexp_replace({left}, '{pattern}', '', 'g')"
        out.append(f"length({left}) - length({rest})")
        left = rest
    return ", ".join([*out, f"length({left})"])


OP5 = rf"""
with w as (select doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
n as (select row_number() over () as rid, * from w),
t as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from n)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as k from t) where k > 1),
c as (select rid, count(distinct i + d) as n_repeat_words from r, (values (0), (1), (2)) v(d) group by rid),
f as (
  select rid, doc_id, lang, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
    length(array_to_string(ws, '')) - length(regexp_replace(array_to_string(ws, ''), '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, [{_class_counts()}] as cc,
    list_append(list_transform([{", ".join(f"'{x}'" for x in COMMON_WORDS)}], lambda c: len(list_filter(ws, lambda x: x = c))), len(list_filter(ws, lambda x: x not in ({", ".join(f"'{x}'" for x in COMMON_WORDS)})))) as mc
  from n left join c using (rid)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
refs as (select lang as rlang, sum(n_words) as k, [{_sums("cc", len(CLASSES) + 1)}] as cr, [{_sums("mc", len(COMMON_WORDS) + 1)}] as mr from b where not base_failed and lang is not null group by lang),
pool as (select [{_sums("cc", len(CLASSES) + 1)}] as cp, [{_sums("mc", len(COMMON_WORDS) + 1)}] as mp from b where not base_failed),
j as (select b.*, list_transform(coalesce(cr, cp), lambda x: x::double) as cr, list_transform(coalesce(mr, mp), lambda x: x::double) as mr from b left join refs on lang = rlang cross join pool),
s as (select *, case when list_sum(cc) > 0 then {_JS.format(c="cc", r="cr")} else 0 end as class_js, case when n_words > 0 then {_JS.format(c="mc", r="mr")} else 0 end as common_js from j)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and not (list_sum(cc) >= 200 and class_js > 0.32 or n_words >= 100 and common_js > 0.29) as kept
from s
"""

OP8 = r"""
with it as (select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where text is not null),
iw as (select item, least(13, len(ws)) as l, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') as win from (select *, unnest(range(1, greatest(1, len(ws) - 12) + 1)) as i from it where len(ws) > 0)),
wins as (select distinct item, l, win from iw),
d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
dw as (select rid, l, i, array_to_string(ws[i : i + l - 1], ' ') as win from (select rid, ws, l, unnest(range(1, len(ws) - l + 2)) as i from d, (select distinct l from wins))),
m as (select rid, i, dw.l, item from dw join wins using (win, l)),
h as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + l)) as p from (select distinct rid, i, l from m)) group by rid),
n as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from m) group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join h using (rid) left join n using (rid)
"""

OP9 = r"""
with c as (select conv_id, turn, role, text from conversations union all select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)),
t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k, coalesce(role, '') as role, coalesce(text, '') as text from c),
e as (select *, length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(replace(text, '<', ''), '>', '')))
  + length(role) + 4 * (length(role) - length(replace(role, '&', ''))) + 3 * (length(role) - length(replace(replace(role, '<', ''), '>', ''))) + length('<turn >..</turn>.') - 1 as width from t)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256, sum(width)::bigint as formatted_chars
from e group by conv_id
"""

OP10 = rf"""
with d as (select doc_id, source is null as no, coalesce(source, '') as src, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size, md5('mix:' || coalesce(doc_id::varchar, 'null')) as key from documents),
s as (select no, src, sum(size)::bigint as source_size, [{", ".join(f"{w}.0::double" for w in WEIGHTS)}][((row_number() over (order by no, src) - 1) % {len(WEIGHTS)} + 1)::int] as w from d group by no, src),
c as (select *, source_size * 2.0::double as cap, (sum(source_size) over ())::double * 1.5::double as total from s),
k as (select *, cap * sum(w) over (order by cap / w, no, src rows between current row and unbounded following) <= (total - coalesce(sum(cap) over (order by cap / w, no, src rows between unbounded preceding and 1 preceding), 0)) * w as capped from c),
t as (select no, src, source_size, case when capped then cap else w * (total - coalesce(sum(case when capped then cap end) over (), 0)) / sum(case when not capped then w end) over () end as target from k),
p as (select *, sum(size) over (partition by no, src order by key, size rows between unbounded preceding and current row) - size as begins from d join t using (no, src))
select doc_id, size, source_size, target,
  (floor(target)::bigint // greatest(source_size, 1) * size + greatest(0, least(size, floor(target)::bigint % greatest(source_size, 1) - begins)))::bigint as taken
from p
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# crc32 by a table of 256 remainders, over distinct words
OP12 = rf"""
with tab as (select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as tab from (select range as i from range(256))),
d as (select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
dw as (select rid, w, count(*) as n from (select rid, unnest(ws) as w from d) group by rid, w),
bw as (select w, count(*) as n from (select unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark) group by w),
v as (select w, hex(encode(w)) as x from (select w from dw union select w from bw)),
k as (select w, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 as bucket from v, tab),
sb as (select bucket, sum(n) as s from dw join k using (w) group by bucket),
tb as (select bucket, sum(n) as t from bw join k using (w) group by bucket),
tot as (select coalesce((select sum(s) from sb), 0)::double as ss, coalesce((select sum(t) from tb), 0)::double as tt),
g as (select bucket, floor(1000 * ln(((coalesce(t, 0)::double + 1) * (ss + 10000.0::double)) / ((coalesce(s, 0)::double + 1) * (tt + 10000.0::double))))::bigint as gain from sb full join tb using (bucket) cross join tot),
f as (select rid, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from dw join k using (w) join g using (bucket) group by rid),
h as (select rid, doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from d left join f using (rid)),
z as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint as score from h),
r as (select rid, row_number() over (order by score desc, doc_id nulls last, n_features desc, weight desc) as rank, count(*) over () as n from z where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank from z left join r using (rid)
"""

OP13 = rf"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
w as (select rid, lang, source, term, count(*) as n from (select rid, lang, source, unnest(ts) as term from d) group by all),
kept as (select lang, term, sum(n) as total from w group by lang, term having count(*) >= 10),
lv as (select lang, count(*) as v, sum(total) as big from kept group by lang),
c as (select lang, source, term, sum(n) as n from w semi join kept using (lang, term) group by all),
g as (select lang, source, coalesce(v, 0) as v, coalesce(big, 0) as big, coalesce(n, 0) as n from (select distinct lang, source from d) left join lv using (lang) left join (select lang, source, sum(n) as n from c group by all) using (lang, source)),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as had, (1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (g.n + 2 * g.v))::bigint as p, (1 + 1000000000::hugeint * (k.total + 2) // (g.big + 2 * g.v))::bigint as q
  from g join kept k using (lang) left join c using (lang, source, term)),
x as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p where had > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op5_distribution_divergence": OP5, "op8_prefix_filtered_decontamination": OP8, "op9_reply_trees": OP9, "op10_weighted_mix": OP10, "op12_importance_resampling": OP12, "op13_source_divergence": OP13}
