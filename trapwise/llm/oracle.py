"""Brute-force DuckDB SQL of the training-data queries."""

OP1 = r"""
with rules(rule, verdict) as (values ('net/','block'), ('example.net/en/','allow'), ('example.com/de/','block'), ('org/fr/','allow')),
r as (select rule, verdict, split_part(rule,'/',1) as h, substr(rule, strpos(rule,'/')) as p from rules),
u as (select page_id, case when strpos(url,'://') > 0 then substr(url, strpos(url,'://') + 3) else '' end as rest from pages),
v as (select page_id, translate(regexp_extract(rest,'^([^/?#]*)',1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest,'^[^/?#]*([^?#]*)',1) as path from u),
m as (select v.page_id, r.rule, r.verdict from v join r
      on (v.host = r.h or ends_with(v.host, '.' || r.h)) and starts_with(v.path, r.p)),
b as (select page_id, max(struct_pack(n := length(rule), rule := rule, verdict := verdict)) as b from m group by page_id)
select v.page_id, v.host, v.path, b.b.rule as rule, coalesce(b.b.verdict, 'allow') as verdict
from v left join b using (page_id)
"""

OP7 = r"""
with d as (select doc_id, source, coalesce(text,'') as t from documents),
w as (select doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from d),
g as (select doc_id, unnest(range(1, greatest(len(ws) - 3, 1))) as i, ws from w),
g2 as (select doc_id, i, array_to_string(ws[i:i+4], ' ') as s from g),
twice as (select doc_id, s from g2 group by doc_id, s having count(*) > 1),
cov as (select doc_id, count(distinct i + k) as n from
        (select g2.doc_id, g2.i, unnest(range(0,5)) as k from g2 join twice using (doc_id, s)) group by doc_id),
c as (select w.doc_id, w.source, cast(len(ws) as bigint) as n_words,
             cast(length(array_to_string(ws,'')) as bigint) as word_chars,
             cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
             cast(coalesce(cov.n, 0) as bigint) as n_repeat_words
      from w left join cov using (doc_id)),
f as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed from c),
h as (select source, count(*) as n, sum(base_failed::int)::bigint as k from f where source is not null group by source),
p as (select avg(floor(k * 1000000.0::double / n)) / 1e6 as m,
             greatest(avg(floor(k * 1000000.0::double / n) * floor(k * 1000000.0::double / n)) / 1e12
                      - (avg(floor(k * 1000000.0::double / n)) / 1e6) * (avg(floor(k * 1000000.0::double / n)) / 1e6), 0) as var from h),
q as (select m, least(greatest(case when var > 0 then m * (1 - m) / var - 1 else 1e6 end, 1), 1e6) as s from p),
v as (select source, n, k, (k + m * s) / (n + s) < 0.5 as ok from h, q)
select f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
       (not f.base_failed and coalesce(v.ok, true)) as kept, f.source, v.n as host_docs, v.k as host_failed
from f left join v on f.source = v.source
"""

OP5 = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bl as (select item_id, ws, least(len(ws), 10) as n from b where len(ws) > 0),
bw as (select distinct item_id, n, array_to_string(ws[i:i+n-1], ' ') as w from
       (select item_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from bl)),
ns as (select distinct n from bl),
dw as (select doc_id, n, i, array_to_string(ws[i:i+n-1], ' ') as w from
       (select doc_id, ws, n, unnest(range(1, greatest(len(ws) - n + 2, 1))) as i from d, ns)),
h as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.w = bw.w),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
it as (select doc_id, count(*) as k, string_agg(x, ',' order by x) as s from
       (select distinct doc_id, cast(item_id as varchar) as x from h) group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(k, 0) as bigint) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join it using (doc_id)
"""

OP4 = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, case when len(ws) = 1 then ws[1] else ws[i] || ' ' || ws[i + 1] end as g from
      (select doc_id, ws, unnest(range(1, greatest(len(ws), least(len(ws) + 1, 2)))) as i from w)),
c as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join c x on x.doc_id = p.a join c y on y.doc_id = p.b where 100 * k >= 80 * (x.n + y.n - k)),
u as (select a, b from e union all select b, a from e),
r(doc_id, reach) as (select doc_id, doc_id from documents union select r.doc_id, u.b from r join u on u.a = r.reach),
m as (select doc_id, min(reach) as component_id from r group by doc_id),
k as (select doc_id, sha256(string_agg(g, chr(10) order by g)) as h from s group by doc_id),
q as (select h, min(doc_id) as class_id from k group by h)
select d.doc_id, coalesce(c.n, 0) as n_shingles, m.component_id, d.doc_id = m.component_id as kept, coalesce(q.class_id, d.doc_id) as class_id
from documents d join m using (doc_id) left join c using (doc_id) left join k using (doc_id) left join q using (h)
"""

OP11 = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
i as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as t from benchmark),
g as (select count(*) as docs, cast(sum(len(ws)) as bigint) as words from d where len(ws) > 0),
p as (select r, doc_id, n, t, count(*) as tf from (select r, doc_id, len(ws) as n, unnest(ws) as t from d) group by all),
f as (select t, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from p, g group by t, docs),
s as (select item_id, r, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) as bigint) as score
      from i join p using (t) join f using (t), g group by item_id, r, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank, doc_id, score
from s where score > 0 qualify rank <= 10
"""
