"""DuckDB SQL of the operators that SQL can express, for small tables."""

WORD = r"[^\x20\x09-\x0D]+"

NEAR_DUPLICATES = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') ws from documents),
 s as (select doc_id, unnest(list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
   else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end)) g from w),
 n as (select doc_id, count(*) c from s group by 1),
 p as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
 e as (select a src, b dst from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.c + y.c - k)),
 u as (select src, dst from e union all select dst, src from e),
 t(v, l) using key (v) as (select distinct src, src from u union select u.dst, min(t.l) from t join u on u.src = t.v
   join recurring.t r on r.v = u.dst group by u.dst, r.l having min(t.l) < r.l)
select w.doc_id, coalesce(n.c, 0)::bigint n_shingles, coalesce(t.l, w.doc_id)::bigint component_id, w.doc_id = coalesce(t.l, w.doc_id) kept
from w left join n on n.doc_id = w.doc_id left join t on t.v = w.doc_id"""

REPEATED_WORDS = rf"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') ws from documents),
 g as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') x from (select doc_id, ws, unnest(range(1, len(ws) - 11)) i from w where len(ws) >= 13)),
 f as (select x, min(doc_id) d from g group by 1),
 r as (select doc_id, i from g join f using (x) where d < doc_id),
 c as (select distinct doc_id, unnest(range(i, i + 13)) i from r),
 z as (select w.doc_id, o.i, o.x, c.i is not null gone from (select doc_id, unnest(ws) x, unnest(range(1, len(ws) + 1)) i from w) o
   join w on w.doc_id = o.doc_id left join c on c.doc_id = o.doc_id and c.i = o.i)
select w.doc_id, len(w.ws)::bigint n_words, coalesce(k.m, 0)::bigint n_removed, sha256(coalesce(k.t, '')) kept_sha256
from w left join (select doc_id, count(*) filter (where gone) m, string_agg(x, ' ' order by i) filter (where not gone) t from z group by 1) k on k.doc_id = w.doc_id"""

FILL_IN_MIDDLE = r"""
with d as (select doc_id, coalesce(text, '') t, sha256('42:' || doc_id) h from documents),
 u as (select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') us,
   ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from d),
 c as (select *, len(us) n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) b,
   case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end form from u),
 p as (select *, array_to_string(us[1:a], '') x, array_to_string(us[a + 1:b], '') y, array_to_string(us[b + 1:], '') z from c)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(x) end::bigint prefix_chars, case when form <> 'plain' then length(y) end::bigint middle_chars,
 sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end) output_sha256, sha256(t) restored_sha256 from p"""
