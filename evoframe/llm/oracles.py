"""SQL for the queries that it can express; DuckDB runs it over the same tables."""

from __future__ import annotations

_LOW = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "[^\\x20\\x09-\\x0D]+"
_PLAIN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

OP1 = """with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_max(list_transform(embedding, lambda x: abs(x))) > 0),
 l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
 r(id, c) as (select vec_id, vec_id from embeddings union select l.a, r.c from r join l on r.id = l.b), c as (select id, min(c) as c from r group by 1), n as (select a, count(*) as n from l group by 1)
 select id as vec_id, coalesce(n, 0) as n_links, c as component_id, id = c as kept from c left join n on id = a"""

OP2 = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents), p as (select doc_id, s, substr(h, 2 * s::bigint + 1, 200) as w from (select doc_id, h, unnest(range(0, len(h) // 2 - 99)) as s from d)),
 k as (select doc_id, s from (select doc_id, s, row_number() over (partition by w order by doc_id, s) as r from p) where r > 1),
 i as (select doc_id, g, min(s) as s, max(s) + 100 as e from (select *, sum(f) over (partition by doc_id order by s) as g from (select *, case when s - lag(s) over (partition by doc_id order by s) <= 100 then 0 else 1 end as f from k)) group by 1, 2),
 t as (select doc_id, list(s order by s) as a, list(e order by s) as b, sum(e - s) as n, count(*) as m from i group by 1),
 o as (select d.doc_id, h, coalesce(n, 0) as n, coalesce(m, 0) as m, list_transform(range(0, coalesce(m, 0) + 1), lambda j: substr(h, 2 * case when j = 0 then 0 else b[j] end + 1, 2 * (case when j = coalesce(m, 0) then len(h) // 2 else a[j + 1] end - case when j = 0 then 0 else b[j] end))) as parts from d left join t using (doc_id))
 select doc_id, (len(h) // 2)::bigint as n_bytes, n::bigint as n_removed, m::bigint as n_spans, sha256(unhex(array_to_string(parts, ''))) as kept_sha256 from o"""

_ESC = "len(replace(replace(replace({t}, '\\', '\\\\'), '#', '\\#'), '<', '\\<'))"

OP3 = f"""with c as (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t from conversations union all select -7, x, y, '\\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(x, y))
 select conv_id, count(*) as n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) as turns_sha256, coalesce(sum(len(t)) filter (r = 'assistant'), 0)::bigint as loss_chars,
 sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (r = 'assistant'), '')) as loss_sha256, sum({_ESC.format(t='r')} + len(r) - len(replace(r, ':', '')) + {_ESC.format(t='t')} + 15)::bigint as formatted_chars from c group by 1"""

OP6 = f"""with recursive w as (select doc_id, regexp_extract_all({_LOW.format(t='text')}, '{_BLANK}') as w from documents),
 s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end as s from w),
 e as (select doc_id, len(s) as n, unnest(s) as g from s), x as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as an, any_value(b.n) as bn, count(*) as both from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
 l as (select a, b from x where 100 * "both" >= 80 * (an + bn - "both")), r(id, c) as (select doc_id, doc_id from documents union select l.a, r.c from r join l on r.id = l.b)
 select doc_id, len(s)::bigint as n_shingles, c as component_id from s join (select id, min(c) as c from r group by 1) on id = doc_id""".replace(" as both from", ' as "both" from')

OP7 = f"""with w as (select doc_id, regexp_extract_all({_LOW.format(t='text')}, '{_PLAIN}') as w from documents), i as (select item_id::varchar as item, regexp_extract_all({_LOW.format(t='text')}, '{_PLAIN}') as w from benchmark),
 k as (select distinct item, least(len(w), 10) as m, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') as g from (select *, unnest(range(1, greatest(len(w) - 8, 2))) as p from i where len(w) > 0)),
 d as (select doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') as g from (select *, unnest(range(1, len(w) - m + 2)) as p from w, (select distinct m from k))),
 h as (select doc_id, item, m, p from d join k using (m, g)), c as (select doc_id, count(distinct q) as n from (select doc_id, unnest(range(p, p + m)) as q from h) group by 1), t as (select doc_id, count(distinct item) as n, string_agg(distinct item, ',' order by item) as items from h group by 1)
 select w.doc_id, len(w)::bigint as n_words, coalesce(c.n, 0) as n_hit, coalesce(t.n, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated from w left join c on c.doc_id = w.doc_id left join t on t.doc_id = w.doc_id"""

_TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_SHARE = "(1 + (1000000000::hugeint * ({c} + 5)) // ({n} + 5 * v))"

OP11 = f"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOW.format(t='text')}, '{_TERM}') as w from documents),
 c as (select lang, source, term, count(*) as n, count(distinct r) as d from (select r, lang, source, unnest(w) as term from d) group by 1, 2, 3), k as (select lang, term, sum(n) as n from c group by 1, 2 having sum(d) >= 30),
 g as (select distinct lang, source from d), v as (select lang, count(*) as v, sum(n) as whole from k group by 1), x as (select g.lang, g.source, k.term, k.n as kn, coalesce(c.n, 0) as n from g join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
 p as (select x.lang, x.source, x.term, x.n, {_SHARE.format(c='x.n', n='s.n')} as p, {_SHARE.format(c='kn', n='whole')} as q from x join v on v.lang = x.lang join (select lang, source, sum(n) as n from x group by 1, 2) s on s.lang = x.lang and s.source = x.source),
 o as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(abs(pa.p - pb.p)), 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join p pa on pa.lang = a.lang and pa.source = a.source left join p pb on pb.lang = b.lang and pb.source = b.source and pb.term = pa.term group by 1, 2, 3, 4
 union all select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q)
 select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from o qualify part = 'pair' or rank <= 50"""

_LE = "printf('%02X%02X%02X%02X', {x} & 255, ({x} >> 8) & 255, ({x} >> 16) & 255, ({x} >> 24) & 255)"

OP12 = f"""with t as (select list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t),
 d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents), p as (select doc_id, (len(h) // 2)::bigint as n_bytes, h || repeat('00', case when h = '' then 64 else ((64 - (len(h) // 2) % 64) % 64)::int end) as h from d),
 b as (select doc_id, n_bytes, h, (len(h) // 2)::bigint as n, list_transform(range(0, (len(h) // 2)::bigint), lambda i: ('0x' || substr(h, 2 * i::bigint + 1, 2))::bigint) as b from p),
 w as (select *, unhex('52494646' || {_LE.format(x='(n + 36)')} || '57415645666D7420' || '10000000' || '01000100' || '401F0000' || '401F0000' || '01000800' || '64617461' || {_LE.format(x='n')} || h) as w from b)
 select doc_id, n_bytes, n as payload_bytes, sha256(unhex(h)) as payload_sha256, xor(list_reduce(list_concat([4294967295], b[n - 63 : n]), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295)::bigint as tail_crc32, octet_length(w)::bigint as media_bytes, sha256(w) as media_sha256,
 'sum=' || list_sum(b)::bigint || ';squares=' || list_sum(list_transform(b, lambda x: x * x))::bigint || ';crossings=' || list_sum(list_transform(range(1, n), lambda i: ((b[i] >= 128) <> (b[i + 1] >= 128))::bigint))::bigint as feature from w, t"""

ORACLE = {"op1_embedding_dedup": OP1, "op2_suffix_dedup": OP2, "op3_chat_format": OP3, "op6_ngram_jaccard": OP6, "op7_decontamination": OP7, "op11_source_divergence": OP11, "op12_media_chunks": OP12}
