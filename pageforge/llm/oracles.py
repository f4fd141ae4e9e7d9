"""The results that SQL can express, for DuckDB over the same tables: by definition, all pairs compared."""

from __future__ import annotations

_VECTORS = """v as (select vec_id, label, embedding::double[] as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0)"""
_DOT = "list_reduce(list_transform(list_zip({0}, {1}), lambda x: x[1] * x[2]), lambda s, x: s + x)"
_AWAY = "list_reduce(list_transform(list_zip({0}, {1}), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda s, x: s + x)"

ORACLES: dict[str, str] = {
    "op4_nn_descent": f"""with recursive {_VECTORS},
n as (select vec_id, label, e, sqrt({_DOT.format('e', 'e')}) as size from v where label is not null),
link as (select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id and {_DOT.format('a.e', 'b.e')} / (a.size * b.size) >= 0.93),
reach as (select a, b from link union select r.a, l.b from reach r join link l on l.a = r.b),
own as (select a, min(b) as least from reach group by a),
degree as (select a, count(*) as n from link group by a)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, least(vec_id, coalesce(least, vec_id)) as component_id, vec_id = least(vec_id, coalesce(least, vec_id)) as kept, 1.0::double as audit_recall
from embeddings left join own on own.a = vec_id left join degree on degree.a = vec_id""",
    "op5_ngram_join": r"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(len(w) - 4), lambda k: array_to_string(w[k + 1 : k + 5], ' ')) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
link as (select a, b from shared join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
side as (select a, b from link union all select b, a from link),
reach as (select a, b from side union select r.a, l.b from reach r join side l on l.a = r.b),
own as (select a, min(b) as least from reach group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) as component_id from documents d left join n using (doc_id) left join own on own.a = d.doc_id""",
    "op9_collision_counting": f"""with {_VECTORS},
p as (select q.vec_id as query_id, v.vec_id, sqrt({_AWAY.format('q.e', 'v.e')}) as score from v q join v on q.vec_id % 100 = 0 and q.vec_id <> v.vec_id and len(q.e) = len(v.e)),
r as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from p)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 10""",
    "op13_fill_middle": r"""with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
c as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
s as (select *, array_to_string(units[1:a], '') as p, array_to_string(units[a + 1:b], '') as m, array_to_string(units[b + 1:], '') as s from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256 from s""",
}
