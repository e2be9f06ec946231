"""DuckDB SQL that gives the rows of the queries it can express."""

def _cluster_rounds(rounds: int) -> str:
    """Assignment and update of centroids, once for each round, and a last assignment."""
    parts = []
    for t in range(rounds + 1):
        parts.append(f"""
d{t} as (
  select v.rid, c.c, sum((v.x - c.x) * (v.x - c.x))::bigint as d from points v join c{t} c using (i) group by v.rid, c.c),
a{t} as (select rid, c, d from (select *, row_number() over (partition by rid order by d, c) as k from d{t}) where k = 1)""")
        if t < rounds:
            parts.append(f"""
m{t} as (select a.c, v.i, cast(floor(sum(v.x)::double / count(*)) as bigint) as x from a{t} a join points v using (rid) group by a.c, v.i),
c{t + 1} as (select c.c, c.i, coalesce(m.x, c.x) as x from c{t} c left join m{t} m using (c, i))""")
    return ",".join(parts)


_CLUSTERS = f"""
with kept as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as q from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
points as (select rid, unnest(range(64)) as i, unnest(q) as x from kept),
first as (select q, row_number() over (order by sha256('1:' || vec_id), q) - 1 as c from kept qualify c < 16),
c0 as (select c, unnest(range(64)) as i, unnest(q) as x from first),{_cluster_rounds(3)},
names as (select c, sha256(string_agg(cast(x as varchar), ',' order by i)) as name from c3 group by c)
select vec_id, cast(c as integer) as cluster, d as distance, sum(d) over (partition by c)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia,
       name as centroid_sha256
from a3 join kept using (rid) join names using (c)
"""


ORACLE = {
    "op3_decontaminate": r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
spans as (
  select item_id, w, least(len(w), 13) as size, unnest(range(1, len(w) - least(len(w), 13) + 2)) as pos from items where len(w) > 0),
windows as (select distinct item_id, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') as gram from spans),
sizes as (select distinct size from windows),
starts as (
  select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as pos from words, sizes where len(w) >= size),
grams as (select doc_id, size, pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') as gram from starts),
met as (select doc_id, grams.size, pos, item_id from grams join windows on grams.gram = windows.gram and grams.size = windows.size),
hit as (select doc_id, count(distinct word) as n_hit from (select doc_id, unnest(range(pos, pos + size)) as word from met) group by doc_id),
listed as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from met where item_id is not null) group by doc_id)
select words.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words left join hit using (doc_id) left join listed using (doc_id)
""",
    "op11_chat_format": r"""
with turns as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized as (
  select *, length(regexp_replace(replace(text, '\', '\\'), '(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)', 'x\1', 'g'))
    + case role when 'user' then 15 when 'assistant' then 6 when 'system' then 17 end as chars from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id
""",
    "op12_centroid_clusters": _CLUSTERS,
    "op13_ranked_search": r"""
with terms as (
  select row_number() over () as row_id, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term from documents),
postings as (select row_id, doc_id, term, count(*) as tf from terms group by row_id, doc_id, term),
sizes as (select row_id, sum(tf)::bigint as n from postings group by row_id),
total as (select count(*) as docs, sum(n)::bigint as terms from sizes),
wanted as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term from benchmark),
weights as (
  select term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1))) as bigint) as w
  from postings, total where term in (select term from wanted) group by term, docs),
scored as (
  select item_id, doc_id, row_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::bigint as score
  from wanted join weights using (term) join postings using (term) join sizes using (row_id), total group by item_id, doc_id, row_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 50
""",
}
