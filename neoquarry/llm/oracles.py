"""SQL that gives the rows of the queries SQL can express."""

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = r"""
with item_words as (
  select item_id, regexp_extract_all(LOW_TEXT, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null
), windows as (
  select distinct item_id, array_to_string(w[i:i + 9], ' ') as k, least(10, len(w)) as size
  from (select item_id, w, unnest(range(1, greatest(2, len(w) - 8))) as i from item_words where len(w) > 0)
), doc_words as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(coalesce(LOW_TEXT, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), places as (
  select r, w, unnest(range(1, len(w) + 1)) as i from doc_words where len(w) > 0
), found as (
  select p.r, p.i, x.item_id, x.size
  from (select distinct size from windows) s
  join places p on p.i + s.size - 1 <= len(p.w)
  join windows x on x.size = s.size and x.k = array_to_string(p.w[p.i:p.i + s.size - 1], ' ')
), hits as (
  select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + size)) as p from found) group by r
), listed as (
  select r, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct r, cast(item_id as varchar) as id from found where item_id is not null) group by r
)
select d.doc_id, len(d.w) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(l.n_items, 0) as n_items,
       sha256(coalesce(l.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from doc_words d left join hits h using (r) left join listed l using (r)
""".replace("LOW_TEXT", _LOW.format("text"))

OP10 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, t, r, '<|im_end|><|im_start|>assistant ok' from (values (0, 'user'), (1, 'assistant')) v(t, r)
), marked as (
  select *, length('<|im_start|>') + length('<|im_end|>') + 2
    + length(replace(replace(replace(role, '\', '\\'), '<', '\<'), chr(10), '\' || chr(10)))
    + length(replace(replace(text, '\', '\\'), '<', '\<')) as chars,
    lag(role) over (partition by conv_id order by turn, role, text) as before
  from turns
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars,
       count(*) filter (not case when before is null then role in ('system', 'user')
                            when before in ('system', 'assistant') then role = 'user'
                            when before = 'user' then role = 'assistant' else false end) as n_broken
from marked group by conv_id
"""

OP12 = r"""
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), sources as (
  select *, [1.0, 2.0, 3.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as weight
  from (select source, sum(size)::bigint as source_size from docs group by source)
), steps as (
  select *, row_number() over (order by 3 * source_size / weight, source nulls last) as k,
    ((select sum(source_size) from sources) - coalesce(sum(3 * source_size) over (
       order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by 3 * source_size / weight, source nulls last rows between current row and unbounded following) as level
  from sources
), fair as (
  select min_by(level, k) as level from steps where 3 * source_size >= level * weight
), goals as (
  select source, source_size, weight, least(3.0 * source_size, level * weight)::double as target from sources, fair
), laid as (
  select d.*, g.source_size, g.weight, g.target, floor(g.target)::bigint as due,
    coalesce(sum(size) over (partition by d.source order by md5(coalesce(doc_id::varchar, '')), doc_id nulls last, size
      rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from docs d join goals g on d.source is not distinct from g.source
)
select doc_id, size, source_size, target,
  (greatest(least(start + size, due) - start, 0)
   + greatest(least(start + source_size + size, due) - start - source_size, 0)
   + greatest(least(start + 2 * source_size + size, due) - start - 2 * source_size, 0))::bigint as taken,
  case when start < due and size > 0 then round(case
    when start = 0 then 0.0
    when weight = 1 then 2 * (start::double / due) / (1.5 + sqrt(2.25 - 2 * (start::double / due)))
    when weight = 2 then 2 * (start::double / due * 2) / (2 + sqrt(4.0::double))
    else 2 * (start::double / due * 3) / (2 + sqrt(4 + 4 * (start::double / due * 3))) end, 9) end as first_position
from laid
"""

OP11 = """
with kept as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select a.vec_id as anchor_id, r.vec_id, r.label = a.label as same,
         list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2]))::bigint as score
  from kept a join kept r on a.vec_id % 100 = 0 and r.vec_id <> a.vec_id
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, p.positive_score, n.vec_id as negative_id, n.score as negative_score,
       (row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id))::int as rank
from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same
  and 80 * p.positive_score <= 100 * n.score and 100 * n.score <= 100 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id) <= 5
"""

def _op13(rounds: int = 2) -> str:
    """Lloyd's rounds one after the other; entries that no part is nearest to stay."""
    nearest = """
near{k} as materialized (
  select vec_id, label, part, min_by(entry, (d, entry)) as entry, min(d) as d from (
    select v.vec_id, v.label, v.part, e.entry,
      list_sum(list_transform(list_zip(v.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from cut v join book{k} e using (part))
  group by vec_id, label, part
)"""
    moved = """
book{n} as materialized (
  select b.part, b.entry, coalesce(m.v, b.v) as v from book{k} b left join (
    select part, entry, list(((s - ((s % n) + n) % n) / n)::bigint order by i) as v from (
      select c.part, a.entry, u.i, sum(c.v[u.i])::bigint as s, count(*) as n
      from near{k} a join cut c using (vec_id, part), lateral (select unnest(range(1, len(c.v) + 1)) as i) u
      group by c.part, a.entry, u.i)
    group by part, entry) m using (part, entry)
)"""
    steps = [nearest.format(k=0)]
    for k in range(rounds):
        steps += [moved.format(k=k, n=k + 1), nearest.format(k=k + 1)]
    return """
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), cut as materialized (
  select vec_id, label, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] as v
  from kept, (select unnest(range(16)) as part)
), book0 as materialized (
  select part, row_number() over (partition by part order by vec_id) - 1 as entry, v
  from cut where vec_id in (select vec_id from kept order by vec_id limit 64)
), STEPS, found as (
  select vec_id, label, string_agg(printf('%02x', entry::int), '' order by part) as code, sum(d)::bigint as error
  from nearLAST group by vec_id, label
), numbers as (
  select part, entry, unnest(v) as x, unnest(range(len(v))) as i from bookLAST
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
  (select sha256(string_agg(x::varchar, ',' order by part, entry, i)) from numbers) as codebooks_sha256
from found
""".replace("STEPS", ",".join(steps)).replace("LAST", str(rounds))


ORACLES = {"op13_vector_codes": _op13(), "op11_hard_negatives": OP11, "op10_chat": OP10, "op12_mixture": OP12, "op2_decontamination": OP2}
