"""SQL for DuckDB that gives the rows of those corpus queries that SQL can express.

The fingerprints (XXH64), the learned models, code-point spans and byte strings are beyond it; those queries are
tested against brute-force versions, checksums of all segmentations and held-out accuracy.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""with b as (select coalesce(item_id::varchar, 'null') item, {WORDS} ws from benchmark),
bl as (select item, ws, least(len(ws), 10) n from b where len(ws) > 0),
g as (select distinct item, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda p: array_to_string(ws[p:p + n - 1], ' '))) gram from bl),
d as (select row_number() over () rid, doc_id, {WORDS} ws from documents),
w as (select rid, n, unnest(range(1, len(ws) - n + 2)) p, unnest(list_transform(range(1, len(ws) - n + 2), lambda q: array_to_string(ws[q:q + n - 1], ' '))) gram
  from d, (select distinct n from g) where len(ws) >= n),
h as (select rid, p, w.n, item from w join g on w.gram = g.gram and w.n = g.n),
c as (select rid, count(*) n_hit from (select distinct rid, unnest(range(p, p + n)) pos from h) group by rid),
i as (select rid, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct rid, item from h) group by rid)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join c using (rid) left join i using (rid)"""

MIX = r"""with r as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(text, '')) k from documents),
k as (select *, ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null') || ':' || k), 1, 8))::bigint % greatest(1, ceil((select count(*) from r) / 512)::bigint) as chunk from r),
s as (select source, sum(size)::bigint source_size, [5.0::double, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1] weight from k group by source),
l as (select *, source_size * 3.0::double cap, row_number() over o nr, cap / weight ratio,
    (sum(source_size) over ()::double - coalesce(sum(cap) over (order by source_size * 3.0::double / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by source_size * 3.0::double / weight, source nulls last rows between current row and unbounded following) as level
  from s window o as (order by source_size * 3.0::double / weight, source nulls last)),
y as (select source, source_size, least(cap, coalesce((select arg_min(level, nr) from l where level <= ratio) * weight, cap)) target from l),
t as (select *, case when source_size > 0 then target / source_size else 0 end rate from y),
c as (select source, chunk, coalesce(sum(count(*)) over (partition by source order by chunk rows between unbounded preceding and 1 preceding), 0)::bigint base from k group by source, chunk),
p as (select k.doc_id, k.source, k.size, t.source_size, t.target, t.rate, c.base + row_number() over (partition by k.source, k.chunk order by k.size, k.doc_id nulls first, k.k) nr
  from k join c on k.source is not distinct from c.source and k.chunk = c.chunk join t on k.source is not distinct from t.source),
u as (select source, ('0x' || substr(md5('mix:' || coalesce(source, 'null')), 1, 8))::bigint / 4294967296::double u from s)
select doc_id, size, source_size, target, (size * (floor(nr * rate + u) - floor((nr - 1) * rate + u)))::bigint taken from p join u on p.source is not distinct from u.source"""

EMBED = """with recursive e as (select vec_id id, embedding::double[] x from embeddings where vec_id is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(embedding, lambda v: v <> 0)) > 0),
s as (select a.id src, b.id dst from e a join e b on a.id <> b.id and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.95),
v as (select distinct vec_id id from embeddings),
cc(id, component) using key (id) as (select id, id from v union select s.dst, min(cc.component) from cc join s on cc.id = s.src join recurring.cc r on r.id = s.dst where cc.component < r.component group by s.dst)
select vec_id, coalesce(n, 0) n_links, component component_id, vec_id = component kept
from embeddings join cc on id = vec_id left join (select src, count(*) n from s group by src) on src = vec_id"""

LINES = r"""with d as (select row_number() over () rid, doc_id, text, string_split(text, chr(10)) ls from documents),
l as (select rid, text k, len(list_filter(ls, lambda x: trim(x) <> '')) = 1 alone, unnest(range(len(ls))) pos, unnest(ls) line from d where text is not null),
q as (select rid, k, alone, pos, regexp_split_to_array(trim(line), '\s+') raw from l),
m as (select rid, k, alone, pos, case when len(list_filter(raw, lambda t: not regexp_matches(t, '[0-9]'))) * 2 >= len(raw)
  then list_transform(raw, lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) else raw end tokens from q),
f as (select rid, k, alone, pos, tokens, len(tokens) n, tokens[1:3] lead, case when len(tokens) >= 50 then 3 else 8 end need from m where len(tokens) >= 3),
v as (select n, lead, count(distinct k) texts from f group by n, lead, need having count(distinct k) >= need and count(distinct tokens) > 1),
x as (select n, lead, need, k, unnest(range(n)) i, unnest(tokens) token from f semi join v using (n, lead)),
w as (select n, lead, i, token, count(distinct k) weight from x where i >= 3 group by n, lead, need, i, token having count(distinct k) >= need),
s as (select distinct tokens, n, lead, texts from f join v using (n, lead)),
c as (select tokens, n, lead, unnest(range(n)) i, unnest(tokens) token from s),
h as (select tokens, list(struct_pack(i := i, token := token, weight := weight) order by i) held, list(weight order by weight desc) ws from c join w using (n, lead, i, token) group by tokens),
e as (select s.tokens, n, lead, held, case when ceil(n * 0.7) <= 3 then texts else ws[(ceil(n * 0.7) - 3)::int] end low from s left join h using (tokens)),
g as (select tokens, array_to_string(list_concat([n::varchar], lead, list_transform(list_filter(coalesce(held, []), lambda y: y.weight >= low), lambda y: y.i || ':' || y.token)), ' ') name from e where low is not null),
t as (select rid, f.k, alone, pos, n, need, ('0x' || substr(md5(coalesce(name, array_to_string(f.tokens, ' '))), 1, 15))::bigint as template from f left join g using (tokens)),
o as (select template, count(distinct k) texts from t group by template, need having count(distinct k) >= need),
r as (select t.*, o.texts from t left join o using (template)),
p as (select k, any_value(alone) alone, count(distinct template) filter (texts is not null) > 1 and sum(n) filter (texts is not null) > sum(n) * 0.8 as copied, min(struct_pack(texts := texts, template := template)) filter (texts is not null) rarest from r group by k),
z as (select distinct r.template, need, case when copied then 'copies ' || rarest.template else 'text ' || r.k end witness from r join p using (k) where texts is not null and not p.alone),
u as (select template from z group by template, need having count(*) >= need),
gone as (select rid, list(pos) gone from t semi join u using (template) group by rid)
select doc_id, coalesce(len(ls), 0)::bigint n_lines, coalesce(len(gone), 0)::bigint n_dropped,
  case when gone is null then text else array_to_string(list_filter(ls, lambda x, i: not list_contains(gone, i - 1)), chr(10)) end as text from d left join gone using (rid)"""

ORACLES: dict[str, str] = {
    "op1_decontaminate": DECONTAMINATE,
    "op2_mix": MIX,
    "op5_embed_dedup": EMBED,
    "op10_line_dedup": LINES,
}
