"""SQL for DuckDB that gives the rows of the registered graph queries."""

from __future__ import annotations

MAIN = "select distinct l_orderkey::bigint src, l_partkey::bigint dst from lineitem where l_linenumber = 1"
CHAIN = "select distinct src, dst from (select l_partkey::bigint src, lead(l_partkey::bigint) over (partition by l_orderkey order by l_linenumber, l_partkey) dst from lineitem where l_quantity <= {}) where dst is not null"
MID, SPARSE = CHAIN.format(10), CHAIN.format(4)
SKEW = "select distinct l_partkey::bigint src, l_suppkey::bigint dst from lineitem"
HAND = "select * from (values (0::bigint, 1::bigint), (0, 2), (1, 0), (1, 2), (2, 2), (2, 3), (4, 5), (5, 6), (6, 4)) t(src, dst)"
WEIGHT = "(1 + (('0x' || substr(md5(least(src, dst) || '-' || greatest(src, dst)), 1, 8))::bigint % 102400))::bigint"
SYM = "s as (select src, dst from e where src <> dst union select dst, src from e where src <> dst)"
VERT = "v as (select src id from e union select dst from e)"
IN_DEGREE = "d as (select id, coalesce(n, 0)::bigint degree from v left join (select dst id, count(*) n from e group by dst) using (id))"
OUT_DEGREE = IN_DEGREE.replace("select dst id", "select src id").replace("group by dst", "group by src")
DENSE = "v as (select range::bigint id from range((select max(greatest(src, dst)) + 1 from e)))"
OFFSETS = "o as (select id, degree, coalesce(sum(degree) over (order by id rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from d)"
CC = "cc(id, component) using key (id) as (select id, id from v union select s.dst, min(cc.component) from cc join s on cc.id = s.src join recurring.cc r on r.id = s.dst where cc.component < r.component group by s.dst)"
SYM_DEGREE = "sd as (select id, coalesce(n, 0)::bigint degree from v left join (select src id, count(*) n from s group by src) using (id))"
HUB = "(select component from cc join sd using (id) order by degree desc, id limit 1)"
PAIRS = f"w as (select least(src, dst) a, greatest(src, dst) b, min({WEIGHT}) w from e where src <> dst group by all)"
KRUSKAL = """k as (select list_reduce(l, lambda acc, x: case when acc.lab[x.a + 1] = acc.lab[x.b + 1] then acc else struct_pack(a := x.a, b := x.b, w := x.w,
  lab := list_transform(acc.lab, lambda q: case when q = acc.lab[x.b + 1] then acc.lab[x.a + 1] else q end), tot := acc.tot + x.w,
  got := list_append(acc.got, struct_pack(a := x.a, b := x.b, w := x.w))) end,
  struct_pack(a := 0::bigint, b := 0::bigint, w := 0::bigint, lab := range(n), tot := 0::bigint, got := []::struct(a bigint, b bigint, w bigint)[])) r
  from (select list(struct_pack(a := a, b := b, w := w, lab := null::bigint[], tot := 0::bigint, got := null::struct(a bigint, b bigint, w bigint)[]) order by w, a, b) l, max(b) + 1 n from w))"""
FOREST = "f as (select u.a src, u.b dst, u.w weight from (select unnest(r.got) u from k))"
RANDOM = "m as (select id old_id, (row_number() over (order by md5('{}:' || id), id) - 1)::bigint new_id from v)"
BORDERS = """b as (select p, least(max(low - p) over (order by p rows unbounded preceding) + p, n)::bigint start_id from (
  select p, n, case when p = 0 then 0 else least(coalesce((select min(id) from o where "offset" + id >= p * share), n), n) end low
  from (select range::bigint p from range(64)), (select count(*) n, (sum(degree)::bigint + count(*)) // 64 share from o))),
  r as (select p, start_id, coalesce(lead(start_id) over (order by p), (select count(*) from o))::bigint end_id from b)"""


def over(edges: str, *parts: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}e as ({edges}), " + ", ".join(parts[:-1]) + " " + parts[-1]


ZERO = "select 0::bigint violations"
FOREST_SIDES = "select src, dst from f union all select dst, src from f"
BFS = [
    f"t as ({FOREST_SIDES})",
    "cc(id, component) using key (id) as (select id, id from v union select t.dst, min(cc.component) from cc join t on cc.id = t.src join recurring.cc r on r.id = t.dst where cc.component < r.component group by t.dst)",
    "td as (select id, coalesce(n, 0) degree from v left join (select src id, count(*) n from t group by src) using (id))",
    "h as (select component, arg_max(id, degree * 100000000000 - id) root from cc join td using (id) group by component)",
    "bfs(id, root, level) using key (id) as (select root, root, 0::bigint from h union select t.dst, any_value(bfs.root), min(bfs.level) + 1 from bfs join t on t.src = bfs.id left join recurring.bfs r on r.id = t.dst where r.id is null group by t.dst)",
]

ORACLES: dict[str, str] = {
    "scan_text_csr": HAND,
    "scan_compbin": HAND,
    "write_compbin": SPARSE,
    "cache_roundtrip": SPARSE,
    "fixed_random_ordering": over(SPARSE, VERT, RANDOM.format(1), "select * from m"),
    "graph_report": over(MAIN, VERT, "select 'main' dataset, (select count(*) from v) v, (select count(*) from e) e, (select max(n) from (select count(*) n from e group by src)) max_degree"),
    "graph_summary": f"select 'first' section, src, dst from (select * from ({MAIN}) order by src, dst limit 20) union all select 'last', src, dst from (select * from ({MAIN}) order by src desc, dst desc limit 20)",
    "format_si": over(MAIN, VERT, "x as (select 'vertices' as name, count(*) as value from v union all select 'edges', count(*) from e union all select 'e' || range, (rpad('1', (range + 1)::int, '0'))::bigint + 1 from range(19))", "select name, value, case when value > 1e18 then printf('%.1fE', value / 1e18) when value > 1e15 then printf('%.1fP', value / 1e15) when value > 1e12 then printf('%.1fT', value / 1e12) when value > 1e9 then printf('%.1fG', value / 1e9) when value > 1e6 then printf('%.1fM', value / 1e6) when value > 1e3 then printf('%.1fk', value / 1e3) else value::varchar end short from x"),
    "remove_self_edges": f"select * from ({SKEW}) where src <> dst",
    "count_self_edges": f"select count(*) self_edges from ({SKEW}) where src = dst",
    "drop_weights": MID,
    "add_weights": f"select src, dst, {WEIGHT} weight from ({MID})",
    "has_reverse_edge": f"with e as ({SKEW}) select src, dst from e where exists (select 1 from e r where r.src = e.dst and r.dst = e.src)",
    "edge_lookup": f"with e as ({SKEW}), l as (select src, dst, row_number() over (partition by src order by dst) - 1 i from e) select e.src, e.dst, coalesce(l.i, -1)::bigint idx from e left join l on l.src = e.dst and l.dst = e.src",
    "out_degree": over(SKEW, VERT, OUT_DEGREE, "select * from d"),
    "in_degree": over(SKEW, VERT, IN_DEGREE, "select * from d"),
    "max_degree": over(SKEW, VERT, IN_DEGREE, "select max(degree) max_degree from d"),
    "max_degree_vertex": over(SKEW, VERT, IN_DEGREE, "select id, degree from d order by degree desc, id limit 1"),
    "degree_histogram": over(SKEW, VERT, IN_DEGREE, "select degree, count(*) n_vertices from d group by degree"),
    "degree_stddev": over(SKEW, VERT, IN_DEGREE, "select round(stddev_pop(degree), 6) stddev from d"),
    "csr_offsets": over(MAIN, DENSE, OUT_DEGREE, OFFSETS, 'select id, "offset" from o'),
    "edge_partitioning": over(MAIN, DENSE, OUT_DEGREE, OFFSETS, BORDERS, "select * from r"),
    "partition_imbalance": over(MAIN, DENSE, OUT_DEGREE, OFFSETS, BORDERS, "c as (select p, coalesce(sum(degree), 0)::bigint n from r left join d on id >= start_id and id < end_id group by p)", "select round(100 * sqrt(floor(floor(sum((top - n) ** 2)) / count(*))) / any_value(top), 6) imbalance from c, (select max(n) top from c)"),
    "degree_ordering": over(SKEW, VERT, IN_DEGREE, "select (row_number() over (order by degree desc, id) - 1)::bigint new_id, id old_id, degree from d"),
    "topk_hubs": over(SKEW, VERT, IN_DEGREE, "select id, degree from d order by degree desc, id limit 100"),
    "sorted_adjacency": f"select src, (row_number() over (partition by src order by dst) - 1)::bigint pos, dst from ({SKEW})",
    "random_ordering": over(MID, VERT, RANDOM.format(1), "select * from m"),
    "relabel_graph": over(MID, VERT, RANDOM.format(1), "select a.new_id src, b.new_id dst from e join m a on a.old_id = src join m b on b.old_id = dst"),
    **{f"validate_{x}": ZERO for x in ("relabeling", "degree_ordering", "transpose", "symmetrize", "cc", "msf")},
    "transpose": f"select dst src, src dst from ({SKEW})",
    "transpose_skew": f"select dst src, src dst from ({SKEW})",
    "symmetrize": over(SKEW, SYM, "select * from s"),
    "symmetrize_keep_self": f"with e as ({SKEW}) select src, dst from e union select dst, src from e",
    "transform_pipeline": f"with e as ({SKEW}), s as (select src, dst from e union select dst, src from e) select count(*) edges, count(*) filter (src = dst) self_edges, count(distinct src) sources, 0::bigint lo, count(distinct src) - 1 hi from s",
    "cc_min_label": over(MAIN, VERT, SYM, CC, "select id, component from cc", recursive=True),
    "pointer_jump": over(MAIN, VERT, SYM, "p as (select id, least(id, coalesce(n, id)) c from v left join (select src id, min(dst) n from s group by src) using (id))", "j(id, x) as (select id, c from p union select j.id, p.c from j join p on p.id = j.x where p.c <> p.id)", "select id, min(x) root from j group by id", recursive=True),
    "cc_count": over(MAIN, VERT, SYM, CC, "select count(distinct component) components from cc", recursive=True),
    "component_sizes": over(MAIN, VERT, SYM, CC, "select component, count(*) as \"size\" from cc group by component", recursive=True),
    "component_hubs": over(MAIN, VERT, SYM, SYM_DEGREE, CC, "select component, arg_max(id, degree * 100000000000 - id) hub, max(degree) degree from cc join sd using (id) group by component", recursive=True),
    "cc_thrifty": over(MAIN, VERT, SYM, SYM_DEGREE, CC, f"select id, (case when component = {HUB} then 0 else component + 1 end)::bigint component from cc", recursive=True),
    "cc_thrifty_weighted": over(MID, VERT, SYM, SYM_DEGREE, CC, f"select id, (case when component = {HUB} then 0 else component + 1 end)::bigint component from cc", recursive=True),
    "lightest_edge": over(MID, PAIRS, "x as (select a c, a, b, w from w union all select b, a, b, w from w)", "select c component, a src, b dst, w weight from x qualify row_number() over (partition by c order by w, a, b) = 1"),
    "msf_boruvka": over(MID, PAIRS, KRUSKAL, FOREST, "select * from f"),
    "msf_edges": over(SPARSE, PAIRS, KRUSKAL, FOREST, "select * from f"),
    "msf_summary": over(MID, PAIRS, KRUSKAL, "select len(r.got)::bigint edges, r.tot weight from k"),
    "msf_weight_check": over(MAIN, PAIRS, KRUSKAL.replace(",\n  got := list_append(acc.got, struct_pack(a := x.a, b := x.b, w := x.w))", ", got := acc.got"), "select r.tot weight from k"),
    "forest_to_graph": over(SPARSE, PAIRS, KRUSKAL, FOREST, FOREST_SIDES),
    "forest_bfs": over(SPARSE, VERT, PAIRS, KRUSKAL, FOREST, *BFS, "select * from bfs", recursive=True),
    "aid_by_degree": over(MAIN, SYM, "a as (select count(*) degree, (max(dst) - min(dst)) // count(*) aid from s group by src having count(*) >= 2)", "select degree, count(*) n_vertices, round(sum(aid) / count(*), 6) mean_aid from a group by degree"),
    "aid_by_degree_relabeled": over(MAIN, VERT, SYM, RANDOM.format(1), "a as (select count(*) degree, (max(new_id) - min(new_id)) // count(*) aid from s join m on old_id = dst group by src having count(*) >= 2)", "select degree, count(*) n_vertices, round(sum(aid) / count(*), 6) mean_aid from a group by degree"),
    "triangle_count": over(MID, SYM, "select count(*) triangles from s a join s b on a.dst = b.src and a.src < a.dst and b.src < b.dst join s c on c.src = a.src and c.dst = b.dst"),
    "spmv": over(MID, VERT, "select id, coalesce(y, 0)::bigint y from v left join (select dst id, sum(src % 7) y from e group by dst) using (id)"),
}
M = "18446744073709551616::uhugeint"
ORACLES["prng_splitmix64"] = f"""with a as (select range::bigint n, (42::uhugeint + (range + 1)::uhugeint * 11400714819323198485::uhugeint) % {M} z from range(1000)),
b as (select n, (xor(z::ubigint, (z::ubigint >> 30))::uhugeint * 13787848793156543929::uhugeint) % {M} z from a),
c as (select n, (xor(z::ubigint, (z::ubigint >> 27))::uhugeint * 10723151780598845931::uhugeint) % {M} z from b)
select n, lower(lpad(to_hex(xor(z::ubigint, (z::ubigint >> 31))), 16, '0')) word from c"""
ORACLES["cc_pointer_jump"] = ORACLES["cc_min_label"]
ORACLES["degree_ordering_counting"] = ORACLES["degree_ordering"]
ORACLES |= {
    "validate_relabeling_spoilt": over(MID, VERT, "n as (select count(*) n, count(distinct (id_ - 1) // 2) d, max((id_ - 1) // 2) hi from (select row_number() over () id_ from v))", "select ((d <> n)::bigint + (hi <> n - 1)::bigint)::bigint violations from n"),
    "validate_degree_ordering_spoilt": over(MID, VERT, IN_DEGREE, "o as (select degree, lag(degree) over (order by degree, id desc) before from d)", "select count(*) violations from o where degree > before"),
    "validate_transpose_spoilt": over(MID, "select count(*) violations from e where dst % 10 = 0"),
    "validate_symmetrize_spoilt": over(MID, SYM, "select 2 * count(*) violations from s where src < dst and src % 7 = 0"),
    "validate_cc_spoilt": over(MID, VERT, SYM, CC, "p as (select distinct component a, id % 2 b from cc)", "select ((select count(*) from (select a from p group by a having count(*) > 1)) + (select count(*) from (select b from p group by b having count(*) > 1)))::bigint violations", recursive=True),
    "validate_msf_spoilt": over(MID, PAIRS, KRUSKAL, FOREST, "select count(*) filter (src % 5 = 0) > 0 as found from f"),
    "sampled_hot_vertices": over(SKEW, VERT, "select dst id, count(*) sampled from e where ('0x' || substr(md5('hot:' || src || '-' || dst), 1, 8))::bigint < least(1.0::double, 0.05::double * (select count(*) from v) / (select count(*) from e)) * 4294967296::double group by dst"),
    # in the order of the hashes, what has no chosen neighbour before it is chosen
    "maximal_independent_set": over(MID, VERT, SYM, "h as (select id, md5('mis:' || id) || id::varchar h from v)", "b as (select a.id id, c.id before from s join h a on a.id = s.src join h c on c.id = s.dst where c.h < a.h)",
        "m(id, chosen) using key (id) as (select id, true from v where id not in (select id from b) union select b.id, not bool_or(r.chosen) from b join recurring.m r on r.id = b.before where b.id not in (select id from recurring.m) group by b.id having count(*) = (select count(*) from b x where x.id = b.id))",
        "select id from m where chosen", recursive=True),
    "maximal_matching": over(MID, SYM, "p as (select src, dst, md5('match:' || src || '-' || dst) || '-' || src || '-' || dst h from s where src < dst)",
        "b as (select distinct a.h h, c.h before from p a join p c on c.h < a.h and (c.src in (a.src, a.dst) or c.dst in (a.src, a.dst)))",
        "m(h, chosen) using key (h) as (select h, true from p where h not in (select h from b) union select b.h, not bool_or(r.chosen) from b join recurring.m r on r.h = b.before where b.h not in (select h from recurring.m) group by b.h having count(*) = (select count(*) from b x where x.h = b.h))",
        "select src, dst from m join p using (h) where chosen", recursive=True),
}
