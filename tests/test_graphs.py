"""Graph operators on small graphs: a hand-made one with known answers, and random ones against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.graphs import HAND_TEXT, Graph
from graphloom.operators import components, contraction, degrees, forest, kernels, locality, numbering, ordering, partitioning, transform
from graphloom.sources import binary_csr, tables, text_csr

HAND = [(0, 1), (0, 2), (1, 0), (1, 2), (2, 2), (2, 3), (4, 5), (5, 6), (6, 4)]


def pairs(df):
    return sorted(tuple(r) for r in df.select("src", "dst").collect())


def graph(spark, edges, n=None):
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    return Graph.dense(df, n)


@pytest.fixture(scope="module")
def hand(spark):
    return graph(spark, HAND, 8)


def find_all(n, edges):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(n)}


def random_edges(seed, n=30, m=25):
    rng = random.Random(seed)
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    return sorted(edges | {(b, a) for a, b in list(edges)[::4]})


GRAPHS = {
    "empty": (5, []),
    "one vertex": (1, [(0, 0)]),
    "star": (20, [(7, i) for i in range(20)]),
    "path": (200, [(i, i + 1) for i in range(199)]),
    "shuffled path": (101, [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)]),
    "random": (30, random_edges(1)),
    "dense": (12, random_edges(2, 12, 90)),
}


@pytest.mark.parametrize("tail", ["", "\n"])
def test_text(spark, tmp_path, tail):
    (tmp_path / "g.txt").write_text(HAND_TEXT + tail)
    g = text_csr.scan(spark, str(tmp_path / "g.txt"))
    assert pairs(g.edges) == HAND and g.vertices.count() == 8


def test_text_in_splits(spark, tmp_path):
    n, rng = 3000, random.Random(4)
    edges = sorted((rng.randrange(n), rng.randrange(n)) for _ in range(9000))
    degree = Counter(a for a, _ in edges)
    offsets, total = [], 0
    for v in range(n):
        offsets.append(total)
        total += degree[v]
    (tmp_path / "g.txt").write_text(f"{n}\n{len(edges)}\n{' '.join(map(str, offsets))}\n{' '.join(str(b) for _, b in edges)}\n")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert pairs(text_csr.scan(spark, str(tmp_path / "g.txt")).edges) == edges
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


@pytest.mark.parametrize("text", ["2\n1\n0 1\nx\n", "2\n2\n0 1\n1\n", "2\n1\n0 -1\n1\n", ""])
def test_bad_text_raises(spark, tmp_path, text):
    (tmp_path / "g.txt").write_text(text)
    with pytest.raises(Exception):  # noqa: B017, PT011
        text_csr.scan(spark, str(tmp_path / "g.txt")).edges.collect()


def test_binary(spark, tmp_path, hand):
    binary_csr.write(hand, str(tmp_path / "hand"))
    props = dict(x.split(":") for x in (tmp_path / "hand_props.txt").read_text().split())
    assert props == {"vertices-count": "8", "edges-count": "9", "bytes-per-vertex-ID-in-edges-file": "4", "offsets-file": "hand_offsets.bin", "edges-file": "hand_edges.bin"}
    assert (tmp_path / "hand_offsets.bin").stat().st_size == 72 and (tmp_path / "hand_edges.bin").stat().st_size == 36
    back = binary_csr.scan(spark, str(tmp_path / "hand"))
    assert pairs(back.edges) == HAND and back.vertices.count() == 8


def test_tables(spark, tmp_path, hand):
    assert pairs(tables.cache(hand).edges) == HAND
    a, b = (sorted(map(tuple, tables.fixed_random_ordering(hand, "hand", 2).collect())) for _ in range(2))
    assert a == b and sorted(x for _, x in a) == list(range(8))
    rows = tables.report(hand, "hand")
    for _ in range(2):
        tables.append_report(rows, str(tmp_path / "report"))
    assert [tuple(r) for r in tables.read_report(spark, str(tmp_path / "report"), "dataset string, v bigint, e bigint, max_degree bigint").collect()] == [("hand", 8, 9, 2)] * 2


def test_known_answers(spark, hand):
    in_degree = degrees.in_degree(hand)
    assert {r.id: r.degree for r in in_degree.collect()} == dict(enumerate([1, 1, 3, 1, 1, 1, 1, 0]))
    order = ordering.degree_ordering(in_degree)
    assert [r.old_id for r in order.orderBy("new_id").collect()] == [2, 0, 1, 3, 4, 5, 6, 7]
    assert sorted(map(tuple, order.collect())) == sorted(map(tuple, ordering.degree_ordering_counting(in_degree).select(order.columns).collect()))
    assert [r.offset for r in partitioning.offsets(Graph(transform.transpose(hand.edges), hand.vertices)).orderBy("id").collect()] == [0, 1, 2, 5, 6, 7, 8, 9]
    assert transform.count_self_edges(hand.edges).first()[0] == 1
    assert transform.symmetrize(hand.edges).count() == 14 and transform.symmetrize(hand.edges, False).count() == 15
    assert {r.id: r.component for r in components.cc_zero_hub(hand).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 5, 5: 5, 6: 5, 7: 8}
    weighted = transform.add_weights(hand.edges)
    assert sorted(map(tuple, forest.boruvka(weighted).collect())) == [(0, 2, 19121), (1, 2, 707), (2, 3, 36917), (4, 5, 5238), (5, 6, 34142)]
    assert {r.degree: (r.n_vertices, r.mean_aid) for r in locality.aid_by_degree(hand.edges).collect()} == {2: (3, 0.333333)}
    assert {r.degree: r.mean_aid for r in locality.aid_by_degree(transform.symmetrize(hand.edges)).collect()} == {2: 0.4, 3: 1.0}
    mapping = {r.old_id: r.new_id for r in ordering.random_ordering(hand.vertices).collect()}
    assert [mapping[i] for i in range(8)] == [1, 4, 6, 0, 7, 5, 2, 3]
    assert [(r.start_id, r.end_id) for r in partitioning.edge_partitioning(hand, 2).orderBy("p").collect()] == [(0, 4), (4, 8)]


@pytest.mark.parametrize("name", GRAPHS)
def test_components_and_forest(spark, name):
    n, edges = GRAPHS[name]
    g = graph(spark, edges, n)
    want = find_all(n, edges)
    assert {r.id: r.component for r in components.cc_min_label(g).collect()} == want
    assert {r.id: r.component for r in components.cc_pointer_jump(g).collect()} == want
    weighted = Graph(transform.add_weights(g.edges), g.vertices, weighted=True)
    found = forest.boruvka(weighted.edges)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == n - len(set(want.values()))
    assert sum(w for *_, w in rows) == forest.weight_by_kruskal([tuple(r) for r in weighted.edges.collect()])
    assert forest.violations(weighted, found).first()[0] == 0
    assert components.labelling_violations(components.cc_min_label(g), components.cc_zero_hub(g)).first()[0] == 0


@pytest.mark.parametrize("name", ["random", "dense", "star", "path"])
def test_equal_weights_and_levels(spark, name):
    n, edges = GRAPHS[name]
    g = graph(spark, edges, n)
    found = forest.boruvka(g.edges.withColumn("weight", F.lit(1).cast("long")))
    assert found.count() == n - len(set(find_all(n, edges).values()))
    levels = {r.id: (r.root, r.level) for r in forest.bfs(g, found).collect()}
    near = defaultdict(set)
    for a, b, _ in found.collect():
        near[a].add(b)
        near[b].add(a)
    assert len(levels) == n
    for v, (root, level) in levels.items():
        assert (v == root) == (level == 0)
        assert level == 0 or sum(levels[u] == (root, level - 1) for u in near[v]) == 1


def test_violations_are_found(spark, hand):
    edges = hand.edges
    assert transform.transpose_violations(edges, transform.transpose(edges).where("src <> 3")).first()[0] == 1
    assert transform.symmetrize_violations(edges, transform.symmetrize(edges).where("src <> 3")).first()[0] > 0
    mapping = ordering.random_ordering(hand.vertices)
    assert ordering.relabelling_violations(mapping.withColumn("new_id", F.col("new_id") * 2), hand.vertices).first()[0] > 0
    order = ordering.degree_ordering(degrees.in_degree(hand))
    assert ordering.ordering_violations(order.withColumn("new_id", 7 - F.col("new_id"))).first()[0] > 0
    labels = components.cc_pointer_jump(hand)
    assert components.labelling_violations(labels, labels.withColumn("component", F.lit(0))).first()[0] > 0
    weighted = Graph(transform.add_weights(edges), hand.vertices, weighted=True)
    tree = forest.boruvka(weighted.edges)
    assert forest.violations(weighted, tree.where("src > 0")).first()[0] > 0
    assert forest.violations(weighted, tree.withColumn("weight", F.col("weight") + 1)).first()[0] > 0


def test_laws(spark):
    edges = random_edges(3, 20, 60) + [(1, 2), (1, 2), (4, 4)]
    g = graph(spark, edges, 20)
    assert pairs(transform.transpose(transform.transpose(g.edges))) == sorted(edges)
    assert pairs(transform.transpose_lists(g.edges, hot=2)) == sorted((b, a) for a, b in edges)
    once = transform.symmetrize(g.edges)
    assert pairs(transform.symmetrize(once)) == pairs(once)
    mapping = ordering.random_ordering(g.vertices, "9", 3)
    of = {r.old_id: r.new_id for r in mapping.collect()}
    assert pairs(ordering.relabel(g.edges, mapping)) == sorted((of[a], of[b]) for a, b in edges)
    moved = Graph(ordering.relabel(g.edges, mapping), g.vertices)
    sizes = [sorted(r["size"] for r in components.component_sizes(components.cc_pointer_jump(x)).collect()) for x in (g, moved)]
    assert sizes[0] == sizes[1]
    seen = []
    ordering.random_ordering(g.vertices, "9", 3, lambda m, i: seen.append(i))
    assert seen == [0, 1, 2]
    done = transform.transform_pipeline(g, symmetric=True)
    assert done.symmetric and pairs(done.edges) == pairs(transform.symmetrize(g.edges, False))
    assert pairs(transform.transform_pipeline(done, transposed=True).edges) == pairs(done.edges)
    with pytest.raises(ValueError, match="exclude"):
        transform.transform_pipeline(g, transposed=True, symmetric=True)
    assert [r.idx for r in transform.edge_lookup(graph(spark, HAND, 8).edges).orderBy("src", "dst").collect()] == [0, -1, 0, -1, 0, -1, -1, -1, -1]


@pytest.mark.parametrize("parts", [1, 3, 7, 40])
def test_edge_partitioning(spark, parts):
    n, edges = 60, sorted({(random.Random(i).randrange(60) ** 2 // 60, i % 60) for i in range(300)})
    g = graph(spark, edges, n)
    rows = partitioning.edge_partitioning(g, parts).orderBy("p").collect()
    assert [r.p for r in rows] == list(range(parts)) and rows[0].start_id == 0 and rows[-1].end_id == n
    assert all(a.end_id == b.start_id for a, b in zip(rows, rows[1:], strict=False))
    if n > 4 * parts:
        share, offset, borders = (len(edges) + n) // parts, [sum(a < v for a, _ in edges) for v in range(n)], [0]
        for t in range(1, parts):
            low = next((v for v in range(n) if offset[v] + v >= t * share), n)
            borders.append(min(max(low, borders[-1] + 1), n))
        assert [r.start_id for r in rows] == borders
    assert partitioning.partition_imbalance(g, partitioning.edge_partitioning(g, parts)).first()[0] >= 0


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.col("id").alias("v"))
    rows = numbering.numbered(df, [F.desc("x")], "n").collect()
    assert len(rows) == 1000 and all(r.n == 999 - r.x for r in rows)
    sums = numbering.running_sum(df, [F.asc("x")], "x", "s").collect()
    assert all(r.s == r.x * (r.x - 1) // 2 for r in sums)
    assert numbering.numbered(df.where("x < 0"), [F.asc("x")], "n").count() == 0


def test_kernels(spark):
    n, edges = 25, random_edges(5, 25, 90)
    g = graph(spark, edges, n)
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    assert kernels.triangle_count(g.edges).first()[0] == sum(b in near[a] and c in near[b] and c in near[a] for a in range(n) for b in range(a) for c in range(b))
    chosen = {r.id for r in kernels.maximal_independent_set(g).collect()}
    assert all((v in chosen) != bool(near[v] & chosen) for v in range(n))
    matched = [tuple(r) for r in kernels.maximal_matching(g).collect()]
    ends = Counter(x for p in matched for x in p)
    assert all(k == 1 for k in ends.values()) and all(a == b or a in ends or b in ends for a, b in edges)
    assert {r.id: r.y for r in kernels.spmv(g, g.vertices.withColumn("x", F.col("id"))).collect()} == {v: sum(a for a, b in edges if b == v) for v in range(n)}
    hot = degrees.sampled_hot_vertices(g, 1.0).collect()
    assert sum(r.sampled for r in hot) <= len(edges)


def test_contraction_ignores_loops_repeats_and_nulls(spark):
    rows = [(5, 3), (3, 5), (5, 3), (9, 9), (None, 4), (8, None), (3, 1)]
    df = spark.createDataFrame(rows, "src bigint, dst bigint")
    assert {r.id: r.component for r in contraction.connected_components(df).collect()} == {1: 1, 3: 1, 5: 1}


def test_generators():
    import numpy as np

    from graphloom.functions import prng

    # Published first outputs: splitmix64 of seed 1234567, and the other two by a plain version on Python numbers.
    state = np.array([1234567, (1234567 + prng.GAMMA) % 2**64], np.uint64)
    assert prng.splitmix64(state).tolist() == [6457827717110365317, 3203168211198807973]
    m = 2**64 - 1
    rot = lambda x, k, w: ((x << k) | (x >> (w - k))) & (2**w - 1)
    s, v = [1, 2, 3, 4], np.array([[1, 2, 3, 4]], np.uint64)
    a, u = [5, 6], np.array([[5, 6]], np.uint32)
    for _ in range(50):
        want = (rot((s[0] + s[3]) & m, 23, 64) + s[0]) & m
        t = (s[1] << 17) & m
        s[2] ^= s[0]
        s[3] ^= s[1]
        s[1] ^= s[2]
        s[0] ^= s[3]
        s[2] ^= t
        s[3] = rot(s[3], 45, 64)
        got, v = prng.xoshiro256(v)
        assert got[0] == want and v[0].tolist() == s
        want = a[0] * prng.STAR % 2**32
        b = a[0] ^ a[1]
        a = [rot(a[0], 26, 32) ^ b ^ (b << 9) % 2**32, rot(b, 13, 32)]
        got, u = prng.xoroshiro64star(u)
        assert got[0] == want and u[0].tolist() == a


def test_batch(spark, tmp_path, hand):
    from graphloom.plans.batch import run_all

    more = graph(spark, [(0, 1)], 3)
    run_all({"hand": hand, "small": more}, components.cc_pointer_jump, str(tmp_path / "r"))
    run_all({"hand": hand, "small": more}, components.cc_pointer_jump, str(tmp_path / "one"), skip=1, most=1)
    read = lambda p: sorted((r.dataset, r.v, r.e) for r in tables.read_report(spark, str(tmp_path / p), "dataset string, v bigint, e bigint, time_ms bigint").collect())
    assert read("r") == [("hand", 8, 9), ("small", 3, 1)] and read("one") == [("hand", 8, 9)]


def broadcast_rows(spark, since):
    """The rows of every table that the driver collected to broadcast, in executions from ``since`` on."""
    store, out = spark._jsparkSession.sharedState().statusStore(), []
    runs = store.executionsList()
    for i in range(runs.size()):
        run = runs.apply(i).executionId()
        if run >= since:
            nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
            for node in (nodes.apply(k) for k in range(nodes.size())):
                if node.name() == "BroadcastExchange":
                    metrics = (node.metrics().apply(m) for m in range(node.metrics().size()))
                    out += [values.apply(m.accumulatorId()) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return [int(x.replace(",", "")) for x in out]


def test_zero_planted_rounds_broadcast_no_table_of_vertices(spark):
    n = 300_000  # twins, a path over a thousand of them and a hub; written, their sorted ids take few bytes a row
    twins = spark.range(n).selectExpr("id * 2 as src", "id * 2 + 1 as dst")
    path = spark.range(1000).selectExpr("id * 2 + 1 as src", "id * 2 + 2 as dst")
    star = spark.range(500_000, 500_900, 2).selectExpr("500000L as src", "id as dst").where("src <> dst")
    edges = twins.unionAll(path).unionAll(star)
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    names = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = [spark.conf.get(k, None) for k in names]
    found = components.cc_zero_hub(Graph.of_edges(edges))
    rows = broadcast_rows(spark, since)
    assert rows and max(rows) <= 100_000
    assert [spark.conf.get(k, None) for k in names] == before
    labels = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    assert {r.component: r.n for r in labels.where("n > 2").collect()} == {0: 900, 1: 2002}
    assert labels.where("component > 0 and least + 1 <> component").count() == 0
    assert found.count() == 2 * n
