"""The registered queries of the graph operators. Each takes ``(spark, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import prng
from graphloom.graphs import HAND_TEXT, Graph, g_main, g_mid, g_skew, g_sparse
from graphloom.operators import components, degrees, forest, kernels, locality, ordering, partitioning, transform
from graphloom.runtime import materialize, scratch_dir
from graphloom.sources import binary_csr, tables, text_csr

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PARTS, HUBS = 64, 100


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def main(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of_edges(materialize(g_main(spark, sf_dir), "main"))


def mid(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of_edges(materialize(g_mid(spark, sf_dir), "mid"))


def sparse(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of_edges(materialize(g_sparse(spark, sf_dir), "sparse"))


def skew(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of_edges(materialize(g_skew(spark, sf_dir), "skew"))


def dense(graph: Graph) -> Graph:
    return Graph.dense(graph.edges)


def hand(spark: SparkSession) -> Graph:
    """The hand-made graph, written as a text file and read back."""
    path = f"{scratch_dir(spark)}/text-csr-{uuid.uuid4().hex}"
    spark.createDataFrame([(HAND_TEXT,)], "value string").coalesce(1).write.text(path)
    return text_csr.scan(spark, path)


def weighted(graph: Graph) -> Graph:
    return graph.with_edges(materialize(transform.add_weights(graph.edges), "weighted"), weighted=True)


@query
def scan_text_csr(spark, sf_dir):
    return hand(spark).edges


@query
def scan_compbin(spark, sf_dir):
    path = f"{scratch_dir(spark)}/binary-csr-{uuid.uuid4().hex}/hand"
    binary_csr.write(hand(spark), path)
    return binary_csr.scan(spark, path).edges


@query
def write_compbin(spark, sf_dir):
    path = f"{scratch_dir(spark)}/binary-csr-{uuid.uuid4().hex}/sparse"
    binary_csr.write(dense(sparse(spark, sf_dir)), path)
    return binary_csr.scan(spark, path).edges


@query
def cache_roundtrip(spark, sf_dir):
    return tables.cache(sparse(spark, sf_dir)).edges


@query
def fixed_random_ordering(spark, sf_dir):
    graph = sparse(spark, sf_dir)
    return tables.fixed_random_ordering(graph, f"sparse-{zlib.crc32(sf_dir.encode()):08x}", 1)


@query
def graph_report(spark, sf_dir):
    return tables.report(main(spark, sf_dir), "main")


@query
def graph_summary(spark, sf_dir):
    return tables.summary(main(spark, sf_dir))


@query
def format_si(spark, sf_dir):
    return tables.sizes_si(main(spark, sf_dir))


@query
def remove_self_edges(spark, sf_dir):
    return transform.remove_self_edges(g_skew(spark, sf_dir))


@query
def count_self_edges(spark, sf_dir):
    return transform.count_self_edges(g_skew(spark, sf_dir))


@query
def drop_weights(spark, sf_dir):
    return transform.drop_weights(transform.add_weights(g_mid(spark, sf_dir)))


@query
def add_weights(spark, sf_dir):
    return transform.add_weights(g_mid(spark, sf_dir))


@query
def has_reverse_edge(spark, sf_dir):
    return transform.has_reverse_edge(g_skew(spark, sf_dir))


@query
def edge_lookup(spark, sf_dir):
    return transform.edge_lookup(g_skew(spark, sf_dir))


@query
def out_degree(spark, sf_dir):
    return degrees.out_degree(skew(spark, sf_dir))


@query
def in_degree(spark, sf_dir):
    return degrees.in_degree(skew(spark, sf_dir))


@query
def max_degree(spark, sf_dir):
    return degrees.max_degree(degrees.in_degree(skew(spark, sf_dir)))


@query
def max_degree_vertex(spark, sf_dir):
    return degrees.max_degree_vertex(degrees.in_degree(skew(spark, sf_dir)))


@query
def degree_histogram(spark, sf_dir):
    return degrees.degree_histogram(degrees.in_degree(skew(spark, sf_dir)))


@query
def degree_stddev(spark, sf_dir):
    return degrees.degree_stddev(degrees.in_degree(skew(spark, sf_dir)))


@query
def csr_offsets(spark, sf_dir):
    return partitioning.offsets(dense(main(spark, sf_dir)))


@query
def edge_partitioning(spark, sf_dir):
    return partitioning.edge_partitioning(dense(main(spark, sf_dir)), PARTS)


@query
def partition_imbalance(spark, sf_dir):
    graph = dense(main(spark, sf_dir))
    return partitioning.partition_imbalance(graph, partitioning.edge_partitioning(graph, PARTS))


@query
def degree_ordering(spark, sf_dir):
    return ordering.degree_ordering(degrees.in_degree(skew(spark, sf_dir)))


@query
def degree_ordering_counting(spark, sf_dir):
    return ordering.degree_ordering_counting(degrees.in_degree(skew(spark, sf_dir)))


@query
def topk_hubs(spark, sf_dir):
    return degrees.top_hubs(degrees.in_degree(skew(spark, sf_dir)), HUBS)


@query
def sorted_adjacency(spark, sf_dir):
    return ordering.sorted_adjacency(g_skew(spark, sf_dir))


@query
def random_ordering(spark, sf_dir):
    return ordering.random_ordering(mid(spark, sf_dir).vertices)


@query
def relabel_graph(spark, sf_dir):
    graph = mid(spark, sf_dir)
    return ordering.relabel(graph.edges, ordering.random_ordering(graph.vertices))


@query
def validate_relabeling(spark, sf_dir):
    graph = mid(spark, sf_dir)
    return ordering.relabelling_violations(ordering.random_ordering(graph.vertices, "5", 3), graph.vertices)


@query
def validate_degree_ordering(spark, sf_dir):
    return ordering.ordering_violations(ordering.degree_ordering(degrees.in_degree(mid(spark, sf_dir))))


@query
def validate_transpose(spark, sf_dir):
    edges = g_mid(spark, sf_dir)
    return transform.transpose_violations(edges, transform.transpose_lists(edges))


@query
def validate_symmetrize(spark, sf_dir):
    edges = mid(spark, sf_dir).edges
    return transform.symmetrize_violations(edges, transform.symmetrize(edges))


@query
def validate_cc(spark, sf_dir):
    graph = mid(spark, sf_dir)
    return components.labelling_violations(components.cc_min_label(graph), components.cc_zero_hub(graph))


@query
def validate_msf(spark, sf_dir):
    graph = weighted(mid(spark, sf_dir))
    return forest.violations(graph, materialize(forest.boruvka(graph.edges), "forest"))


@query
def validate_relabeling_spoilt(spark, sf_dir):
    graph = mid(spark, sf_dir)
    mapping = ordering.random_ordering(graph.vertices).withColumn("new_id", F.floor(F.col("new_id") / 2))
    return ordering.relabelling_violations(mapping, graph.vertices)


@query
def validate_degree_ordering_spoilt(spark, sf_dir):
    graph = mid(spark, sf_dir)
    by = ordering.degree_ordering(degrees.in_degree(graph))
    return ordering.ordering_violations(by.withColumn("new_id", F.lit(graph.vertices.count() - 1) - F.col("new_id")))


@query
def validate_transpose_spoilt(spark, sf_dir):
    edges = g_mid(spark, sf_dir)
    return transform.transpose_violations(edges, transform.transpose(edges).where("src % 10 <> 0"))


@query
def validate_symmetrize_spoilt(spark, sf_dir):
    edges = mid(spark, sf_dir).edges
    return transform.symmetrize_violations(edges, transform.symmetrize(edges).where("not (src < dst and src % 7 = 0)"))


@query
def validate_cc_spoilt(spark, sf_dir):
    graph = mid(spark, sf_dir)
    labels = materialize(components.cc_pointer_jump(graph), "labels")
    return components.labelling_violations(labels, labels.withColumn("component", F.col("id") % 2))


@query
def validate_msf_spoilt(spark, sf_dir):
    """A forest without the edges that leave vertices divisible by five: as many components too many as there are edges too few."""
    graph = weighted(mid(spark, sf_dir))
    whole = materialize(forest.boruvka(graph.edges), "forest")
    return forest.violations(graph, whole.where("src % 5 <> 0")).select((F.col("violations") > 0).alias("found"))


@query
def transpose(spark, sf_dir):
    return transform.transpose(g_skew(spark, sf_dir))


@query
def transpose_skew(spark, sf_dir):
    return transform.transpose_lists(g_skew(spark, sf_dir))


@query
def symmetrize(spark, sf_dir):
    return transform.symmetrize(g_skew(spark, sf_dir))


@query
def symmetrize_keep_self(spark, sf_dir):
    return transform.symmetrize(g_skew(spark, sf_dir), drop_self=False)


@query
def transform_pipeline(spark, sf_dir):
    return transform.transform_pipeline(skew(spark, sf_dir), symmetric=True, randomise=True).edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_edges"), F.countDistinct("src").alias("sources"), F.min("src").alias("lo"), F.max("src").alias("hi"))


@query
def cc_min_label(spark, sf_dir):
    return components.cc_min_label(main(spark, sf_dir))


@query
def cc_pointer_jump(spark, sf_dir):
    return components.cc_pointer_jump(main(spark, sf_dir))


@query
def pointer_jump(spark, sf_dir):
    return components.pointer_jump(components.minimum_pointers(main(spark, sf_dir)))


@query
def cc_count(spark, sf_dir):
    return components.component_count(components.cc_pointer_jump(main(spark, sf_dir)))


@query
def component_sizes(spark, sf_dir):
    return components.component_sizes(components.cc_pointer_jump(main(spark, sf_dir)))


@query
def component_hubs(spark, sf_dir):
    graph = main(spark, sf_dir)
    return components.component_hubs(graph, components.cc_pointer_jump(graph))


@query
def cc_thrifty(spark, sf_dir):
    return components.cc_zero_hub(main(spark, sf_dir))


@query
def cc_thrifty_weighted(spark, sf_dir):
    graph = weighted(mid(spark, sf_dir))
    return components.cc_zero_hub(graph.with_edges(transform.drop_weights(graph.edges), weighted=False))


@query
def lightest_edge(spark, sf_dir):
    pairs = forest.unique_pairs(transform.add_weights(g_mid(spark, sf_dir)))
    cross = pairs.select(F.col("lo").alias("c1"), F.col("hi").alias("c2"), "lo", "hi", "weight")
    return forest.lightest_edge(cross).select("component", "src", "dst", "weight")


@query
def msf_boruvka(spark, sf_dir):
    return forest.boruvka(weighted(mid(spark, sf_dir)).edges)


@query
def msf_edges(spark, sf_dir):
    return forest.boruvka(weighted(sparse(spark, sf_dir)).edges)


@query
def msf_summary(spark, sf_dir):
    return forest.summary(forest.boruvka(weighted(mid(spark, sf_dir)).edges))


@query
def msf_weight_check(spark, sf_dir):
    """The forest's weight on the main graph, whose equal weights exercise the order of ties."""
    return forest.summary(forest.boruvka(weighted(main(spark, sf_dir)).edges)).select("weight")


@query
def forest_to_graph(spark, sf_dir):
    return forest.to_graph(forest.boruvka(weighted(sparse(spark, sf_dir)).edges))


@query
def forest_bfs(spark, sf_dir):
    graph = sparse(spark, sf_dir)
    return forest.bfs(graph, materialize(forest.boruvka(weighted(graph).edges), "forest"))


@query
def aid_by_degree(spark, sf_dir):
    return locality.aid_by_degree(transform.symmetrize(g_main(spark, sf_dir)))


@query
def aid_by_degree_relabeled(spark, sf_dir):
    graph = main(spark, sf_dir)
    return locality.aid_by_degree(transform.symmetrize(graph.edges), ordering.random_ordering(graph.vertices))


@query
def sampled_hot_vertices(spark, sf_dir):
    return degrees.sampled_hot_vertices(skew(spark, sf_dir))


@query
def triangle_count(spark, sf_dir):
    return kernels.triangle_count(g_mid(spark, sf_dir))


@query
def spmv(spark, sf_dir):
    graph = mid(spark, sf_dir)
    return kernels.spmv(graph, graph.vertices.select("id", (F.col("id") % 7).alias("x")))


@query
def maximal_independent_set(spark, sf_dir):
    return kernels.maximal_independent_set(mid(spark, sf_dir))


@query
def maximal_matching(spark, sf_dir):
    return kernels.maximal_matching(mid(spark, sf_dir))


@query
def prng_splitmix64(spark, sf_dir):
    """The first 1000 words of a seeded generator, as hexadecimal digits."""
    return spark.range(1000).select(F.col("id").alias("n"), F.lpad(F.lower(F.hex(prng.splitmix64_column(42, F.col("id")))), 16, "0").alias("word"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-degrees and the ordering of vertices by them."""
    return degree_ordering(spark, sf_dir)
