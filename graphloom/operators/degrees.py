"""Degrees and their statistics. Vertices without edges have degree 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import hash_order, hex_number
from graphloom.graphs import Graph


def degrees(graph: Graph, end: str) -> DataFrame:
    """``id, degree``: the edges of each vertex by ``src`` (out) or ``dst`` (in)."""
    counts = graph.edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return graph.vertices.join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def out_degree(graph: Graph) -> DataFrame:
    return degrees(graph, "src")


def in_degree(graph: Graph) -> DataFrame:
    return degrees(graph, "dst")


def max_degree(degree: DataFrame) -> DataFrame:
    return degree.agg(F.max("degree").alias("max_degree"))


def max_degree_vertex(degree: DataFrame) -> DataFrame:
    """The vertex with the largest degree; of several, the one with the smallest id."""
    return degree.agg(F.max(F.struct("degree", (-F.col("id")).alias("neg"))).alias("m")).select((-F.col("m.neg")).alias("id"), F.col("m.degree").alias("degree"))


def degree_histogram(degree: DataFrame) -> DataFrame:
    return degree.groupBy("degree").agg(F.count(F.lit(1)).alias("n_vertices"))


def degree_stddev(degree: DataFrame) -> DataFrame:
    return degree.agg(F.round(F.stddev_pop("degree"), 6).alias("stddev"))


def top_hubs(degree: DataFrame, k: int) -> DataFrame:
    """The ``k`` vertices of largest degree; a top-k, not a full sort."""
    return degree.orderBy(F.desc("degree"), "id").limit(k)


def sampled_hot_vertices(graph: Graph, fraction: float = 0.05, seed: str = "hot") -> DataFrame:
    """``id, sampled``: how often each target stands in a sample of edges, as many as ``fraction`` of the vertices.

    An edge is in the sample by a hash of its ends, so reruns and other engines sample the same.
    """
    edges, vertices = graph.edges.count(), graph.vertices.count()
    share = min(1.0, fraction * vertices / max(edges, 1))
    drawn = hex_number(hash_order(seed, F.concat_ws("-", "src", "dst"))) < F.lit(share * 2.0**32)
    return graph.edges.where(drawn).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("sampled"))
