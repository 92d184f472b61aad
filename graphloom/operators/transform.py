"""Edge-set transforms: self-edges, weights, transposition, symmetrization, lookups, and the checks of these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import MAX_WEIGHT, pair_weight
from graphloom.graphs import Graph
from graphloom.joins import HOT_KEYS
from graphloom.operators.ordering import random_ordering, relabel, sorted_adjacency
from graphloom.runtime import materialize


def remove_self_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst"))


def count_self_edges(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("self_edges"))


def drop_weights(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst")


def add_weights(edges: DataFrame, most: int = MAX_WEIGHT) -> DataFrame:
    """A random weight for each unordered pair: the same in both directions, in any run and layout."""
    return edges.select("src", "dst", pair_weight(F.col("src"), F.col("dst"), most).cast("long").alias("weight"))


def transpose(edges: DataFrame, drop_self: bool = False) -> DataFrame:
    """Every edge reversed, as often as it stands. A projection: nothing is shuffled."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return (remove_self_edges(edges) if drop_self else edges).select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def transpose_lists(edges: DataFrame, hot: int = 100_000) -> DataFrame:
    """The reversed edges laid out by their new source, for consumers that want its list together.

    Sources with over ``hot`` edges (or over the ``HOT_KEYS``-th part of all) are dealt over as many tasks as they have
    times that; the others stay whole. There are at most ``HOT_KEYS`` such sources, so the table of them is broadcast.
    """
    per = materialize(edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")), "sizes")
    least = max(hot, (per.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    heavy = F.broadcast(per.where(F.col("n") > least).select("dst", F.ceil(F.col("n") / least).alias("salts")))
    salted = edges.join(heavy, "dst", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("src"), F.col("salts")), F.lit(0)))
    return salted.repartition("dst", "salt").sortWithinPartitions("dst", "src").select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrize(edges: DataFrame, drop_self: bool = True) -> DataFrame:
    """The set union of the edges and their reverses."""
    own = remove_self_edges(edges) if drop_self else edges
    return own.select("src", "dst").unionAll(reverse(own)).distinct()


def has_reverse_edge(edges: DataFrame) -> DataFrame:
    """The edges whose reverse is an edge too."""
    return edges.join(reverse(edges).distinct(), ["src", "dst"], "left_semi").select("src", "dst")


def edge_lookup(edges: DataFrame) -> DataFrame:
    """``src, dst, idx``: where ``src`` stands in the ascending list of ``dst`` (first, if it stands there more than once), or -1."""
    lists = sorted_adjacency(edges).groupBy(F.col("dst").alias("src"), F.col("src").alias("dst")).agg(F.min("pos").alias("idx"))
    return edges.select("src", "dst").join(lists, ["src", "dst"], "left").select("src", "dst", F.coalesce("idx", F.lit(-1)).cast("long").alias("idx"))


def difference_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in which two edge multisets differ, as a one-row count."""
    n = a.select("src", "dst", F.lit(1).alias("k")).unionAll(b.select("src", "dst", F.lit(-1).alias("k")))
    per = n.groupBy("src", "dst").agg(F.sum("k").alias("k"))
    return per.agg(F.coalesce(F.sum(F.abs("k")), F.lit(0)).cast("long").alias("violations"))


def transpose_violations(edges: DataFrame, transposed: DataFrame) -> DataFrame:
    return difference_size(reverse(edges), transposed)


def symmetrize_violations(edges: DataFrame, result: DataFrame, drop_self: bool = True) -> DataFrame:
    """Edges without a counterpart in the result, result edges without a source or a reverse, repeated ones."""
    own = remove_self_edges(edges) if drop_self else edges
    both = own.select("src", "dst").unionAll(reverse(own))
    missing = both.join(result, ["src", "dst"], "left_anti").distinct()
    extra = result.join(both, ["src", "dst"], "left_anti")
    lonely = result.join(reverse(result), ["src", "dst"], "left_anti")
    again = result.groupBy("src", "dst").count().where("count > 1").select("src", "dst")
    found = missing.select("src", "dst").unionAll(extra.select("src", "dst")).unionAll(lonely.select("src", "dst")).unionAll(again)
    return found.agg(F.count(F.lit(1)).alias("violations"))


def transform_pipeline(graph: Graph, transposed: bool = False, symmetric: bool = False, randomise: bool = False, seed: str = "1") -> Graph:
    """Transpose or symmetrize (self-edges kept; a symmetric input stays as it is), then five random relabellings if asked."""
    if transposed and symmetric:
        raise ValueError("transposition and symmetrization exclude each other")
    if transposed and not graph.symmetric:
        graph = graph.with_edges(transpose(graph.edges))
    if symmetric and not graph.symmetric:
        graph = graph.with_edges(symmetrize(graph.edges, drop_self=False), symmetric=True)
    if randomise:
        mapping = random_ordering(graph.vertices, seed, 5)
        graph = graph.with_edges(relabel(graph.edges, mapping))
    return graph
