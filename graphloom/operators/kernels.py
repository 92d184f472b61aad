"""Triangle counting, sparse matrix-vector products, maximal independent sets and maximal matchings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import hash_order
from graphloom.graphs import Graph
from graphloom.operators.transform import symmetrize
from graphloom.runtime import discard, is_empty, materialize


def triangle_count(edges: DataFrame) -> DataFrame:
    """One row, ``triangles``. Edges point from smaller to larger degree, so no vertex has over sqrt(2E) successors."""
    both = materialize(symmetrize(edges), "edges")
    degree = both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    a, b = (degree.select(F.col("id").alias(x), F.col("d").alias(f"d_{x}")) for x in ("src", "dst"))
    rank = lambda x: F.struct(F.col(f"d_{x}"), F.col(x))
    up = both.join(a, "src").join(b, "dst").where(rank("src") < rank("dst")).select("src", "dst", "d_dst")
    up = materialize(up, "oriented")
    # each pair of successors once: its closing edge points from the smaller to the larger
    wedge = up.join(up.select("src", F.col("dst").alias("far"), F.col("d_dst").alias("d_far")), "src").where(rank("dst") < rank("far"))
    closed = wedge.join(up.select(F.col("src").alias("dst"), F.col("dst").alias("far")), ["dst", "far"], "left_semi")
    return closed.agg(F.count(F.lit(1)).alias("triangles"))


def spmv(graph: Graph, x: DataFrame) -> DataFrame:
    """``id, y``: the sum of ``x(id, x)`` over the in-edges of each vertex."""
    sums = graph.edges.join(x.select(F.col("id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("x").alias("s"))
    return graph.vertices.join(sums, "id", "left").select("id", F.coalesce("s", F.lit(0)).cast("long").alias("y"))


def maximal_independent_set(graph: Graph, seed: str = "mis") -> DataFrame:
    """``id`` of a maximal independent set: in each round local minima of a hash join it and their neighbours leave."""
    edges = materialize(symmetrize(graph.edges), "edges")
    left = materialize(graph.vertices.select("id", F.concat(hash_order(seed, F.col("id")), F.col("id").cast("string")).alias("h")), "left")
    rounds = []
    while not is_empty(left):
        live = edges.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst"), F.col("h").alias("h_dst")), "dst")
        low = live.groupBy(F.col("src").alias("id")).agg(F.min("h_dst").alias("low"))
        won = materialize(left.join(low, "id", "left").where(F.col("low").isNull() | (F.col("h") < F.col("low"))).select("id"), "won")
        rounds.append(won)
        beside = edges.join(won.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        rest = materialize(left.join(won.unionAll(beside), "id", "left_anti"), "left")
        discard(left)
        left = rest
    out = left.select("id")
    for won in rounds:
        out = out.unionAll(won)
    return out


def maximal_matching(graph: Graph, seed: str = "match") -> DataFrame:
    """``src, dst`` (``src < dst``) of a maximal matching: edges of locally smallest hash join it round by round."""
    pair = symmetrize(graph.edges).where("src < dst")
    left = materialize(pair.withColumn("h", F.concat(hash_order(seed, F.concat_ws("-", "src", "dst")), F.lit("-"), F.concat_ws("-", "src", "dst"))), "left")
    rounds = []
    while not is_empty(left):
        ends = left.select(F.col("src").alias("id"), "h").unionAll(left.select(F.col("dst").alias("id"), "h"))
        low = materialize(ends.groupBy("id").agg(F.min("h").alias("low")), "low")
        a, b = (low.select(F.col("id").alias(x), F.col("low").alias(f"low_{x}")) for x in ("src", "dst"))
        won = materialize(left.join(a, "src").join(b, "dst").where("h = low_src and h = low_dst").select("src", "dst"), "won")
        rounds.append(won)
        used = won.select(F.col("src").alias("id")).unionAll(won.select(F.col("dst").alias("id")))
        rest = left.join(used.withColumnRenamed("id", "src"), "src", "left_anti").join(used.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "h")
        nxt = materialize(rest, "left")
        discard(left, low)
        left = nxt
    out = left.select("src", "dst")
    for won in rounds:
        out = out.unionAll(won)
    return out
