"""Minimum spanning forests by Borůvka rounds, and what is made of a forest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graphs import Graph
from graphloom.operators.components import cc_pointer_jump, component_hubs
from graphloom.operators.contraction import compress, follow
from graphloom.runtime import counted, discard, is_empty, materialize


def unique_pairs(edges: DataFrame) -> DataFrame:
    """``lo, hi, weight``: the lightest edge of each unordered pair; self-edges go."""
    pair = edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "weight")
    return pair.groupBy("lo", "hi").agg(F.min("weight").alias("weight"))


def lightest_edge(cross: DataFrame) -> DataFrame:
    """``component, src, dst, weight, other`` from ``cross(c1, c2, lo, hi, weight)``: by weight, then by the pair.

    Both directions are aggregated before the shuffle, so hubs send one row per task.
    """
    both = cross.select(F.col("c1").alias("component"), F.col("c2").alias("other"), "weight", "lo", "hi").unionAll(cross.select(F.col("c2").alias("component"), F.col("c1").alias("other"), "weight", "lo", "hi"))
    best = both.groupBy("component").agg(F.min(F.struct("weight", "lo", "hi", "other")).alias("m"))
    return best.select("component", F.col("m.lo").alias("src"), F.col("m.hi").alias("dst"), "m.weight", "m.other")


def boruvka(edges: DataFrame) -> DataFrame:
    """``src, dst, weight`` of a minimum spanning forest of ``edges(src, dst, weight)``, ``src < dst``.

    Edges are ordered by weight, then by their ends: a strict order, so the forest is unique and mutual choices
    are the only cycles. Each round keeps the lightest edge between two components, so dense graphs shrink too.
    """
    pairs = unique_pairs(edges).select(F.col("lo").alias("c1"), F.col("hi").alias("c2"), "lo", "hi", "weight")
    cross, left = counted(pairs, "cross", F.lit(True))
    chosen = []
    while left:
        best = materialize(lightest_edge(cross), "lightest")
        chosen.append(best)
        onward = best.select(F.col("component").alias("id"), F.col("other").alias("c"))
        hooks = follow(onward, onward, left)
        mutual = (F.col("cc") == F.col("id")) & (F.col("id") < F.col("c"))
        roots = compress(materialize(hooks.select("id", F.when(mutual, F.col("id")).otherwise(F.col("c")).alias("c")), "hooks"))
        a = follow(roots, cross.withColumnRenamed("c1", "c"), left).withColumnRenamed("cc", "n1").drop("c")
        b = follow(roots, a.withColumnRenamed("c2", "c"), left).withColumnRenamed("cc", "n2").drop("c")
        moved = b.where(F.col("n1") != F.col("n2")).select(F.least("n1", "n2").alias("c1"), F.greatest("n1", "n2").alias("c2"), "lo", "hi", "weight")
        light = moved.groupBy("c1", "c2").agg(F.min(F.struct("weight", "lo", "hi")).alias("m")).select("c1", "c2", "m.lo", "m.hi", "m.weight")
        nxt, left = counted(light, "cross", F.lit(True))
        discard(cross, roots)
        cross = nxt
    if not chosen:
        return cross.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight")
    return reduce(DataFrame.unionAll, [c.select("src", "dst", "weight") for c in chosen]).distinct()


def summary(forest: DataFrame) -> DataFrame:
    return forest.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("weight"))


def weight_by_kruskal(edges: list[tuple[int, int, int]]) -> int:
    """Reference solution for tests on small graphs."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    total = 0
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if (x := find(a)) != (y := find(b)):
            parent[x] = y
            total += w
    return total


def to_graph(forest: DataFrame) -> DataFrame:
    """Both directions of each forest edge."""
    return forest.select("src", "dst").unionAll(forest.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def violations(graph: Graph, forest: DataFrame) -> DataFrame:
    """Forest edges that the graph lacks, components that differ, and edges that close a cycle."""
    pairs = unique_pairs(graph.edges).select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight")
    foreign = forest.join(pairs, ["src", "dst", "weight"], "left_anti").select(F.lit(1).cast("long").alias("n"))
    of_graph, of_forest = cc_pointer_jump(graph), cc_pointer_jump(graph.with_edges(forest))
    apart = of_graph.join(of_forest.withColumnRenamed("component", "other"), "id").where("component <> other").select(F.lit(1).cast("long").alias("n"))
    trees = of_forest.agg(F.countDistinct("component").alias("n"))
    balance = forest.agg(F.count(F.lit(1)).alias("n")).unionAll(trees).unionAll(graph.vertices.agg((-F.count(F.lit(1))).alias("n"))).agg(F.abs(F.sum("n")).alias("n"))
    return foreign.unionAll(apart).unionAll(balance).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("violations"))


def bfs(graph: Graph, forest: DataFrame) -> DataFrame:
    """``id, root, level``: distance of each vertex from its tree's vertex of largest degree (in the forest)."""
    links = materialize(to_graph(forest), "links")
    trees = graph.with_edges(forest)
    hubs = component_hubs(trees, cc_pointer_jump(trees))
    front = materialize(hubs.select(F.col("hub").alias("id"), F.col("hub").alias("root"), F.lit(-1).cast("long").alias("came"), F.lit(0).cast("long").alias("level")), "front")
    levels = [front]
    while not is_empty(front):
        step = front.withColumnRenamed("id", "src").join(links, "src").where(F.col("dst") != F.col("came"))
        front = materialize(step.select(F.col("dst").alias("id"), "root", F.col("src").alias("came"), (F.col("level") + 1).alias("level")), "front")
        levels.append(front)
    return reduce(DataFrame.unionAll, levels).select("id", "root", "level")
