"""Degree orderings, random orderings, relabelling, and the checks of these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.scalars import hash_order
from graphloom.graphs import Graph
from graphloom.joins import split_join
from graphloom.operators.numbering import numbered, running_sum
from graphloom.runtime import materialize


def degree_ordering(degree: DataFrame) -> DataFrame:
    """``new_id, old_id, degree``: by degree, largest first, then by id. A range sort with numbered ranges."""
    by = degree.select(F.col("id").alias("old_id"), "degree")
    return numbered(by, [F.desc("degree"), F.asc("old_id")], "new_id").select("new_id", "old_id", "degree")


def degree_ordering_counting(degree: DataFrame) -> DataFrame:
    """The same ordering by counting: the histogram gives each degree its first place, ids are ranked inside a degree.

    Ranks are taken inside (degree, range of ids), so that a degree that most vertices share stays many tasks.
    """
    cells = degree.withColumn("cell", F.floor(F.col("id") / 65536))
    counts = cells.groupBy("degree", "cell").agg(F.count(F.lit(1)).alias("n"))
    starts = running_sum(counts, [F.desc("degree"), F.asc("cell")], "n", "start").select("degree", "cell", "start")
    rank = F.row_number().over(W.partitionBy("degree", "cell").orderBy("id")) - 1
    return cells.withColumn("rank", rank).join(starts, ["degree", "cell"]).select((F.col("start") + F.col("rank")).cast("long").alias("new_id"), F.col("id").alias("old_id"), "degree")


def sorted_adjacency(edges: DataFrame) -> DataFrame:
    """``src, pos, dst``: each neighbour with its place in the ascending list of its source.

    Edges are numbered as a whole and the number of the source's first one is taken off, so a hub's list is many tasks.
    """
    rows = materialize(numbered(edges.select("src", "dst"), [F.asc("src"), F.asc("dst")], "at"), "lists")
    first = materialize(rows.groupBy("src").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    return split_join(rows, first, ["src"], "inner", "n", rows.count()).select("src", (F.col("at") - F.col("first")).alias("pos"), "dst")


def random_ordering(vertices: DataFrame, seed: str = "1", iterations: int = 1, on_iteration=None) -> DataFrame:
    """``old_id, new_id``: a composition of hash permutations; ``on_iteration(mapping, i)`` sees each one."""
    mapping = vertices.select(F.col("id").alias("old_id"), F.col("id").alias("at"))
    for i in range(max(iterations, 1)):
        tag = seed if i == 0 else f"{seed}/{i}"
        nxt = numbered(mapping.select("old_id", "at").withColumn("h", hash_order(tag, F.col("at"))), [F.asc("h"), F.asc("at")], "new_id")
        mapping = nxt.select("old_id", "new_id", F.col("new_id").alias("at"))
        if on_iteration is not None:
            on_iteration(mapping.select("old_id", "new_id"), i)
    return mapping.select("old_id", "new_id")


def relabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both ends of each edge by the mapping; edges are kept as often as they stand, other columns too."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    a = mapping.select(F.col("old_id").alias("src"), F.col("new_id").alias("new_src"))
    b = mapping.select(F.col("old_id").alias("dst"), F.col("new_id").alias("new_dst"))
    return edges.join(a, "src").join(b, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), *rest)


def relabelling_violations(mapping: DataFrame, vertices: DataFrame) -> DataFrame:
    """Zero if ``mapping`` sends the vertices one to one to 0..V-1."""
    v = vertices.agg(F.count(F.lit(1)).alias("v"))
    m = mapping.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("new_id").alias("d"), F.countDistinct("old_id").alias("o"), F.min("new_id").alias("lo"), F.max("new_id").alias("hi"))
    wrong = [F.col("n") != F.col("v"), F.col("d") != F.col("v"), F.col("o") != F.col("v"), F.coalesce(F.col("lo"), F.lit(0)) != 0, F.coalesce(F.col("hi"), F.col("v") - 1) != F.col("v") - 1]
    return m.join(F.broadcast(v)).select(sum((w.cast("long") for w in wrong), F.lit(0).cast("long")).alias("violations"))


def ordering_violations(ordering: DataFrame) -> DataFrame:
    """How many places of a degree ordering have a larger degree than the place before them."""
    before = ordering.select((F.col("new_id") + 1).alias("new_id"), F.col("degree").alias("before"))
    return ordering.join(before, "new_id").agg(F.count_if(F.col("degree") > F.col("before")).alias("violations"))
