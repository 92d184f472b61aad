"""The graph type and the graphs that the registered queries run on."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.runtime import table


@dataclass(frozen=True)
class Graph:
    """``edges(src, dst[, weight])`` and ``vertices(id)``; ids are bigint. Isolated vertices are in ``vertices`` only."""

    edges: DataFrame
    vertices: DataFrame
    weighted: bool = False
    symmetric: bool = False

    @classmethod
    def of_edges(cls, edges: DataFrame, weighted: bool = False, symmetric: bool = False) -> Graph:
        """The vertices are the edges' ends."""
        ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()
        return cls(edges, ends, weighted, symmetric)

    @classmethod
    def dense(cls, edges: DataFrame, count: int | None = None, **more) -> Graph:
        """The vertices are 0..count-1, by default up to the largest id of an edge."""
        if count is None:
            top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
            count = 0 if top is None else top + 1
        return cls(edges, edges.sparkSession.range(count), **more)

    def with_edges(self, edges: DataFrame, **more) -> Graph:
        return replace(self, edges=edges, **more)


def g_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to their first part: one large component and many small ones."""
    items = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    return items.select(F.col("l_orderkey").cast("long").alias("src"), F.col("l_partkey").cast("long").alias("dst")).distinct()


def part_chain(spark: SparkSession, sf_dir: str, quantity: int) -> DataFrame:
    """Parts to the next part of the same order, over the items of at most ``quantity``."""
    items = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") <= quantity)
    after = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return items.select(F.col("l_partkey").cast("long").alias("src"), after.cast("long").alias("dst")).where("dst is not null").distinct()


def g_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_chain(spark, sf_dir, 10)


def g_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_chain(spark, sf_dir, 4)


def g_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts to suppliers in one id space: dense, with hubs, self-edges and reciprocal edges."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_partkey").cast("long").alias("src"), F.col("l_suppkey").cast("long").alias("dst")).distinct()


#: A graph with a reciprocal pair, a self-edge (2), a sink (3), a cycle (4-5-6) and an isolated vertex (7), as text.
HAND_TEXT = "8\n9\n0 2 4 6 6 7 8 9\n1 2 0 2 2 3 5 6 4"
