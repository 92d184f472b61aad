"""Neighbour locality: the average gap between the sorted neighbours of a vertex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aid_by_degree(edges: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """``degree, n_vertices, mean_aid`` over vertices of degree 2 and more, neighbours renamed by ``mapping`` if given.

    The gaps of a sorted list add up to its range, so a vertex's value is (max - min) over its degree, rounded
    down: two aggregates instead of a sort.
    """
    label = "dst"
    if mapping is not None:
        edges = edges.join(mapping.select(F.col("old_id").alias("dst"), F.col("new_id").alias("label")), "dst")
        label = "label"
    per = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.max(label).alias("hi"), F.min(label).alias("lo")).where("degree >= 2")
    aid = F.floor((F.col("hi") - F.col("lo")) / F.col("degree"))
    return per.groupBy("degree").agg(F.count(F.lit(1)).alias("n_vertices"), F.round(F.sum(aid) / F.count(F.lit(1)), 6).alias("mean_aid"))
