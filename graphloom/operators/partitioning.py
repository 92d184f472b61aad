"""Offsets, edge-balanced vertex ranges and their imbalance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.graphs import Graph
from graphloom.operators.degrees import out_degree
from graphloom.operators.numbering import running_sum


def offsets(graph: Graph) -> DataFrame:
    """``id, offset``: the edges of all smaller vertices, for dense ids."""
    return running_sum(out_degree(graph), [F.asc("id")], "degree", "offset").select("id", "offset")


def edge_partitioning(graph: Graph, parts: int) -> DataFrame:
    """``p, start_id, end_id``: ``parts`` vertex ranges of about equal edges plus vertices.

    Border t is the first vertex whose offset plus id reaches t shares, at least one past the border before it
    and at most V. Small graphs (V at most 4 per part) are dealt in equal numbers of vertices.
    """
    spark = graph.edges.sparkSession
    v, e = graph.vertices.count(), graph.edges.count()
    if v <= 4 * parts:
        borders, left = [0], v
        for t in range(1, parts):
            step = max(1, left // (parts - t + 1)) if left > 0 else 0
            borders.append(borders[-1] + step if left > 0 else v)
            left -= step
        rows = spark.createDataFrame(list(enumerate(borders)), "p bigint, start_id bigint")
    else:
        share = (e + v) // parts
        at = offsets(graph).select("id", (F.col("offset") + F.col("id")).alias("x"))
        nxt = at.join(out_degree(graph), "id").select("id", "x", (F.col("x") + F.col("degree") + 1).alias("y"))
        # vertex id + 1 is the lower bound of every target in (x, y]
        lo, hi = F.floor(F.col("x") / share) + 1, F.least(F.floor(F.col("y") / share), F.lit(parts - 1))
        found = nxt.where(lo <= hi).select(F.explode(F.sequence(lo, hi)).alias("p"), F.least(F.col("id") + 1, F.lit(v)).alias("low"))
        w = W.orderBy("p").rowsBetween(W.unboundedPreceding, 0)  # one row for each part
        rows = found.unionByName(spark.createDataFrame([(0, 0)], "p bigint, low bigint")).select("p", F.least(F.max(F.col("low") - F.col("p")).over(w) + F.col("p"), F.lit(v)).alias("start_id"))
    end = F.coalesce(F.lead("start_id").over(W.orderBy("p")), F.lit(v))
    return rows.select(F.col("p").cast("long").alias("p"), F.col("start_id").cast("long").alias("start_id"), end.cast("long").alias("end_id"))


def partition_imbalance(graph: Graph, borders: DataFrame) -> DataFrame:
    """``imbalance``: root mean square distance of the parts' edges from the largest part, in percent of it."""
    v, e = graph.vertices.count(), graph.edges.count()
    at = offsets(graph).unionAll(graph.edges.sparkSession.createDataFrame([(v, e)], "id bigint, offset bigint"))
    ends = borders.select("p", F.col("start_id").alias("id"), F.lit(-1).alias("sign")).unionAll(borders.select("p", F.col("end_id").alias("id"), F.lit(1).alias("sign")))
    edges = at.join(F.broadcast(ends), "id").groupBy("p").agg(F.sum(F.col("offset") * F.col("sign")).alias("n"))  # two rows for each part
    loads = borders.join(edges, "p", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    top = loads.agg(F.max("n").alias("top"))
    off = loads.join(F.broadcast(top)).agg(F.floor(F.sum(F.pow(F.col("top") - F.col("n"), F.lit(2)))).alias("s"), F.count(F.lit(1)).alias("p"), F.first("top").alias("top"))
    return off.select(F.round(100 * F.sqrt(F.floor(F.col("s") / F.col("p"))) / F.col("top"), 6).alias("imbalance"))
