"""Graphs and results as tables: cached graphs, fixed orderings, reports and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalars import format_si
from graphloom.graphs import Graph
from graphloom.operators.degrees import max_degree, out_degree
from graphloom.operators.ordering import random_ordering
from graphloom.runtime import exists, materialize, shared_dir


def cache(graph: Graph) -> Graph:
    """The graph written to the scratch folder and read back."""
    return graph.with_edges(materialize(graph.edges, "graph-edges"), vertices=materialize(graph.vertices, "graph-vertices"))


def fixed_random_ordering(graph: Graph, name: str, iterations: int = 1) -> DataFrame:
    """The stored random ordering of ``name``; made and stored where there is none yet of these vertices.

    The folder's name holds the number of vertices and a sum of their hashes; a folder without the mark of a finished
    write is made again.
    """
    spark = graph.edges.sparkSession
    n, mark = graph.vertices.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("id"), F.lit(1 << 31)))).first()
    path = f"{shared_dir(spark)}/orderings/{name}_RND_{iterations}-{n}-{mark or 0:x}"
    if not exists(spark, f"{path}/_SUCCESS"):
        random_ordering(graph.vertices, "1", iterations).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def report(graph: Graph, dataset: str) -> DataFrame:
    """``dataset, v, e, max_degree``: a row for a run's report."""
    sizes = graph.vertices.agg(F.count(F.lit(1)).alias("v")).join(graph.edges.agg(F.count(F.lit(1)).alias("e"))).join(max_degree(out_degree(graph)))
    return sizes.select(F.lit(dataset).alias("dataset"), "v", "e", "max_degree")


def append_report(rows: DataFrame, path: str) -> None:
    """Add rows to a semicolon-separated report with a header in each part."""
    rows.coalesce(1).write.mode("append").option("sep", ";").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("sep", ";").option("header", True).schema(schema).csv(path)


def summary(graph: Graph, k: int = 20) -> DataFrame:
    """``section, src, dst``: the first and the last ``k`` edges. Two top-k selections, no full sort."""
    first = graph.edges.orderBy("src", "dst").limit(k).select(F.lit("first").alias("section"), "src", "dst")
    last = graph.edges.orderBy(F.desc("src"), F.desc("dst")).limit(k).select(F.lit("last").alias("section"), "src", "dst")
    return first.unionAll(last)


def sizes_si(graph: Graph) -> DataFrame:
    """``name, value, short`` for the numbers of vertices and edges and for some powers of ten."""
    spark = graph.edges.sparkSession
    counts = graph.vertices.agg(F.count(F.lit(1)).alias("value")).select(F.lit("vertices").alias("name"), "value").unionAll(graph.edges.agg(F.count(F.lit(1)).alias("value")).select(F.lit("edges"), "value"))
    powers = spark.range(19).select(F.concat(F.lit("e"), "id").alias("name"), (F.rpad(F.lit("1"), (F.col("id") + 1).cast("int"), F.lit("0")).cast("long") + 1).alias("value"))
    return counts.unionAll(powers).select("name", "value", format_si(F.col("value")).alias("short"))
