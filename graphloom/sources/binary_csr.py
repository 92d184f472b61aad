"""Graphs in binary compressed sparse rows: a properties file, 8-byte offsets and 4-byte neighbours, little-endian."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graphs import Graph
from graphloom.operators.partitioning import offsets
from graphloom.sources.text_csr import expand

ID_BYTES = 4


def open_path(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def write_stream(spark: SparkSession, path: str, chunks: Iterator[bytes]) -> None:
    """Write one file from chunks that arrive in order, one at a time."""
    fs, hpath = open_path(spark, path)
    out = fs.create(hpath, True)
    for chunk in chunks:
        out.write(bytearray(chunk))
    out.close()


def packed(df: DataFrame, order: str, column: str, kind: str) -> Iterator[bytes]:
    """The column in the given order as raw numbers; the driver holds one partition's chunks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy(zero_copy_only=False).astype(kind).tobytes()], pa.binary())], ["raw"])

    keys = order.split(",")
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(column)
    for row in laid.mapInArrow(run, "raw binary").toLocalIterator():
        yield bytes(row[0])


def write(graph: Graph, path: str) -> None:
    """Write a graph with dense ids below 2**32 to ``<path>_props.txt``, ``_offsets.bin`` and ``_edges.bin``."""
    spark = graph.edges.sparkSession
    v, e = graph.vertices.count(), graph.edges.count()
    at = offsets(graph).unionAll(spark.createDataFrame([(v, e)], "id bigint, offset bigint"))
    name = path.rstrip("/").rpartition("/")[2]
    props = {"vertices-count": v, "edges-count": e, "bytes-per-vertex-ID-in-edges-file": ID_BYTES, "offsets-file": f"{name}_offsets.bin", "edges-file": f"{name}_edges.bin"}
    write_stream(spark, f"{path}_offsets.bin", packed(at, "id", "offset", "<u8"))
    write_stream(spark, f"{path}_edges.bin", packed(graph.edges, "src,dst", "dst", "<u4"))
    write_stream(spark, f"{path}_props.txt", iter(["".join(f"{k}:{x}\n" for k, x in props.items()).encode()]))


def numbers(spark: SparkSession, path: str, width: int) -> DataFrame:
    """``at, value`` of a file of ``width``-byte numbers, read in splits."""
    raw = spark.sparkContext.binaryRecords(path, width)

    def decode(records):
        values = np.frombuffer(b"".join(map(bytes, records)), f"<u{width}")
        return map(int, values)

    return spark.createDataFrame(raw.mapPartitions(decode).zipWithIndex(), "value bigint, at bigint").select("at", "value")


def scan(spark: SparkSession, path: str) -> Graph:
    props = dict(r[0].split(":", 1) for r in spark.read.text(f"{path}_props.txt").collect() if ":" in r[0])
    folder = path.rpartition("/")[0]
    v = int(props["vertices-count"])
    at = numbers(spark, f"{folder}/{props['offsets-file']}", 8)
    after = at.select((F.col("at") - 1).alias("at"), F.col("value").alias("after"))
    ranges = at.where(F.col("at") < v).join(after, "at").select(F.col("at").alias("src"), F.col("value").alias("first"), "after")
    nbrs = numbers(spark, f"{folder}/{props['edges-file']}", int(props["bytes-per-vertex-ID-in-edges-file"]))
    return Graph(expand(ranges).join(nbrs.withColumnRenamed("value", "dst"), "at").select("src", "dst"), spark.range(v))
