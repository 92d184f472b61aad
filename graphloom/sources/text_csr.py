"""Graphs as text in compressed sparse rows: V, E, V offsets and E neighbours on four lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graphs import Graph
from graphloom.operators.numbering import numbered
from graphloom.runtime import materialize

STEP = 1 << 16


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """``at, value``: the numbers of the file with their places. The file is read in splits, at its blanks, not by lines."""
    raw = spark.read.option("lineSep", " ").text(path)
    blocks = raw.select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.posexplode(F.split("value", "[\r\n]+")).alias("part", "value"))
    found = blocks.where("value <> ''")
    return numbered(found, [F.asc("block"), F.asc("row"), F.asc("part")], "at").select("at", "value")


def expand(ranges: DataFrame) -> DataFrame:
    """``src, at`` for each place from ``first`` to before ``after``; long ranges are dealt in steps."""
    steps = ranges.where("first < after").select("src", "after", F.explode(F.sequence("first", F.col("after") - 1, F.lit(STEP))).alias("s"))
    return steps.select("src", F.explode(F.sequence("s", F.least(F.col("s") + STEP, F.col("after")) - 1)).alias("at"))


def scan(spark: SparkSession, path: str) -> Graph:
    """Read a graph. A missing last newline is accepted; anything but digits, or wrong counts, raises an error."""
    found = tokens(spark, path)
    checked = F.when(F.col("value").rlike("^[0-9]+$"), F.col("value").cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a number: "), "value")))
    numbers = materialize(found.select("at", checked.alias("value")), "numbers")
    head = {r[0]: r[1] for r in numbers.where("at < 2").collect()}
    if len(head) < 2 or numbers.count() != 2 + head[0] + head[1]:
        raise ValueError(f"{path}: the counts on the first two lines do not match the rest")
    v, e = head[0], head[1]
    starts = numbers.where((F.col("at") >= 2) & (F.col("at") < 2 + v)).select((F.col("at") - 2).alias("src"), F.col("value").alias("first"))
    after = starts.select((F.col("src") - 1).alias("src"), F.col("first").alias("after"))
    ranges = starts.join(after, "src", "left").select("src", "first", F.coalesce("after", F.lit(e)).alias("after"))
    nbrs = numbers.where(F.col("at") >= 2 + v).select((F.col("at") - 2 - v).alias("at"), F.col("value").alias("dst"))
    return Graph(expand(ranges).join(nbrs, "at").select("src", "dst"), spark.range(v))
