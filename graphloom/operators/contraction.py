"""Connected components by repeated contraction.

Each round points every vertex at its smallest neighbour, compresses the pointers to their roots by pointer
doubling and rewrites the edges between roots. A graph of stars is done after one round; in general the
number of vertices at least halves, so rounds are logarithmic. The smallest id of a component is never
pointed elsewhere, so it ends up as the component's label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.joins import split_join
from graphloom.runtime import counted, discard, materialize, view

#: Steps of a round of compression, and rows up to which one task may hold all that share a target.
STEPS, LARGE = 3, 1_000_000


def undirected(edges: DataFrame) -> DataFrame:
    """``(a, b)`` with ``a < b``, once per unordered pair; self-edges and null ends go."""
    pair = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "src", "dst")
    return pair.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("a") < F.col("b"))).select("a", "b").distinct()


def follow(pointers: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """``rows(id, c)`` with ``cc``: where ``c`` points. Past ``LARGE`` rows, targets that many rows share are joined apart."""
    target = pointers.select(F.col("id").alias("c"), F.col("c").alias("cc"))
    if total <= LARGE:
        return rows.join(target, "c", "left")
    times = rows.groupBy("c").agg(F.count(F.lit(1)).alias("times"))
    return split_join(rows, target.join(times, "c"), ["c"], "left", "times", total).drop("times")


def compress(pointers: DataFrame) -> DataFrame:
    """Follow ``c`` until it is a root. ``pointers(id, c)`` is a written table; so is the result.

    A round takes ``STEPS`` steps, which multiplies the length of a step by ``STEPS + 1``. Rows that have reached their root take
    no further part, so a root that most rows point at is no key of any later join.
    """
    total = pointers.count()
    rest, done = pointers.where("id <> c"), pointers.where("id = c").select("id", "c")
    while True:
        at = rest.select("id", "c")
        for _ in range(STEPS):
            at = follow(pointers, at, total).select("id", F.col("c").alias("before"), F.coalesce("cc", "c").alias("c"))
        moved = done.withColumn("open", F.lit(False)).unionByName(at.select("id", "c", (F.col("before") != F.col("c")).alias("open")))
        jumped, left = counted(moved, "jump", F.col("open"))
        discard(pointers)
        pointers = view(jumped, jumped.select("id", "c"))
        if not left:
            return pointers
        rest, done = jumped.where("open"), jumped.where("not open").select("id", "c")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(src, dst)``, bigint ids, any direction → ``(id, component)`` for every endpoint of a non-loop edge.

    ``component`` is the smallest id that can be reached. An edgeless input gives no rows.
    """
    rest, left = counted(undirected(edges), "edges", F.lit(True))
    maps: list[DataFrame] = []
    while left:
        ends = rest.select(F.col("a").alias("id"), F.col("b").alias("n")).unionAll(rest.select(F.col("b").alias("id"), F.col("a").alias("n")))
        pointers = ends.groupBy("id").agg(F.min("n").alias("n")).select("id", F.least("id", "n").alias("c"))
        pointers = compress(materialize(pointers, "pointers"))
        maps.append(pointers)
        a = follow(pointers, rest.select(F.col("a").alias("c"), "b"), left).select("b", F.col("cc").alias("src"))
        b = follow(pointers, a.select(F.col("b").alias("c"), "src"), left).select("src", F.col("cc").alias("dst"))
        nxt, left = counted(undirected(b), "edges", F.lit(True))
        discard(rest)
        rest = nxt
    if not maps:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = maps[-1].select("id", F.col("c").alias("component"))
    for pointers in reversed(maps[:-1]):
        later = labels.select(F.col("id").alias("c"), F.col("component").alias("later"))
        labels = pointers.join(later, "c", "left").select("id", F.coalesce("later", "c").alias("component"))
    return labels
