"""Near-duplicate vectors by sorted projection passes.

In each pass vectors are ordered lexicographically by 64 concatenated random sign hashes, and every vector is
compared with its ``window`` neighbours on either side: the order is cut into blocks of ``2 * window`` ranks that
overlap by ``window``, and a block is one small matrix product in double precision. Pairs found in all passes are
united. The first number of passes follows from the number of vectors, the window and the wanted recall for a pair just
at the threshold, if every hash halves the vectors. Where many point the same way it does not, so the recall is
measured on the vectors themselves: a bounded sample of them gets a made partner at the threshold each, which takes
part in the passes, and passes are added until enough partners have stood within the window of their vectors.

Equal vectors are one class with a count. A block passes on a star for each group that its verified pairs
connect, never all pairs. Links are then counted exactly inside each component, by blocks of members against
blocks of members, so no count depends on which pass found a pair and a component of any size spreads over
many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import grouped, split_join
from graphloom.operators.contraction import connected_components
from graphloom.runtime import discard, materialize

THRESHOLD, WINDOW, RECALL, MEMBERS = 0.95, 512, 0.999, 512
#: Made partners at most, the share of them that has to be found, and how often the passes may be doubled for it.
PROBES, FOUND, DOUBLED = 2000, 0.99, 4


def passes_for(n: int, threshold: float, window: int, recall: float) -> int:
    """Passes until a pair at the threshold has stood within the window of each other with probability ``recall``."""
    bits = max(0.0, math.log2(max(n, 1) / window))
    once = (1 - math.acos(threshold) / math.pi) ** bits
    return 4 if once > 0.999 else max(4, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hashes(x: np.ndarray, number: int, seed: int) -> np.ndarray:
    """The concatenated sign hashes of a pass as numbers that sort like them."""
    planes = np.random.default_rng([seed, number, x.shape[1]]).standard_normal((x.shape[1], 64))
    bits = np.packbits(x @ planes > 0, axis=1)
    return (np.ascontiguousarray(bits).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def stars(close: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation the smallest row that it is connected to."""
    label = np.arange(len(close))
    while True:
        new = np.where(close, label[None, :], len(close)).min(axis=1)
        new = np.minimum(new, label)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def usable() -> Column:
    """Whether a row can link: it has an id and a vector of finite numbers, not all zero."""
    e, inf = F.col("embedding"), float("inf")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf)) & F.exists(e, lambda v: v != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite, F.lit(False))


def classes_of(vectors: DataFrame) -> DataFrame:
    """``rep, first_id, n, dim, embedding``: each different vector once, under a number of its own."""
    same = vectors.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return same.select(F.monotonically_increasing_id().alias("rep"), "first_id", "n", F.size("embedding").alias("dim"), "embedding")


def partners(x: np.ndarray, reps: np.ndarray, threshold: float, seed: int) -> np.ndarray:
    """For each unit vector another one at the threshold, in a random direction."""
    out = np.empty_like(x)
    for i, rep in enumerate(reps.tolist()):
        r = np.random.default_rng([seed, rep]).standard_normal(x.shape[1])
        r -= (r @ x[i]) * x[i]
        size = np.sqrt(r @ r)
        out[i] = threshold * x[i] + (math.sqrt(1 - threshold**2) / size * r if size > 1e-9 else 0)
    return out


def ranked_passes(classes: DataFrame, passes: range, probe_every: int, threshold: float, seed: int) -> DataFrame:
    """``pass, dim, rep, probe, rank``: the orders of all vectors and, of one in ``probe_every`` (0: none), of its partner too."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims):
                own = b.filter(pa.array(dims == dim))
                x, reps = matrix(own.column(2)), own.column(0).to_numpy()
                chosen = own.column(3).to_numpy() % probe_every == 0 if probe_every else np.zeros(len(x), bool)
                probe = np.repeat([False, True], [len(x), chosen.sum()])
                x = np.concatenate([x, partners(x[chosen], reps[chosen], threshold, seed)])
                reps = pa.array(np.concatenate([reps, reps[chosen]]))
                for k in passes:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), pa.array(np.full(len(x), dim, np.int32)), pa.array(hashes(x, k, seed)), reps, pa.array(probe)], ["pass", "dim", "key", "rep", "probe"])

    keys = classes.select("rep", "dim", "embedding", F.pmod(F.xxhash64("embedding"), F.lit(1 << 40)).alias("h")).mapInArrow(project, "pass int, dim int, key bigint, rep bigint, probe boolean")
    order = ["pass", "dim", "key", "rep", "probe"]
    laid = keys.repartitionByRange(*order).sortWithinPartitions(*order).select("pass", "dim", "rep", "probe", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    laid = materialize(laid, "order")
    per = laid.groupBy("pass", "dim", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    base = per.select("pass", "dim", "part", "first", F.coalesce(F.sum("size").over(W.partitionBy("pass", "dim").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return laid.join(base, ["pass", "dim", "part"]).select("pass", "dim", "rep", "probe", (F.col("base") + F.col("at") - F.col("first")).alias("rank"))


def neighbours(classes: DataFrame, threshold: float, window: int, recall: float, seed: int) -> list[DataFrame]:
    """``src, dst``: stars of the verified pairs of all passes, a table for each round of passes."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (reps, vectors) in grouped(batches, 3):
            x, ids = matrix(vectors), reps.to_numpy()
            by = np.argsort(ids)
            ids, x = ids[by], x[by]
            label = stars(x @ x.T >= threshold)
            linked = label != np.arange(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[label[linked]]), pa.array(ids[linked])], ["src", "dst"])

    total = classes.count()
    first = passes_for(total, threshold, window, recall)
    # with few vectors every pair stands within the window, or nearly
    every = max(20, -(-total // PROBES)) if total > 4 * window else 0
    out, found, probes, done, todo = [], set(), 0, 0, first
    for round_ in range(DOUBLED + 1):
        ranked = materialize(ranked_passes(classes, range(done, done + todo), every, threshold, seed), "ranked")
        block = F.floor(F.col("rank") / window)
        placed = ranked.where("not probe").select("pass", "dim", "rep", F.explode(F.array(block - 1, block)).alias("block")).where("block >= 0")
        full = placed.join(classes.select("rep", "embedding"), "rep").repartition("pass", "dim", "block").sortWithinPartitions("pass", "dim", "block")
        out.append(materialize(full.select("pass", "dim", "block", "rep", "embedding").mapInArrow(compare, "src bigint, dst bigint").distinct(), "links"))
        done, todo = done + todo, done + todo
        if not every:
            break
        made = ranked.where("probe").select("pass", "rep", F.col("rank").alias("made"))
        near = made.join(ranked.where("not probe"), ["pass", "rep"]).groupBy("rep").agg(F.min(F.abs(F.col("rank") - F.col("made"))).alias("off"))
        measured = near.collect()  # a row for each probe, about PROBES
        probes = len(measured)
        found |= {r["rep"] for r in measured if r["off"] <= window}
        discard(ranked)
        if len(found) >= FOUND * probes:
            break
    return out


def link_counts(members: DataFrame, total: int, threshold: float) -> DataFrame:
    """``rep, links`` from ``members(component, rep, n, dim, embedding)``, at most ``total``: rows of other classes within the threshold."""
    sizes = materialize(members.groupBy("component", "dim").agg(F.count(F.lit(1)).alias("size")), "sizes")
    parts = sizes.select("component", "dim", "size", F.ceil(F.col("size") / MEMBERS).cast("int").alias("parts"))
    own = split_join(members, parts, ["component", "dim"], "inner", "size", total).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    sent = own.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("component", "dim", F.least("c", "x").alias("i"), F.greatest("c", "x").alias("j"), "c", "rep", "n", "embedding")
    sent = sent.repartition("component", "dim", "i", "j").sortWithinPartitions("component", "dim", "i", "j")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, i, j), (c, reps, n, vectors) in grouped(batches, 4):
            x, c, n = matrix(vectors), c.to_numpy(), n.to_numpy()
            left, right = np.flatnonzero(c == i), np.flatnonzero(c == j)
            close = x[left] @ x[right].T >= threshold
            links = np.zeros(len(x), np.int64)
            if i == j:
                np.fill_diagonal(close, False)
                links[left] = close @ n[right]
            else:
                links[left], links[right] = close @ n[right], n[left] @ close
            yield pa.RecordBatch.from_arrays([reps, pa.array(links)], ["rep", "links"])

    return sent.mapInArrow(count, "rep bigint, links bigint").groupBy("rep").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL, seed: int = 5) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with
    nothing. Vectors of different lengths never link. Equal vectors are linked with each other; every row is a vector of
    its own, also where ids are repeated. An empty table gives no rows. Only ``vec_id`` and ``embedding`` are read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = rows.where(usable())
    classes = materialize(classes_of(good), "vectors")
    total = classes.count()
    found = neighbours(classes, threshold, window, recall, seed)
    groups = materialize(connected_components(reduce(DataFrame.unionAll, found)).withColumnRenamed("id", "rep"), "groups")
    discard(*found)
    counts = link_counts(classes.join(groups, "rep"), total, threshold)
    named = classes.join(groups, "rep", "left").join(counts, "rep", "left")
    named = materialize(named.select("first_id", "n", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "embedding"), "named")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    named = split_join(named, least, ["component"], "inner", "size", total).select("embedding", "n", "n_links", "component_id")
    named = materialize(named, "classes")
    known = split_join(good, named, ["embedding"], "inner", "n", good.count()).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    out = known.unionByName(rows.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
