"""Connected components of symmetric graphs, their sizes and hubs, and the comparison of labellings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graphs import Graph
from graphloom.operators.contraction import compress, connected_components, follow
from graphloom.operators.transform import symmetrize
from graphloom.runtime import counted, discard, materialize, observed


def minimum_pointers(graph: Graph) -> DataFrame:
    """``id, c``: the smallest of each vertex and its neighbours."""
    low = symmetrize(graph.edges).groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("n"))
    return graph.vertices.join(low, "id", "left").select("id", F.least("id", F.coalesce("n", "id")).alias("c"))


def pointer_jump(pointers: DataFrame) -> DataFrame:
    """``id, root``: where the pointers ``(id, c)`` lead; roots point at themselves. Doubling: logarithmic rounds."""
    return compress(materialize(pointers, "pointers")).select("id", F.col("c").alias("root"))


def hooked(met: DataFrame) -> DataFrame:
    """``met(id, old, c)``, written, after each vertex that an old label names took the smallest new label of those that had it."""
    hooks = met.where("c < old").groupBy(F.col("old").alias("id")).agg(F.min("c").alias("h"))
    return met.join(hooks, "id", "left").withColumn("c", F.least("c", F.coalesce("h", "c"))).drop("h")


def jumped(met: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """``rows(id, old, c)`` after looking ``c`` up in ``met(id, c)``; labels only get smaller."""
    return follow(met.select("id", "c"), rows, total).withColumn("c", F.least("c", F.coalesce("cc", "c"))).drop("cc")


def cc_min_label(graph: Graph) -> DataFrame:
    """``id, component``: the smallest id of the component, by rounds of minimum label and pointer jump.

    Only vertices whose label changed push in the next round. The vertex that a label names takes part in what its
    followers find, and every label is looked up once in a round.
    """
    edges = materialize(symmetrize(graph.edges), "edges")
    labels, moved = counted(minimum_pointers(graph).withColumn("moved", F.col("id") != F.col("c")), "labels", F.col("moved"))
    total = labels.count()
    while moved:
        active = labels.where("moved").select(F.col("id").alias("src"), "c")
        pushed = edges.join(active, "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("pushed"))
        met = labels.join(pushed, "id", "left").select("id", F.col("c").alias("old"), F.least("c", F.coalesce("pushed", "c")).alias("c"))
        met = materialize(met, "met")
        after = jumped(met, hooked(met), total).select("id", "c", (F.col("c") != F.col("old")).alias("moved"))
        fresh, moved = counted(after, "labels", F.col("moved"))
        discard(labels, met)
        labels = fresh
    discard(edges)
    return labels.select("id", F.col("c").alias("component"))


def cc_pointer_jump(graph: Graph) -> DataFrame:
    """The same labels by contraction: hook to the smallest neighbour, jump to the root, contract, repeat."""
    found = connected_components(graph.edges.select("src", "dst"))
    return graph.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def symmetric_degree(graph: Graph) -> DataFrame:
    counts = symmetrize(graph.edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return graph.vertices.join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def component_hubs(graph: Graph, labels: DataFrame) -> DataFrame:
    """``component, hub, degree``: the vertex of largest degree, of several the smallest."""
    best = labels.join(symmetric_degree(graph), "id").groupBy("component").agg(F.max(F.struct("degree", (-F.col("id")).alias("neg"))).alias("m"))
    return best.select("component", (-F.col("m.neg")).alias("hub"), F.col("m.degree").alias("degree"))


#: Share of active edges below which the changed vertices push instead of all others pulling.
SPARSE = 0.01
#: Rows (of edges or vertices) past which no table of the rounds is broadcast, but for a frontier of at most ``FEW`` vertices.
WIDE, FEW = 250_000, 100_000


def cc_zero_hub(graph: Graph) -> DataFrame:
    """Labels with 0 for the component of a vertex of largest degree and smallest id + 1 for the others.

    Zero is planted at that hub and pushed first, since it will win most of a skewed graph. A vertex with 0 has converged
    and neither pulls nor jumps again. While the frontier is dense (its vertices and their degrees, as a share of the edges)
    the others pull from all their neighbours, then the changed ones push. Labels above 0 are looked up as in ``cc_min_label``.
    """
    edges, seen = observed(symmetrize(graph.edges), "edges", n=F.count(F.lit(1)))
    e = seen["n"]
    degree, seen = observed(symmetric_degree(graph), "degrees", e > WIDE, n=F.count(F.lit(1)))
    total = seen["n"]
    wide = max(e, total) > WIDE
    frontier = {"moved": F.count_if("moved"), "reach": F.sum(F.when(F.col("moved"), F.col("degree") + 1))}
    hub = degree.agg(F.max(F.struct("degree", (-F.col("id")).alias("neg"))).alias("m")).select((-F.col("m.neg")).alias("hub"))  # one row
    near = edges.join(F.broadcast(hub), F.col("src") == F.col("hub")).select(F.col("dst").alias("id")).unionAll(hub.select(F.col("hub").alias("id"))).distinct()
    planted = degree.join(near.withColumn("zero", F.lit(True)), "id", "left")
    first = planted.select("id", "degree", F.when(F.col("zero"), 0).otherwise(F.col("id") + 1).cast("long").alias("label"), F.lit(True).alias("moved"))
    labels, seen = observed(first, "labels", wide, **frontier)
    dense = True
    while seen["moved"]:
        open_ = labels.where("label > 0").select(F.col("id").alias("dst"))
        source = (labels if dense else labels.where("moved")).select(F.col("id").alias("src"), F.col("label").alias("low"))
        if dense:
            met = edges.join(open_, "dst", "left_semi").join(source, "src")
        else:
            met = edges.join(F.broadcast(source) if seen["moved"] <= FEW else source, "src").join(open_, "dst", "left_semi")
        met = met.groupBy(F.col("dst").alias("id")).agg(F.min("low").alias("low"))
        # label L > 0 names vertex L - 1; -1 stands for the planted zero and names none
        met = labels.join(met, "id", "left").select("id", "degree", (F.col("label") - 1).alias("old"), (F.least("label", F.coalesce("low", "label")) - 1).alias("c"))
        met = materialize(met, "met", wide)
        rows = hooked(met)
        after = jumped(met, rows.where("c >= 0"), total).unionByName(rows.where("c < 0"))
        after = after.select("id", "degree", (F.col("c") + 1).alias("label"), (F.col("c") != F.col("old")).alias("moved"))
        fresh, seen = observed(after, "labels", wide, **frontier)
        discard(labels, met)
        labels = fresh
        dense = dense and bool(seen["moved"]) and seen["reach"] / max(e, 1) >= SPARSE
    discard(edges, degree)
    return labels.select("id", F.col("label").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def component_count(labels: DataFrame) -> DataFrame:
    return labels.agg(F.countDistinct("component").alias("components"))


def labelling_violations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Labels of either side that meet more than one label of the other: 0 if both cut the vertices alike."""
    pairs = a.select("id", F.col("component").alias("a")).join(b.select("id", F.col("component").alias("b")), "id").select("a", "b").distinct()
    left = pairs.groupBy("a").count().where("count > 1").select(F.lit(1).alias("x"))
    right = pairs.groupBy("b").count().where("count > 1").select(F.lit(1).alias("x"))
    return left.unionAll(right).agg(F.count("x").alias("violations"))
