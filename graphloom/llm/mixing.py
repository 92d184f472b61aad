"""Mixing sources to target weights by systematic sampling.

A source's target is its share of all words by weight, at most ``max_repeat`` times its size; what the cap
frees is shared again by weight. Every document of a source expects target / size copies. Within the source
the expected copies are prefix-summed, one offset is added and a document is emitted once per integer
boundary that its interval crosses.

The order inside a source is chunk by chunk (a hash of the document's id and text) and by size within a chunk,
so each chunk is a sample stratified by size. Chunks hold about ``chunk_rows`` rows however large a source is,
only chunk counts are prefix-summed, in ranges, and no task ever holds a source. All random numbers are hashes, so
reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import all_of, fresh, split_join, text_or_empty
from graphloom.operators.numbering import numbered, running_sum
from graphloom.runtime import discard, is_empty, materialize

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in the text; null has none."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def unit(*parts) -> Column:
    """A number in [0, 1) from the md5 of the parts: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """``sizes(source, source_size)``, a row for each source → ``source, source_size, target``.

    Weights repeat over the sources by code point, null last. A source's target is the level times its weight, at most
    its cap. The level starts as if there were no caps; each round takes out the sources above theirs and shares what is
    left among the others, until none is above. Rounds are sums over the table, however many sources there are.
    """
    kind = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("at") % len(weights) + 1).cast("int"))
    s = numbered(sizes, [F.col("source").asc_nulls_last()], "at").select("source", "source_size", kind.alias("weight"), (F.col("source_size") * float(max_repeat)).alias("cap"))
    s = materialize(s, "sources")
    level, above = 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight") if above >= 0 else F.lit(False)
        sums = s.agg(F.sum("source_size"), F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if sums[3] == above or not sums[2]:
            break
        level, above = (sums[0] - sums[1]) / sums[2], sums[3]
    return s.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3, chunk_rows: int = 512, seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken, k_text`` for every row of ``docs``.

    Null and empty texts have size 0: they have their place in the order but take no words; very long ones count as
    whole. A null source is a source of its own, the last. Rows that are equal in all columns read stand next to each
    other; each gets its own interval. An empty input gives no rows. Columns besides ``doc_id``, ``source`` and ``text``
    are not read, so they may have any name.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(text_or_empty(F.col("text"))).alias("k_text"))
    rows = materialize(rows, "mix")
    total = rows.count()
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "k_text")), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("chunk", h % max(1, -(-total // chunk_rows))).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    per_chunk = materialize(rows.groupBy("source", "key", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "chunks")
    goal = targets(per_chunk.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    goal = goal.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("key"), "source_size", "target")
    before = materialize(running_sum(per_chunk.select("key", "chunk", "n"), [F.asc("key"), F.asc("chunk")], "n", "before"), "before")
    first = before.groupBy("key").agg(F.min("before").alias("first"), F.count(F.lit(1)).alias("times")).join(goal, "key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = split_join(before, materialize(first, "firsts"), ["key"], "inner", "times", before.count())
    base = base.select("key", "chunk", (F.col("before") - F.col("first")).alias("base"), "n", "source_size", "target", rate.alias("rate"))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("key", "chunk").orderBy("size", "doc_id", "k_text")).cast("long"))
    placed = ranked.join(base.drop("n"), ["key", "chunk"])
    u = unit(F.lit(seed), F.coalesce("source", F.lit("null")))
    at = F.col("base") + F.col("rank")
    copies = F.floor(at * F.col("rate") + u) - F.floor((at - 1) * F.col("rate") + u)
    out = placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "k_text")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "k_text")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3, **how) -> DataFrame:
    """The mix itself: rows of ``docs`` repeated as often as drawn, all columns kept, plus ``copy`` (from 1).

    Equal rows (same id, source and text) share one drawing per row; their copies are pooled over them. A column
    ``copy`` of the input is replaced; all others may have any name.
    """
    drawn = mixed(docs, weights, max_repeat, **how).groupBy("doc_id", "source", "k_text").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("again"))
    drawn = materialize(drawn.where("n > 0"), "drawn")
    (text,) = fresh(docs.columns, "loom_md5")
    one = docs.withColumn(text, F.md5(text_or_empty(F.col("text"))))
    on = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").eqNullSafe(F.col("m.source")) & (F.col(f"d.{text}") == F.col("m.k_text"))
    columns = [c for c in docs.columns if c.lower() != "copy"]
    copies = lambda side, part: side.alias("d").join(part.alias("m"), on).select(*all_of(columns, "d"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("m.n"))).alias("copy"))
    out = copies(one, drawn.where("again = 1"))
    twins = materialize(drawn.where("again > 1"), "twins")
    if is_empty(twins):
        discard(twins)
        return out
    some = one.alias("d").join(twins.alias("m"), on, "left_semi").dropDuplicates(["doc_id", "source", text])
    return out.unionByName(copies(some, twins))
