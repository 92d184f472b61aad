"""Benchmark decontamination: hash set of normalised test n-grams against training token windows.

Every benchmark text is cut into windows of ``n`` words (a shorter text is one window). A 64-bit anchor hash
of each window (its first, middle and last word) goes into a hash set that is shipped with the plan; the scan
tests every word position of every document against it inside the row, and only positions that pass are
expanded, normalised exactly and joined with the windows themselves. No Python, no shuffle of texts.

The set is only shipped while the benchmark has at most ``max_windows`` windows; beyond it every position is
expanded and the windows are joined by a shuffle. Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, own, row_key, text_or_empty
from graphloom.runtime import materialize

#: Fixed value: the characters that separate words (in A-Z, a-z, 0-9 and everything outside ASCII are words).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MAX_WINDOWS = 200_000
#: Contaminated documents up to which their keys are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 100_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(text_or_empty(text), SEPARATORS), lambda w: w != "")


def windows_of(benchmark: DataFrame, n: int) -> DataFrame:
    """``(item, gram, len)``: each window of each item once. Items without words have none."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("len", F.least(F.size("w"), F.lit(n)))
    grams = F.expr(f"transform(sequence(0, size(w) - len), p -> {gram('p', 'len')})")
    return items.select("item", "len", F.explode(grams).alias("gram")).distinct()


def gram(at: str, length: str) -> str:
    """SQL for the words of ``w`` from a place on, joined by spaces; it touches these words only."""
    return f"array_join(transform(sequence({at}, {at} + {length} - 1), i -> w[i]), ' ')"


def anchor(at: str, length: int) -> str:
    """SQL for the hash of three words of the window of ``length`` at the 0-based place ``at`` of the words ``w``."""
    return f"xxhash64(w[{at}], w[{at} + {length // 2}], w[{at} + {length - 1}], {length})"


def candidates(windows: DataFrame, length: int, small: bool) -> Column:
    """``(p, len)`` of the places of ``w`` that may start a window of ``length``: those whose anchor is in the hash set.

    The set stands in the plan as an ``IN`` list, which Spark tests by hashing. It is no more than a filter: what
    passes is compared word by word later.
    """
    places = f"if(size(w) >= {length}, sequence(0, size(w) - {length}), cast(array() as array<int>))"
    if small:
        known = windows.where(F.col("len") == length).select(F.split("gram", " ").alias("w")).select(F.expr(anchor("0", length)).alias("h")).distinct()
        lowest = "(-9223372036854775807L - 1L)"
        listed = ", ".join(f"{r[0]}L" if r[0] > -(2**63) else lowest for r in known.collect())  # at most max_windows numbers
        places = f"filter({places}, p -> {anchor('p', length)} in ({listed}))"
    return F.expr(f"transform({places}, p -> struct(p as p, {length} as len))")


def scan(docs: DataFrame, windows: DataFrame, max_windows: int) -> tuple[DataFrame, bool]:
    """One row per document: key, number of words and candidates (with the text if there are any); whether the set was shipped."""
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most n values
    small = windows.limit(max_windows + 1).count() <= max_windows
    rows = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), "text", words_of(ascii_lower(F.col("text"))).alias("w"))
    found = [candidates(windows, length, small) for length in lengths]
    cand = F.concat(*found) if found else F.array().cast("array<struct<p:int,len:int>>")
    rows = rows.select("doc_id", "k_id", "k_text", "text", F.size("w").cast("long").alias("n_words"), cand.alias("cand"))
    return rows.withColumn("text", F.when(F.size("cand") > 0, F.col("text"))), small


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, items (array), contaminated, covered``.

    ``covered`` holds the places (from 0) of the words inside an occurrence. Null and empty texts have no words and are
    never contaminated; very long ones are tested at every word; equal rows get equal results; an empty benchmark hits
    nothing, an empty table gives no rows; columns besides ``doc_id`` and ``text`` are not read, so they may have any name.
    """
    windows = materialize(windows_of(benchmark, n), "windows")
    rows, small = scan(docs, windows, max_windows)
    rows = materialize(rows, "decontaminate")
    maybe = rows.where(F.size("cand") > 0)
    exact = maybe.dropDuplicates(["k_id", "k_text"]).select("k_id", "k_text", words_of(ascii_lower(F.col("text"))).alias("w"), "cand")
    grams = F.expr(f"transform(cand, c -> struct(c.p as p, c.len as len, {gram('c.p', 'c.len')} as gram))")
    at = exact.select("k_id", "k_text", F.explode(grams).alias("c")).select("k_id", "k_text", "c.*")
    hits = at.join(F.broadcast(windows) if small else windows, ["gram", "len"])
    per = hits.groupBy("k_id", "k_text").agg(F.array_sort(F.collect_set("item")).alias("items"), F.collect_set(F.struct("p", "len")).alias("at"))
    per = per.select("k_id", "k_text", "items", F.expr("array_sort(array_distinct(flatten(transform(at, x -> sequence(x.p, x.p + x.len - 1)))))").alias("covered"))
    none = [F.array().cast("array<string>").alias("items"), F.array().cast("array<int>").alias("covered")]
    joined = maybe.select("doc_id", "k_id", "k_text", "n_words").join(per, ["k_id", "k_text"], "left")
    joined = joined.select("doc_id", "k_id", "k_text", "n_words", F.coalesce("items", none[0]).alias("items"), F.coalesce("covered", none[1]).alias("covered"))
    out = rows.where(F.size("cand") == 0).select("doc_id", "k_id", "k_text", "n_words", *none).unionByName(joined)
    return out.withColumn("n_hit", F.size("covered").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = MAX_WINDOWS, spans: bool = False) -> DataFrame:
    """``docs`` without its contaminated documents or, with ``spans``, without the words that windows cover.

    Columns and their order stay, whatever their names. Removing spans rewrites a contaminated text as its remaining
    words (in the original spelling) joined by spaces; other texts stay as they are.
    """
    found = contamination(docs, benchmark, n, max_windows).where("contaminated").select("k_id", "k_text", "covered").dropDuplicates(["k_id", "k_text"])
    found = materialize(found, "contaminated")
    if found.count() <= BROADCAST_ROWS:
        keys = F.broadcast(found.select("k_id", "k_text"))
    else:
        keys = found.select("k_id", "k_text")
    key_id, key_text = row_key(F.col("d.doc_id"), F.col("d.text"))
    on = (key_id == F.col("f.k_id")) & (key_text == F.col("f.k_text"))
    d = docs.alias("d")
    if not spans:
        return d.join(keys.alias("f"), on, "left_anti")
    both = d.join(found.alias("f"), on, "left")
    left = F.filter(words_of(F.col("d.text")), lambda _, i: ~F.array_contains("f.covered", i))
    text = F.when(F.col("f.covered").isNull(), F.col("d.text")).otherwise(F.array_join(left, " "))
    return both.select(*(text.alias(c) if c == "text" else own(c, "d") for c in docs.columns))
