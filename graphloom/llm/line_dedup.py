"""Line dedup by a log-template tree of fixed depth, in DataFrame functions only.

A line is split at white space and tokens with digits become ``<*>``, unless they are over half of the line. The
tree has the number of tokens on its first level and the leading tokens on the next ``depth`` levels. A leaf
that holds different lines of enough texts generalises them: each token of a line is weighed by the texts of the leaf
that have it at the same place, and the line's template keeps the ``similarity`` share of its tokens that weigh
most (and those that weigh as much); the others are variable fields, ``<*>``. The weights are compared inside the
line, so a field stays a field however many documents there are, and several templates may share a leaf. A line
whose kept tokens do not all stand in enough texts is a template by itself.

A template that recurs in enough different texts is dropped from every document that has it: in ``min_docs`` texts
or, from ``long`` tokens on, where chance repeats nothing, in ``long_docs``. Copies of a text are one text. Documents
that are near copies of each other are no more witnesses than one: where over ``copied`` of a document's words are
in two or more such templates, it counts by the rarest of these, which its copies share. A document of one line
only is no witness, since its line is the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fresh, own, row_key, split_join, text_or_empty
from graphloom.runtime import discard, materialize

WILD = "<*>"
MIN_DOCS, LONG, LONG_DOCS = 8, 50, 3
#: What only lines have whose tokens hold digits or don't stand one blank apart (or two blanks); a token with digits, tried only where a token begins.
ODD, DIGITS = r"[0-9\t\x0b\f\r]", "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def digest(text: Column) -> Column:
    """60 bits of the MD5 as a number that any engine gives."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def lines_of(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """``k_id, k_text, alone, pos, n, leaf, line`` for each line of at least ``min_tokens`` tokens.

    ``line`` is the tokens with a blank between them; no token has white space, so ``tokens_of`` gets them back. Arrays of tokens are only
    made for the few lines that need them.
    """
    alone = ~F.contains(F.btrim(text_or_empty(F.col("text")), F.lit(" \n")), F.lit("\n"))
    keyed = docs.select(*row_key(F.col("doc_id"), F.col("text")), alone.alias("alone"), F.split(text_or_empty(F.col("text")), "\n").alias("lines"))
    split = keyed.select("k_id", "k_text", "alone", F.posexplode("lines").alias("pos", "raw"))
    plain = F.trim("raw")
    blanks = lambda line: F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    even = F.regexp_replace(plain, r"\s+", " ")
    masked = F.when(F.regexp_count(even, F.lit(DIGITS)) * 2 <= blanks(even) + 1, F.regexp_replace(even, DIGITS, WILD)).otherwise(even)
    line = F.when(F.col("raw").rlike(ODD) | F.contains("raw", F.lit("  ")), masked).otherwise(plain)
    # exploded, since the filter would be pushed under a plain column and make it twice
    toks = split.select("k_id", "k_text", "alone", "pos", F.explode(F.array(line)).alias("line"))
    toks = toks.withColumn("n", blanks(F.col("line")) + 1).where(F.col("n") >= min_tokens)
    leaf = F.xxhash64("n", F.substring_index("line", " ", depth))
    return toks.select("k_id", "k_text", "alone", "pos", "n", leaf.alias("leaf"), "line")


def tokens_of(line: str) -> Column:
    return F.split(line, " ")


def crowded(read: DataFrame, need: Column) -> DataFrame:
    """The lines of ``read`` (written) in leaves that hold enough texts, with the leaf's ``texts`` and the line's ``form``, written.

    Only there a template can recur, since all lines of one are in one leaf.
    """
    leaves = read.groupBy("leaf", "n", "k_text").agg(F.count(F.lit(1)).alias("rows")).groupBy("leaf", "n").agg(F.count(F.lit(1)).alias("texts"), F.sum("rows").alias("rows"))
    leaves = materialize(leaves.where(F.col("texts") >= need).select("leaf", "texts", "rows"), "crowded")
    out = materialize(split_join(read, leaves, ["leaf"], "inner", "rows", read.count()).drop("rows").withColumn("form", digest(F.col("line"))), "candidates")
    discard(leaves)
    return out


def generalised(inside: DataFrame, total: int, depth: int, similarity: float, need: Column) -> DataFrame:
    """``leaf, form, template, lines`` for the lines ``inside`` varied leaves (written, with the leaf's ``texts``) that follow a template."""
    cells = inside.select("leaf", "n", "k_text", F.posexplode("tokens").alias("at", "token")).where(F.col("at") >= depth)
    weights = cells.groupBy("leaf", "n", "at", "token", "k_text").agg(F.count(F.lit(1)).alias("rows")).groupBy("leaf", "n", "at", "token").agg(F.count(F.lit(1)).alias("weight"), F.sum("rows").alias("rows"))
    # lighter tokens can neither be kept nor change which are
    weights = materialize(weights.where(F.col("weight") >= need).select("leaf", "at", "token", "weight", "rows"), "weights")
    forms = materialize(inside.groupBy("leaf", "form").agg(F.first("tokens").alias("tokens"), F.first("n").alias("n"), F.first("texts").alias("texts"), F.count(F.lit(1)).alias("lines")), "forms")
    spread = forms.select("leaf", "form", F.posexplode("tokens").alias("at", "token")).where(F.col("at") >= depth)
    weighed = split_join(spread, weights, ["leaf", "at", "token"], "inner", "weight", total)
    per = weighed.groupBy("leaf", "form").agg(F.collect_list(F.struct("weight", "at", "token")).alias("held"))
    known = forms.join(per, ["leaf", "form"], "left").select("leaf", "form", "lines", "n", "texts", F.slice("tokens", 1, depth).alias("lead"), F.coalesce("held", F.array().cast("array<struct<weight:bigint,at:int,token:string>>")).alias("held"))
    lead = F.least(F.lit(depth), F.col("n"))
    rank = F.ceil(F.col("n") * F.lit(similarity)).cast("int") - lead
    weights_ = F.sort_array(F.transform("held", lambda x: x["weight"]), asc=False)
    least = F.when(rank <= 0, F.col("texts")).otherwise(F.get(weights_, rank - 1))
    known = known.withColumn("least", least).where(F.col("least").isNotNull())
    # the bound goes in as a variable of its own, or it would be made again for every token
    heavy = F.transform(F.array("least"), lambda low: F.filter("held", lambda x: x["weight"] >= low))[0]
    kept = F.sort_array(F.transform(heavy, lambda x: F.struct(x["at"].alias("at"), x["token"].alias("token"))))
    name = F.concat_ws(" ", F.col("n").cast("string"), "lead", F.transform(kept, lambda x: F.concat(x["at"].cast("string"), F.lit(":"), x["token"])))
    out = materialize(known.select("leaf", "form", "lines", digest(name).alias("template")), "generalised")
    discard(weights, forms)
    return out


def templates(lines: DataFrame, total: int, depth: int, similarity: float, need: Column) -> DataFrame:
    """``k_id, k_text, alone, pos, n, template`` of ``lines`` (written, in crowded leaves): the hash of what each line is an instance of."""
    leaves = lines.groupBy("leaf", "n").agg(F.min("form").alias("lo"), F.max("form").alias("hi"), F.count(F.lit(1)).alias("rows"))
    varied = materialize(leaves.where(F.col("lo") != F.col("hi")).select("leaf", "rows"), "leaves")
    inside = materialize(split_join(lines, varied, ["leaf"], "inner", "rows", total).drop("rows").withColumn("tokens", tokens_of("line")).drop("line"), "inside")
    known = generalised(inside, total, depth, similarity, need)
    columns = ["k_id", "k_text", "alone", "pos", "n"]
    general = split_join(inside.select(*columns, "leaf", "form"), known, ["leaf", "form"], "left", "lines", total)
    outside = split_join(lines.select(*columns, "leaf", "form"), varied.select("leaf", "rows", F.lit(True).alias("varied")), ["leaf"], "left", "rows", total).where("varied is null")
    out = general.select(*columns, F.coalesce("template", "form").alias("template")).unionByName(outside.select(*columns, F.col("form").alias("template")))
    out = materialize(out, "templates")
    discard(varied, inside, known)
    return out


def witnesses(marked: DataFrame, sizes: DataFrame, copied: float) -> DataFrame:
    """``template, witness``, once each: the texts that the templates of ``marked`` lines stand in, copies by their family; ``sizes(k_text, all)``."""
    per = marked.groupBy("k_text").agg(F.sum("n").alias("again"), F.min(F.struct("texts", "template")).alias("rarest"), F.min("template").alias("lo"), F.max("template").alias("hi"), F.max("alone").alias("alone"))
    copy = (F.col("again") > F.col("all") * copied) & (F.col("lo") != F.col("hi"))
    special = materialize(per.join(sizes, "k_text").where(F.col("alone") | copy).select("k_text", "alone", F.col("rarest.template").alias("family")), "families")
    pairs = marked.select("template", "k_text").distinct()
    found = pairs.join(special, "k_text", "left").where(~F.coalesce("alone", F.lit(False)))
    family = F.when(F.col("family").isNotNull(), F.concat(F.lit("copies "), F.col("family").cast("string"))).otherwise(F.concat(F.lit("text "), F.col("k_text").cast("string")))
    return found.select("template", family.alias("witness")).distinct()


def recurring(docs: DataFrame, depth: int, min_docs: int, min_tokens: int, similarity: float, long: int, long_docs: int, copied: float) -> DataFrame:
    """``k_id, k_text, pos`` of each line to drop."""
    need = F.when(F.col("n") >= long, long_docs).otherwise(min_docs)
    read = materialize(lines_of(docs, depth, min_tokens), "lines")
    near = crowded(read, need)
    total = near.count()
    lines = templates(near, total, depth, similarity, need)
    discard(near)
    texts = lines.groupBy("template", "n", "k_text").agg(F.count(F.lit(1)).alias("rows")).groupBy("template", "n").agg(F.count(F.lit(1)).alias("texts"), F.sum("rows").alias("rows"))
    often = materialize(texts.where(F.col("texts") >= need).select("template", "n", "texts", "rows"), "often")
    marked = materialize(split_join(lines, often.select("template", "texts", "rows"), ["template"], "inner", "rows", total).drop("rows"), "marked")
    discard(lines)
    sizes = read.groupBy("k_text").agg(F.sum("n").alias("all"))
    seen = witnesses(marked, sizes, copied).groupBy("template").agg(F.count(F.lit(1)).alias("witnesses"))
    dropped = materialize(often.join(seen, "template").where(F.col("witnesses") >= need).select("template", "rows"), "recurring")
    discard(read, often)
    return split_join(marked.select("k_id", "k_text", "pos", "template"), dropped, ["template"], "inner", "rows", total).select("k_id", "k_text", "pos")


def drop_recurring_lines(
    docs: DataFrame, depth: int = 3, min_docs: int = MIN_DOCS, min_tokens: int = 3, similarity: float = 0.7, long: int = LONG, long_docs: int = LONG_DOCS, copied: float = 0.8, n_dropped: str = "n_dropped", n_lines: str = "n_lines"
) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, plus their number and that of all lines.

    Every row stays, with all its columns; a column that has the name of one of the two numbers is replaced. Null texts
    stay null and have no lines; an empty text has one, which is blank; blank lines and those of under ``min_tokens``
    tokens always stay. Very long texts are one row, very long lines one template. Equal rows lose the same lines. An
    empty table gives an empty table.
    """
    if not 0 < similarity <= 1:
        raise ValueError("the similarity is a share of the tokens")
    lines = recurring(docs, depth, min_docs, min_tokens, similarity, long, long_docs, copied)
    per = materialize(lines.groupBy("k_id", "k_text").agg(F.collect_set("pos").alias("gone")), "drops")
    key_id, key_text = row_key(F.col("d.doc_id"), F.col("d.text"))
    # one plan at every size: what is dropped grows with the documents, so it is never broadcast
    both = docs.alias("d").join(per.hint("merge").alias("p"), (key_id == F.col("p.k_id")) & (key_text == F.col("p.k_text")), "left")
    text, gone = F.col("d.text"), F.col("p.gone")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(gone, i)), "\n")
    n = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n")))
    columns = [F.when(gone.isNotNull(), kept).otherwise(text).alias("text") if c == "text" else own(c, "d") for c in docs.columns if c.lower() not in (n_dropped, n_lines)]
    return both.select(*columns, F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_dropped), n.cast("long").alias(n_lines))


def drop_lines_only(docs: DataFrame, n_chars: str = "n_chars", **how) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``; the same columns. ``n_chars``, if there is one, follows the new text."""
    n_dropped, n_lines = fresh(docs.columns, "n_dropped", "n_lines")
    out = drop_recurring_lines(docs, n_dropped=n_dropped, n_lines=n_lines, **how).alias("d")
    length = F.when(F.col(n_dropped) > 0, F.length("text").cast("long")).otherwise(F.col(f"`{n_chars}`")) if n_chars in docs.columns else None
    return out.select(*(length.cast(docs.schema[c].dataType).alias(c) if c == n_chars else own(c, "d") for c in docs.columns))
