"""Language identification by words first, character n-grams second.

A known word adds its log frequency in each language. An unseen word backs off: its longest known character
n-grams (of the word between boundary marks) speak for it, from ``LONGEST`` characters down to one. The language
with the highest sum wins; the score is its share after the mean evidence is scaled to at most ``EVIDENCE``
words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import id_crc
from graphloom.runtime import materialize

#: Bounds of the labelled sample and of the model, for each language: documents, words, n-grams of each order; words of all languages.
TRAIN_ROWS, WORDS, GRAMS, ALL_WORDS = 3000, 30_000, 30_000, 3_000_000
LONGEST, EVIDENCE, SMOOTH, CACHE, LONG = 5, 10, 0.5, 200_000, 2_000_000
#: Languages up to which their sample sizes are broadcast; beyond, they are joined by a shuffle.
FEW = 10_000
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def word_counts(text: str | None) -> Counter:
    """How often each lower-cased word stands in the text; of a very long one, only different words are held."""
    text = (text or "").lower()
    counts = Counter(LETTERS.findall(text) if len(text) < LONG else (m.group() for m in LETTERS.finditer(text)))
    for word in [w for w in counts if not w.isalpha()] if not "".join(counts).isalpha() else ():  # superscripts, fractions and the like are no letters
        n = counts.pop(word)
        for part in "".join(c if c.isalpha() else " " for c in word).split():
            counts[part] += n
    return counts


def grams_of(word: str, n: int) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


@dataclass
class Model:
    """Log frequencies: a row of ``table`` for each known word and n-gram, a column for each language."""

    langs: list[str]
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))

    def add(self, known: dict[str, int], counts: dict[str, Counter]) -> None:
        """Take the shares in ``counts`` into the table and the keys' rows into ``known``."""
        keys = sorted(set().union(*counts.values()))
        n = np.array([[counts[lang].get(k, 0) for lang in self.langs] for k in keys], float).reshape(-1, len(self.langs)) + SMOOTH
        known.update(zip(keys, range(len(self.table), len(self.table) + len(keys)), strict=True))
        self.table = np.concatenate([self.table.reshape(-1, len(self.langs)), np.log(n / n.sum(axis=0))])


def fit(counts: dict[str, Counter]) -> Model:
    """From word counts by language; the n-grams are counted over these words, each order for itself."""
    langs = sorted(counts)
    model = Model(langs)
    if not langs:
        return model
    model.add(model.words, {lang: Counter(dict(counts[lang].most_common(WORDS))) for lang in langs})
    for n in range(1, LONGEST + 1):
        by = {lang: Counter() for lang in langs}
        for lang in langs:
            for word, k in counts[lang].items():
                for g in grams_of(word, n):
                    by[lang][g] += k
        model.add(model.grams, {lang: Counter(dict(by[lang].most_common(GRAMS))) for lang in langs})
    return model


class Predictor:
    """Rows of one matrix: those of the known words, then the evidence of up to ``CACHE`` unseen words that texts held."""

    def __init__(self, model: Model) -> None:
        self.model, self.base = model, len(model.table)
        self.matrix = np.concatenate([model.table.reshape(self.base, len(model.langs)), np.empty((CACHE, len(model.langs)))])
        self.forget()

    def forget(self) -> None:
        self.seen, self.next = dict(self.model.words), self.base
        self.matrix = self.matrix[: self.base + CACHE]

    def evidence(self, word: str) -> np.ndarray:
        """The mean of the longest known n-grams of an unseen word."""
        get, w, most = self.model.grams.get, f"<{word}>", len(word) + 2
        for n in range(min(LONGEST, most), 0, -1):
            if rows := [r for i in range(most - n + 1) if (r := get(w[i : i + n])) is not None]:
                return np.add.reduce(self.model.table[rows]) / len(rows)
        return np.zeros(len(self.model.langs))

    def place(self, word: str) -> int:
        at = self.seen[word] = self.next
        if at == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.empty((CACHE, len(self.model.langs)))])
        self.matrix[at] = self.evidence(word)
        self.next += 1
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = word_counts(text)
        if not counts or not self.model.langs:
            return UNKNOWN, 0.0
        if self.next > self.base + CACHE:
            self.forget()
        get, place = self.seen.get, self.place
        rows = [place(w) if (at := get(w)) is None else at for w in counts]
        n = sum(counts.values())
        mean = np.fromiter(counts.values(), float, len(counts)) @ self.matrix[rows] / n
        share = np.exp((mean - mean.max()) * min(n, EVIDENCE))
        best = int(share.argmax())
        return self.model.langs[best], float(share[best] / share.sum())


def train(docs: DataFrame, may=None, rows: int = TRAIN_ROWS) -> Model:
    """Fit on a bounded sample: of each language about ``rows`` documents, those with the smallest hashes of their id.

    Rows with a null language, id or text teach nothing. The driver gets the ``WORDS`` most frequent words of each
    language and never more than ``ALL_WORDS``, however many languages there are.
    """
    own = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if may is not None:
        own = own.where(may)
    span = 1 << 20
    sizes = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.col("lang").alias("loom_lang"), F.ceil(F.lit(span) * F.least(F.lit(1.0), F.lit(float(rows)) / F.col("n"))).alias("cut"))
    sizes = materialize(sizes, "languages")
    langs = sizes.count()
    most = max(1, min(WORDS, ALL_WORDS // max(langs, 1)))
    if langs <= FEW:
        sizes = F.broadcast(sizes)
    picked = own.join(sizes, F.col("lang") == F.col("loom_lang")).where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < F.col("cut")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, Counter()).update(word_counts(text))
            rows = [(lang, w, k) for lang, c in by.items() for w, k in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

    sums = picked.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = sums.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("place") <= most)
    counts: dict[str, Counter] = {}
    for r in top.select("lang", "word", "n").toLocalIterator():
        counts.setdefault(r[0], Counter())[r[1]] = r[2]
    return fit(counts)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``loom_pred`` (lang, score). A null text or one without letters is ``und``, score 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = Predictor(sent.value)
        for texts in parts:
            yield pd.DataFrame([p.predict(t) for t in texts], columns=["lang", "score"])

    return docs.withColumn("loom_pred", predict("text"))


def identify(docs: DataFrame, folds: int = 4, held: int = 2, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; the held-out fold teaches nothing.

    Only the text is an input of a prediction, so equal texts get equal answers. A text that is null, empty or
    without a letter is ``und``, score 0. Texts of any length are read whole; of very long ones only different words
    are held. Without any labelled row every answer is ``und``; an empty table gives no rows. Columns besides
    ``doc_id``, ``text`` and ``lang`` are not read, so they may have any name.
    """
    fold = F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) == held
    out = predicted(docs.select("doc_id", "text"), train(docs, ~fold, rows)).select("doc_id", "loom_pred")
    return out.select("doc_id", fold.alias("held_out"), F.col("loom_pred.lang").alias("lang_pred"), F.col("loom_pred.score").alias("score"))
