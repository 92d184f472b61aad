"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained, one on texts labelled good, one on texts labelled bad. A text is compressed
with each; the difference of the two sizes over the size without a dictionary says which kind it
resembles. A logistic curve, fitted on labelled texts that no dictionary has seen, turns the normalised
difference (and the plain compression ratio, which exposes repetition) into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import all_of, fresh, id_crc

#: Bounds of the labelled sample: rows of each class, and bytes of each class's texts.
TRAIN_ROWS, TRAIN_BYTES = 2000, 12_000_000
DICT_BYTES, LEVEL, SAMPLE = 65_536, 3, 4096


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


class Sizer:
    """Compressed sizes of texts under a model's dictionaries."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL) -> None:
        self.by = [zstandard.ZstdCompressor(level=level, **self.dictionary(d, level)) for d in (b"", good, bad)]

    @staticmethod
    def dictionary(d: bytes, level: int) -> dict:
        if not d:
            return {}
        made = zstandard.ZstdCompressionDict(d)
        made.precompute_compress(level=level)
        return {"dict_data": made}

    def features(self, text: str | None) -> tuple[float, ...]:
        b = (text or "").encode("utf-8", "surrogatepass")
        plain, good, bad = (len(c.compress(b)) for c in self.by)
        return (1.0, (bad - good) / plain, np.log((len(b) + 20) / plain), np.log1p(len(b)) / 10)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(good: list[str], bad: list[str]) -> Model:
    """Even texts of each class make its dictionary, odd ones the calibration; without both classes the score is flat."""
    if not good or not bad:
        share = min(max(len(good), 0.5) / max(len(good) + len(bad), 1), 0.999)
        return Model(b"", b"", (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))

    def dictionary(texts: list[str]) -> bytes:
        parts = [b[i : i + SAMPLE] for b in (t.encode("utf-8", "surrogatepass") for t in texts) for i in range(0, len(b), SAMPLE)]
        try:
            return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
        except zstandard.ZstdError:  # too little text for its trainer: the text itself is a raw dictionary
            return b"\n".join(parts)[-DICT_BYTES:]

    dicts = dictionary(good[::2]), dictionary(bad[::2])
    sizer = Sizer(*dicts)
    held = [(t, 1.0) for t in good[1::2] or good] + [(t, 0.0) for t in bad[1::2] or bad]
    x = np.array([sizer.features(t) for t, _ in held])
    return Model(*dicts, tuple(logistic(x, np.array([y for _, y in held])).tolist()))


def train(docs: DataFrame, labels: DataFrame, may: Column | None = None, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> Model:
    """Fit on a bounded sample of the labelled rows that ``may`` (a condition on ``doc_id``) lets through.

    Of each class the ``rows`` labels with the smallest hash of their id are taken and their texts read in that
    order up to ``most`` bytes. Ids with contradicting labels and null labels, ids or texts teach nothing.
    """
    agreed = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2").select("doc_id", "q")
    if may is not None:
        agreed = agreed.where(may)
    texts: dict[int, list[str]] = {}
    for q in (1, 0):
        ids = agreed.where(F.col("q") == q).select("doc_id", F.xxhash64("doc_id").alias("loom_h")).orderBy("loom_h", "doc_id").limit(rows)
        found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "loom_h").agg(F.min("text").alias("text")).orderBy("loom_h", "doc_id")
        texts[q], size = [], 0
        for r in found.select("text").toLocalIterator():
            texts[q].append(r[0])
            if (size := size + len(r[0])) > most:
                break
    return fit(texts[1], texts[0])


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: 0 to 1, higher for texts like the good ones. Null and empty texts are scored as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizer, w = Sizer(sent.value.good, sent.value.bad), np.array(sent.value.weights)
        for texts in parts:
            x = np.array([sizer.features(t) for t in texts]).reshape(-1, len(w))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    return docs.withColumn(name, score("text"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; labels of the held-out fold teach nothing.

    Null and empty texts are scored as empty ones, very long texts as a whole; equal texts have equal scores. Without
    labels of both classes every score is the same. An empty table gives no rows. Columns besides ``doc_id`` and ``text``
    are not read, so they may have any name.
    """
    fold = F.pmod(id_crc(F.col("doc_id")), F.lit(folds)) == held
    out = scored(docs.select("doc_id", "text"), train(docs, labels, ~fold)).select("doc_id", "score")
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; columns stay, whatever their names."""
    (name,) = fresh(docs.columns, "loom_score")
    return scored(docs, train(docs, labels), name).where(F.col(name) >= threshold).select(*all_of(docs.columns))
