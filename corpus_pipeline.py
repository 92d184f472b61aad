"""A corpus pipeline of five stages, each one of the operators in ``graphloom.llm``.

Each stage takes ``(spark, docs, sf_dir)``, works on all documents that its predecessor kept and returns a
DataFrame. All but the last return the columns of ``documents``; the last returns the mix: these columns and
``copy``, a row for each time a document is taken. ``run`` hands over between stages by Parquet.

In every stage null ids, texts, languages and sources, empty and very long texts, equal rows, empty tables and further
columns of any name have the results that the stage's operator states; no stage but the last adds a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, line_dedup, mixing, quality, simhash
from graphloom.runtime import discard, materialize, spread, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from the texts; every row stays and ``n_chars`` follows."""
    return line_dedup.drop_lines_only(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL can express neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents``. A stage's table goes once the next one is written."""
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        done = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
