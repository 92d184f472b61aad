"""What the corpus operators share: fixed character classes, split rules and document keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def id_crc(doc_id: Column) -> Column:
    """CRC-32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two columns that equal rows share and different (id, text) pairs do not: ``k_id`` and ``k_text``."""
    return [F.coalesce(doc_id.cast("string"), F.lit("null")).alias("k_id"), F.xxhash64(text).alias("k_text")]


def own(name: str, side: str) -> Column:
    """A column of one side of a join, whatever names the other side has."""
    quoted = name.replace("`", "``")
    return F.col(f"{side}.`{quoted}`").alias(name)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.Array]]]:
    """Runs of rows with equal first ``keys`` columns (integers), with their other columns; runs may span batches."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    whole = lambda: (last, [pa.concat_arrays([h.column(i) for h in held]) for i in range(keys, held[0].num_columns)])
    for b in batches:
        if not b.num_rows:
            continue
        ids = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)], 1)
        cuts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
        for s, e in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
            now = tuple(ids[s].tolist())
            if held and now != last:
                yield whole()
                held = []
            last = now
            held.append(b.slice(int(s), int(e - s)))
    if held:
        yield whole()


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores more as it takes to be no column of a table."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def all_of(columns: list[str], side: str | None = None) -> list[Column]:
    """The columns by their names, whatever signs are in these."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in columns]
    return [F.col(f"{side}.{q}" if side else q) for q in quoted]


#: Keys that count as hot, at most, and rows that a key may have before it can be one.
HOT_KEYS, HOT_ROWS = 10_000, 1000


def split_join(rows: DataFrame, side: DataFrame, keys: list[str], how: str, times: str, total: int) -> DataFrame:
    """``rows`` joined with ``side`` (unique keys) on ``keys``: hot keys by broadcast, the others by shuffle.

    ``times`` is how many of the ``total`` rows a key of ``side`` has at least. Keys with more than the
    ``HOT_KEYS``-th part of all rows are hot, so there are never more than ``HOT_KEYS`` of them to broadcast, and no task of
    the shuffle gets more than that part of the rows for one key.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot, cold = side.where(F.col(times) > least), side.where(F.col(times) <= least)
    here = rows.join(F.broadcast(hot), keys, "inner" if how == "left" else how)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return here.unionByName(rest)
