"""Joins that no key of many rows can slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

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
