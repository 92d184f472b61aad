"""Column functions: deterministic pair weights, hash order and short number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the largest random weight.
MAX_WEIGHT = 102_400


def hex_number(digest: Column) -> Column:
    """The first eight hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def pair_weight(a: Column, b: Column, most: int = MAX_WEIGHT) -> Column:
    """A weight from 1 to ``most`` that depends on the unordered pair only."""
    return 1 + F.pmod(hex_number(F.md5(F.concat_ws("-", F.least(a, b), F.greatest(a, b)).cast("binary"))), F.lit(most))


def hash_order(seed: str, column: Column) -> Column:
    """A digest whose order is a random permutation for each seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")).cast("binary"))


def format_si(n: Column) -> Column:
    """One decimal and a suffix above a thousand, a million, ...; plain digits up to a thousand."""
    steps = [("Z", 1e21), ("E", 1e18), ("P", 1e15), ("T", 1e12), ("G", 1e9), ("M", 1e6), ("k", 1e3)]
    shown = [F.when(n.cast("double") > size, F.format_string(f"%.1f{suffix}", n / size)) for suffix, size in steps]
    return F.coalesce(*shown, n.cast("string"))
