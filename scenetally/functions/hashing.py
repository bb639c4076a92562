"""Seeded choices that do not depend on partitioning and can be repeated in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 13  # 52 bits, exact in a double


def hash_number(seed: int | str, *columns: Column | str) -> Column:
    """Number in [0, 2^52) fixed by the seed and the column values."""
    parts = [F.lit(str(seed))] + [F.coalesce(_text(c), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, _DIGITS), 16, 10).cast("long")


def hash_unit(seed: int | str, *columns: Column | str) -> Column:
    """Fraction in [0, 1)."""
    return hash_number(seed, *columns) / F.lit(float(2**52))


def hash_pick(n: Column, seed: int | str, *columns: Column | str) -> Column:
    """Index in [0, n)."""
    return F.pmod(hash_number(seed, *columns), n)


def _text(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")
