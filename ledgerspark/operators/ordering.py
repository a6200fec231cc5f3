"""Deterministic total orders for top-k results.

A sort on (posting_date, voucher_id) is not unique, so which rows survive a
LIMIT would be arbitrary. Remaining columns are appended as tie-breakers
(ascending, NULLs last) so every engine returns the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_col


def total_order(df: DataFrame, leading: list[Column], used: list[str], tiebreak: bool = True) -> list[Column]:
    if not tiebreak:
        return leading
    rest = [F.col(f"`{c}`").asc_nulls_last() for c in df.columns if c not in set(used)]
    return leading + rest


def desc_last(c: Column | str) -> Column:
    return as_col(c).desc_nulls_last()


def asc_last(c: Column | str) -> Column:
    return as_col(c).asc_nulls_last()


def top(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """The first ``limit`` rows of the order (a top-k); all, sorted, with None."""
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)
