"""Source preview: the first rows as text (NULL -> ''), or the columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PREVIEW_ROWS


def preview(df: DataFrame, n: int = PREVIEW_ROWS, order: list[Column | str] | None = None) -> DataFrame:
    """First ``n`` rows (by ``order``, or by ``source_row`` when present).
    ``n <= 0`` gives no rows but keeps the columns."""
    n = max(0, int(n))
    if order is None and "source_row" in df.columns:
        order = ["source_row"]
    out = df.orderBy(*order).limit(n) if order else df.limit(n)
    return out.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def preview_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("source_row", "source_file")]
