"""Canned summaries: by account, by month, voucher imbalance, dataset
summary, browse. Aggregations use partial (map-side) aggregation, so a hot
account or voucher only moves one partial row per task."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ACCOUNT_SUMMARY_LIMIT, BROWSE_LIMIT, IMBALANCE_LIMIT, IMBALANCE_TOLERANCE, TOTAL_TYPE
from .ordering import asc_last, desc_last, top, total_order


def _total(c: str = "rc_amount") -> F.Column:
    return F.sum(c).cast(TOTAL_TYPE)


def account_summary(df: DataFrame, limit: int | None = ACCOUNT_SUMMARY_LIMIT) -> DataFrame:
    g = df.groupBy("ac_code", "ac_caption").agg(
        F.count(F.lit(1)).alias("entry_count"), _total().alias("total_amount")
    )
    return top(g, [desc_last(F.abs("total_amount")), asc_last("ac_code"), asc_last("ac_caption")], limit)


def monthly_summary(df: DataFrame) -> DataFrame:
    g = df.groupBy(F.date_format("posting_date", "yyyy-MM").alias("posting_month")).agg(
        F.count(F.lit(1)).alias("entry_count"), _total().alias("total_amount")
    )
    return g.orderBy(asc_last("posting_month"))


def voucher_imbalance(df: DataFrame, tolerance=IMBALANCE_TOLERANCE, limit: int | None = IMBALANCE_LIMIT) -> DataFrame:
    g = df.groupBy("voucher_id").agg(F.count(F.lit(1)).alias("entry_count"), _total().alias("voucher_amount"))
    g = g.filter(F.abs("voucher_amount") > F.lit(Decimal(str(tolerance))))
    return top(g, [desc_last(F.abs("voucher_amount")), asc_last("voucher_id")], limit)


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row of text: row count, date range, a client name and fiscal year
    ('' when absent or NULL)."""

    def opt(name: str, dtype: str) -> F.Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(dtype)

    row = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("posting_date").alias("posting_date_min"),
        F.max("posting_date").alias("posting_date_max"),
        F.any_value(opt("client_name", "string"), True).alias("client_name"),
        F.any_value(opt("fiscal_year", "int"), True).alias("fiscal_year"),
    )
    return row.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in row.columns])


def browse(df: DataFrame, limit: int = BROWSE_LIMIT, order: list | None = None) -> DataFrame:
    """First ``limit`` rows; with ``order`` a deterministic top-k."""
    if order:
        return df.orderBy(*total_order(df, list(order), [], True)).limit(limit)
    return df.limit(limit)


def legacy_browse(journal: DataFrame, limit: int = BROWSE_LIMIT) -> DataFrame:
    return journal.select("voucher_no", "ac_name", "summary", "rc_amount").limit(limit)
