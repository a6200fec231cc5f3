"""Mergeable summary states, one set by batch, written when it is imported.

  summary_accounts/   by account, caption and month: entries, total, signs, dates
  summary_vouchers/   by voucher: entries, total, first and last date

Both are partitioned as the rows are (batch_key / client_key / fiscal_year).  A
summary of the ledger adds up the states of the batches that are active: it
reads no row, follows a replace or rollback at once, and a new batch only adds
its own states.  Counts, sums, minima and maxima merge exactly; a voucher has
several dates if its first and last one differ, so no date is counted.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import asc_last, desc_last, top
from ..schema import ACCOUNT_SUMMARY_LIMIT, IMBALANCE_LIMIT, IMBALANCE_TOLERANCE, TOTAL_TYPE
from ..session import open_files
from .statuslog import KEY_COLUMNS
from .store import ROW_VALID, LedgerStore, batch_folder

ACCOUNTS, VOUCHERS = "summary_accounts", "summary_vouchers"
PARTITIONS = ["client_key", "fiscal_year"]  # within a batch

_TOTAL = T.DecimalType(38, 2)
_KEY = [
    T.StructField("client_name", T.StringType()),
    T.StructField("import_batch_id", T.StringType()),
    T.StructField("client_key", T.StringType()),
    T.StructField("fiscal_year", T.IntegerType()),
    T.StructField("batch_key", T.StringType()),
]
_LONGS = ["entry_count", "positive_rows", "negative_rows", "zero_rows", "duplicate_rows"]
_DATES = [T.StructField("date_min", T.DateType()), T.StructField("date_max", T.DateType())]
ACCOUNT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("row_status", "ac_code", "ac_caption", "posting_month")]
    + [T.StructField(c, T.LongType()) for c in _LONGS]
    + [T.StructField("total", _TOTAL), *_DATES, *_KEY]
)
VOUCHER_SCHEMA = T.StructType(
    [T.StructField("voucher_id", T.StringType()), T.StructField("entry_count", T.LongType())]
    + [T.StructField("total", _TOTAL), *_DATES, *_KEY]
)


def _dates():
    return F.min("posting_date").alias("date_min"), F.max("posting_date").alias("date_max")


def account_states(rows: DataFrame) -> DataFrame:
    """Stored rows of any status; only valid ones are split by account."""
    ok = F.col("row_status") == ROW_VALID
    only = lambda c: F.when(ok, c)
    amount = only(F.col("rc_amount"))
    rows = rows.withColumn("posting_date", only(F.col("posting_date")))
    return rows.groupBy(
        *KEY_COLUMNS, "batch_key", "row_status",
        only(F.col("ac_code")).alias("ac_code"),
        only(F.col("ac_caption")).alias("ac_caption"),
        F.date_format("posting_date", "yyyy-MM").alias("posting_month"),
    ).agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.count_if(amount > 0).alias("positive_rows"),
        F.count_if(amount < 0).alias("negative_rows"),
        F.count_if(amount == 0).alias("zero_rows"),
        F.count_if(F.coalesce("is_duplicate", F.lit(False))).alias("duplicate_rows"),
        F.sum(amount).cast(_TOTAL).alias("total"),
        *_dates(),
    )


def voucher_states(rows: DataFrame) -> DataFrame:
    return (
        rows.filter(F.col("row_status") == ROW_VALID)
        .groupBy(*KEY_COLUMNS, "batch_key", "voucher_id")
        .agg(F.count(F.lit(1)).alias("entry_count"), F.sum("rc_amount").cast(_TOTAL).alias("total"), *_dates())
    )


def write_states(store: LedgerStore, rows: DataFrame, batch_id: str) -> None:
    """States of one written batch; two aggregations over its rows."""
    for table, states in ((ACCOUNTS, account_states(rows)), (VOUCHERS, voucher_states(rows))):
        folder = store.path(f"{table}/batch_key={batch_folder(batch_id)}")
        with open_files(store.spark):
            states.drop("batch_key").write.mode("append").partitionBy(*PARTITIONS).parquet(folder)


def read_states(store: LedgerStore, table: str, batch_id: str | None = None) -> DataFrame:
    """States of every batch, or of one."""
    states = store.read_parts(table, ACCOUNT_SCHEMA if table == ACCOUNTS else VOUCHER_SCHEMA)
    if batch_id is None:
        return states
    return states.filter((F.col("batch_key") == batch_folder(batch_id)) & (F.col("import_batch_id") == batch_id))


class LedgerSummaries:
    """The canned summaries and checks of the active ledger, from states."""

    def __init__(self, store: LedgerStore, client_name: str | None = None, fiscal_year: int | None = None):
        live = lambda t: store.active_only(read_states(store, t), client_name, fiscal_year)
        self.accounts = live(ACCOUNTS).filter(F.col("row_status") == ROW_VALID)
        self.vouchers = live(VOUCHERS)

    def account_summary(self, limit: int | None = ACCOUNT_SUMMARY_LIMIT) -> DataFrame:
        g = self.accounts.groupBy("ac_code", "ac_caption").agg(
            F.sum("entry_count").alias("entry_count"), F.sum("total").cast(TOTAL_TYPE).alias("total_amount")
        )
        return top(g, [desc_last(F.abs("total_amount")), asc_last("ac_code"), asc_last("ac_caption")], limit)

    def monthly_summary(self) -> DataFrame:
        g = self.accounts.groupBy("posting_month").agg(
            F.sum("entry_count").alias("entry_count"), F.sum("total").cast(TOTAL_TYPE).alias("total_amount")
        )
        return g.orderBy(asc_last("posting_month"))

    def dataset_summary(self) -> DataFrame:
        row = self.accounts.agg(
            F.coalesce(F.sum("entry_count"), F.lit(0)).alias("row_count"),
            F.min("date_min").alias("posting_date_min"),
            F.max("date_max").alias("posting_date_max"),
            F.any_value("client_name", True).alias("client_name"),
            F.any_value("fiscal_year", True).alias("fiscal_year"),
        )
        return row.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in row.columns])

    def _by_voucher(self) -> DataFrame:
        return self.vouchers.groupBy("voucher_id").agg(
            F.sum("entry_count").alias("entry_count"),
            F.sum("total").cast(TOTAL_TYPE).alias("voucher_amount"),
            F.min("date_min").alias("first"),
            F.max("date_max").alias("last"),
        )

    def voucher_imbalance(self, tolerance=IMBALANCE_TOLERANCE, limit: int | None = IMBALANCE_LIMIT) -> DataFrame:
        g = self._by_voucher().select("voucher_id", "entry_count", "voucher_amount")
        g = g.filter(F.abs("voucher_amount") > F.lit(Decimal(str(tolerance))))
        return top(g, [desc_last(F.abs("voucher_amount")), asc_last("voucher_id")], limit)

    def balance_report(self, tolerance=IMBALANCE_TOLERANCE) -> DataFrame:
        off = F.abs("voucher_amount") > F.lit(Decimal(str(tolerance)))
        total = F.sum(F.when(off, F.abs("voucher_amount")))
        return self._by_voucher().agg(
            F.count(F.lit(1)).alias("vouchers"),
            F.count_if(off).alias("unbalanced_vouchers"),
            F.coalesce(total, F.lit(0)).cast(TOTAL_TYPE).alias("imbalance_total"),
            F.count_if(F.col("first") < F.col("last")).alias("repeated_vouchers"),
        )


def import_stats(states: DataFrame) -> DataFrame:
    """One row of an import's statistics, from its account states."""
    of = lambda status, c: F.coalesce(F.sum(F.when(status, F.col(c))), F.lit(0)).alias
    every, ok = F.lit(True), F.col("row_status") == ROW_VALID
    return states.agg(
        of(every, "entry_count")("total_rows"),
        of(ok, "entry_count")("success_rows"),
        of(every, "duplicate_rows")("duplicate_rows"),
        of(ok, "positive_rows")("positive_rows"),
        of(ok, "negative_rows")("negative_rows"),
        of(ok, "zero_rows")("zero_rows"),
        F.min("date_min").cast("string").alias("posting_date_min"),
        F.max("date_max").cast("string").alias("posting_date_max"),
    )
