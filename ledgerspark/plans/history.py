"""Append-only query and dataset-open logs with recent-first views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import dataset_overview, latest_per_key
from ..schema import RECENT_DATASETS_KEEP, SQL_HISTORY_KEEP
from .store import LedgerStore, next_seq

QUERY_LOG_SCHEMA = T.StructType(
    [
        T.StructField("executed_at", T.TimestampNTZType()),
        T.StructField("seq", T.LongType()),
        T.StructField("dataset_path", T.StringType()),
        T.StructField("sql_text", T.StringType()),
    ]
)
OPEN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("last_opened_at", T.TimestampNTZType()),
        T.StructField("seq", T.LongType()),
        T.StructField("dataset_name", T.StringType()),
    ]
)


def record_query(store: LedgerStore, sql_text: str, dataset_path: str | None = None) -> bool:
    text = sql_text.strip()
    if not text:
        return False
    now = dt.datetime.now().replace(microsecond=0)
    row = [(now, next_seq(), dataset_path or "", text)]
    store.append("query_log", store.spark.createDataFrame(row, QUERY_LOG_SCHEMA))
    return True


def run_logged(store: LedgerStore, sql_text: str, dataset_path: str | None = None) -> DataFrame:
    """Guarded free SQL; recorded in the history once it has been analysed
    without error (the result itself stays lazy)."""
    from ..operators.views import run_sql

    df = run_sql(store.spark, sql_text)
    record_query(store, sql_text, dataset_path)
    return df


def recent_queries(store: LedgerStore, n: int = SQL_HISTORY_KEEP) -> DataFrame:
    log = store.read("query_log", QUERY_LOG_SCHEMA)
    if log is None:
        return store.spark.createDataFrame([], QUERY_LOG_SCHEMA)
    return latest_per_key(log, ["sql_text", "dataset_path"], "seq", n=max(1, n))


def record_open(store: LedgerStore, dataset_name: str) -> None:
    now = dt.datetime.now().replace(microsecond=0)
    store.append("open_log", store.spark.createDataFrame([(now, next_seq(), dataset_name)], OPEN_LOG_SCHEMA))


def recent_datasets(store: LedgerStore, n: int = RECENT_DATASETS_KEEP) -> DataFrame:
    log = store.read("open_log", OPEN_LOG_SCHEMA)
    if log is None:
        return store.spark.createDataFrame([], OPEN_LOG_SCHEMA)
    return latest_per_key(log, ["dataset_name"], "seq", n=n)


def overview(store: LedgerStore, n: int = RECENT_DATASETS_KEEP) -> DataFrame:
    recent = recent_datasets(store, n)
    datasets = store.read("datasets")
    if datasets is None:
        datasets = store.spark.createDataFrame(
            [], "dataset_name string, client_name string, fiscal_year int, row_count long, posting_date_min string, "
            "posting_date_max string, import_batch_id string"
        )
    return dataset_overview(recent, datasets, store.batch_status()).orderBy(F.col("last_opened_at").desc())
