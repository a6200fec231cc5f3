"""Ledger store on plain Parquet.

Layout under one root (a shared folder):

  rows/            every imported row, partitioned by
                   batch_key / client_key / fiscal_year / row_status
                   (valid, rejected, skipped): the ledger is the ``valid``
                   partitions, the error table the ``rejected`` ones
  batch_status/    versioned log: one row per (batch key, status change)
  import_reports/  one row per import
  datasets/        one row per imported dataset (the manifest)
  query_log/, open_log/   append-only histories

An import is one write of all its rows, so a source is scanned once and
nothing is cached. The current status of a batch key is its latest log row;
readers only see ``active`` keys, so publish, replace and rollback are each one
commit to the log (``statuslog``) and data folders are never rewritten. A failed
or half-written import never becomes active.

No two jobs write into one folder: a batch's rows have a folder of their own, and
so has each append to a table. A batch id is any text: its folder is named by a hash of it, rows carry the id
itself, and every reader compares that.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import time
import uuid
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import client_key, strip_unicode
from ..schema import (
    ERROR_SCHEMA,
    EXTRA_LEDGER_FIELDS,
    LEDGER_COLUMNS,
    LEDGER_SCHEMA,
    STATUS_ACTIVE,
    STATUS_FAILED,
    STATUS_REPLACED,
    STATUS_ROLLED_BACK,
    STATUS_STAGED,
)
from ..session import OPEN_FILE_BYTES, open_files
from .statuslog import KEY_COLUMNS, StatusLog

ROW_VALID = "valid"
ROW_REJECTED = "rejected"
ROW_SKIPPED = "skipped"

PARTITIONS = ["client_key", "fiscal_year", "row_status"]  # within a batch
FILTER_KEYS = 16  # active batch keys that a ledger is filtered by; more are joined
SCOPE_KEYS = 1000  # clients that a commit names; one of more concerns all

STORED_ROWS_SCHEMA = T.StructType(
    [T.StructField("source_row", T.LongType())]
    + [f for f in LEDGER_SCHEMA.fields if f.name != "fiscal_year"]
    + [
        T.StructField("is_duplicate", T.BooleanType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("raw_payload", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in EXTRA_LEDGER_FIELDS],
        T.StructField("client_key", T.StringType()),
        T.StructField("fiscal_year", T.IntegerType()),
        T.StructField("batch_key", T.StringType()),
        T.StructField("row_status", T.StringType()),
    ]
)
STORED_ERROR_SCHEMA = T.StructType(
    list(ERROR_SCHEMA.fields)
    + [T.StructField("raw_payload", T.StringType()), T.StructField("client_name", T.StringType())]
    + [
        T.StructField("client_key", T.StringType()),
        T.StructField("fiscal_year", T.IntegerType()),
        T.StructField("import_batch_id", T.StringType()),
    ]
)
_last_seq = 0


def next_seq() -> int:
    """Strictly increasing sequence for status rows written by this driver."""
    global _last_seq
    _last_seq = max(time.time_ns(), _last_seq + 1)
    return _last_seq


def batch_key(batch_id: Column) -> Column:
    """The folder name of a batch, safe whatever characters its id has."""
    return F.concat(F.lit("b_"), F.substring(F.sha1(F.encode(batch_id, "UTF-8")), 1, 16))


def batch_folder(batch_id: str) -> str:
    return "b_" + hashlib.sha1(batch_id.encode()).hexdigest()[:16]


def same_key(a: DataFrame, b: DataFrame) -> Column:
    """Batch keys are equal; no client or no year is a value like any other.
    ``a`` has the partition folder, which the comparison prunes."""
    return (
        (a["batch_key"] == b["batch_key"])
        & (a["import_batch_id"] == b["import_batch_id"])
        & a["client_key"].eqNullSafe(b["client_key"])
        & a["client_name"].eqNullSafe(b["client_name"])
        & a["fiscal_year"].eqNullSafe(b["fiscal_year"])
    )


def is_client(name: str) -> Column:
    """Rows of a client, by its name without outer white space; the client
    key, which two names may share, only finds the folder."""
    return strip_unicode("client_name") == strip_unicode(F.lit(name))


@dataclass
class RollbackResult:
    import_batch_id: str
    ledger_rows: int
    error_rows: int
    report_rows: int
    batch_rows: int
    status: str = "success"


class LedgerStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.log = StatusLog(spark, self.path("batch_status"))

    # -- paths -------------------------------------------------------------
    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        fs, p = self._fs(table)
        return fs.exists(p)

    def _fs(self, table: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(table))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _rows(self, client_name: str | None = None, fiscal_year: int | None = None, batch: str | None = None):
        """Stored rows; with a client, year or batch only their partition
        folders are listed. None if there is nothing."""
        key = "*"
        if client_name is not None:
            key = self.spark.range(1).select(client_key(F.lit(client_name))).first()[0]
        folder = "*" if batch is None else batch_folder(batch)
        year = "*" if fiscal_year is None else int(fiscal_year)
        glob = f"rows/batch_key={folder}/client_key={key}/fiscal_year={year}"
        if key == year == folder == "*":
            glob = "rows"
        fs, p = self._fs(glob)
        if not fs.globStatus(p):
            return None
        df = self.spark.read.schema(STORED_ROWS_SCHEMA).option("basePath", self.path("rows")).parquet(self.path(glob))
        # keys only name folders: two clients, or two batches, may share one
        if client_name is not None:
            df = df.filter(is_client(client_name))
        return df if batch is None else df.filter(F.col("import_batch_id") == batch)

    def read(self, table: str, schema: T.StructType | None = None) -> DataFrame | None:
        if not self.exists(table):
            return None
        r = self.spark.read.option("recursiveFileLookup", True)
        if schema is not None:
            r = r.schema(schema)
        return r.parquet(self.path(table))

    def read_parts(self, table: str, schema: T.StructType) -> DataFrame:
        """A table whose appends are partitioned in folders of their own."""
        if not self.exists(table):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(table)).select(*schema.names)

    # -- writes ------------------------------------------------------------
    def write_rows(self, rows: DataFrame, batch_id: str, by_key: bool = False, few_keys: bool = False) -> int:
        """Write one import's rows (all statuses); returns how many. Where
        client and year are constants a task writes one file per status; where
        they are columns the rows are dealt out by them first, hot ones over
        several tasks, so files stay few. With ``few_keys`` a task can keep the
        files of all of them open: nothing is shuffled, and row groups are
        small, as each open file holds one in memory."""
        cols = [f.name for f in STORED_ROWS_SCHEMA.fields if f.name != "batch_key"]
        out = rows.withColumn("client_key", client_key("client_name"))
        if by_key and not few_keys:
            out = out.hint("rebalance", "client_key", "fiscal_year")
        seen = Observation()
        out = out.select(*cols).observe(seen, F.count(F.lit(1)).alias("rows"))
        folder = self.path(f"rows/batch_key={batch_folder(batch_id)}")
        writer = out.write.mode("append").partitionBy(*PARTITIONS)
        if by_key and few_keys:
            writer = writer.option("parquet.block.size", OPEN_FILE_BYTES)
        with open_files(self.spark):
            writer.parquet(folder)
        return seen.get["rows"]

    def append(self, table: str, df: DataFrame) -> None:
        """Small logs: one file an append, in a folder of its own."""
        df.coalesce(1).write.parquet(self.path(f"{table}/{uuid.uuid4().hex}"))

    def _changes(self, *changes: tuple[DataFrame, str]) -> DataFrame:
        """(keys, status) pairs as log rows. keys: KEY_COLUMNS."""
        now = F.lit(f"{dt.datetime.now():%Y-%m-%d %H:%M:%S}").cast("timestamp_ntz").alias("changed_at")
        parts = [
            keys.select(*KEY_COLUMNS, F.lit(status).alias("status"), F.lit(None).cast("long").alias("seq"), now)
            for keys, status in changes
        ]
        return reduce(DataFrame.unionByName, parts)

    def scope(self, keys: DataFrame) -> list[str] | None:
        """The client keys of batch keys, None if there are too many to name."""
        found = [r[0] for r in keys.select("client_key").distinct().limit(SCOPE_KEYS + 1).collect()]
        return None if len(found) > SCOPE_KEYS else sorted(x or "" for x in found)

    def set_status(self, keys: DataFrame, status: str) -> None:
        """One commit; staged and failed batches are not part of the ledger."""
        effective = status not in (STATUS_STAGED, STATUS_FAILED)
        scope = self.scope(keys) if effective else None
        self.log.commit(lambda current: self._changes((keys, status)), scope, effective=effective)

    def compact_log(self, older_than: dt.timedelta = dt.timedelta(days=7)) -> None:
        """Adds a snapshot of the log; deletes what no reader of the last days
        can still be reading."""
        self.log.snapshot()
        self.log.vacuum(older_than)

    # -- status ------------------------------------------------------------
    def batch_status(self) -> DataFrame:
        """Current status per batch key."""
        return self.log.current()

    def active_keys(self, client_name: str | None = None, fiscal_year: int | None = None) -> DataFrame:
        s = self.batch_status().filter(F.col("status") == STATUS_ACTIVE)
        if client_name is not None:
            s = s.filter(is_client(client_name))
        if fiscal_year is not None:
            s = s.filter(F.col("fiscal_year") == int(fiscal_year))
        return s.select(*KEY_COLUMNS)

    # -- reads -------------------------------------------------------------
    def batch_rows(self, import_batch_id: str) -> DataFrame | None:
        """All stored rows of one batch, whatever its status."""
        return self._rows(batch=import_batch_id)

    def batch_id_used(self, import_batch_id: str) -> bool:
        """True when the id appears in the status log or has stored rows (a
        failed attempt may have written rows without a status)."""
        if not self.log.rows().filter(F.col("import_batch_id") == import_batch_id).isEmpty():
            return True
        rows = self.batch_rows(import_batch_id)
        return rows is not None and not rows.select("import_batch_id").isEmpty()

    def _visible(self, row_status: str, client_name, fiscal_year) -> DataFrame | None:
        df = self._rows(client_name, fiscal_year)
        if df is None:
            return None
        return self.active_only(df.filter(F.col("row_status") == row_status), client_name, fiscal_year)

    def active_only(self, df: DataFrame, client_name: str | None = None, fiscal_year: int | None = None) -> DataFrame:
        """Rows (with their batch key and folder) of batches that are active in
        the version of the log listed now. A few keys are a filter, which is
        done at the scan; a join of more keys also prunes partitions, but Spark
        moves other semi joins below it, which then carry the key columns."""
        active = self.active_keys(client_name, fiscal_year).withColumn("batch_key", batch_key(F.col("import_batch_id")))
        few = active.limit(FILTER_KEYS + 1).collect()
        if len(few) > FILTER_KEYS:
            return df.join(active, same_key(df, active), "left_semi")
        keys = [reduce(and_, (df[c].eqNullSafe(F.lit(v)) for c, v in k.asDict().items())) for k in few]
        return df.filter(reduce(or_, keys, F.lit(False)))

    def open_ledger(
        self, client_name: str | None = None, fiscal_year: int | None = None, with_duplicate_flag: bool = False
    ) -> DataFrame:
        """Active ledger rows in contract column order (optionally filtered
        to one client / year)."""
        cols = LEDGER_COLUMNS + (["is_duplicate"] if with_duplicate_flag else [])
        df = self._visible(ROW_VALID, client_name, fiscal_year)
        if df is None:
            return self.spark.createDataFrame([], LEDGER_SCHEMA).select(
                *LEDGER_COLUMNS, *([F.lit(False).alias("is_duplicate")] if with_duplicate_flag else [])
            )
        return df.select(*cols)

    def open_errors(self, client_name: str | None = None, fiscal_year: int | None = None) -> DataFrame:
        """Rejected rows of active batches: error columns (key fields as
        text), raw payload and lineage."""
        df = self._visible(ROW_REJECTED, client_name, fiscal_year)
        if df is None:
            return self.spark.createDataFrame([], STORED_ERROR_SCHEMA)
        return error_view(df)

    def open_dataset(self, dataset_name: str) -> DataFrame:
        """Ledger rows of the (active) batches recorded under a dataset name."""
        ds = self.read("datasets")
        if ds is None:
            raise KeyError(f"no dataset {dataset_name!r}")
        batches = ds.filter(F.col("dataset_name") == dataset_name).select("import_batch_id")
        if batches.isEmpty():
            raise KeyError(f"no dataset {dataset_name!r}")
        from .history import record_open

        record_open(self, dataset_name)
        return self.open_ledger().join(batches, "import_batch_id", "left_semi").select(*LEDGER_COLUMNS)

    def reports(self) -> DataFrame | None:
        """The reports of imports that were published; one is written before
        its batch is, so a published batch always has it."""
        reports = self.read("import_reports")
        if reports is None:
            return None
        never = [STATUS_STAGED, STATUS_FAILED]
        published = self.log.rows().filter(~F.col("status").isin(never)).select("import_batch_id").distinct()
        return reports.join(published, "import_batch_id", "left_semi").select(*reports.columns)

    # -- batch lifecycle ---------------------------------------------------
    def publish(self, keys: DataFrame, replace: bool = False, since: int | None = None) -> None:
        """Makes a batch's keys active; with ``replace`` earlier active
        batches of the same client and year become replaced, by the same
        commit, so no reader sees both or neither, and of two such imports at
        the same time the later one replaces the earlier one. ``since``: the
        version of the log that the batch's duplicate marks were made from;
        CommitConflict if the client's active batches changed after it."""

        def build(current: DataFrame) -> DataFrame:
            changes = [(keys, STATUS_ACTIVE)]
            if replace:
                who = strip_unicode("client_name").alias("who")
                new = keys.select(
                    who, F.col("fiscal_year").alias("new_year"), F.col("import_batch_id").alias("new_id")
                )
                old = current.filter(F.col("status") == STATUS_ACTIVE).withColumn("old_who", who)
                same = old["old_who"].eqNullSafe(new["who"]) & old["fiscal_year"].eqNullSafe(new["new_year"])
                old = old.join(new, same).filter("import_batch_id != new_id").select(*KEY_COLUMNS).distinct()
                changes.append((old, STATUS_REPLACED))
            return self._changes(*changes)

        self.log.commit(build, self.scope(keys), since)

    def rollback_batch(self, import_batch_id: str) -> RollbackResult:
        """Mark every key of the batch ``rolled_back``; report what the batch
        holds (partition-pruned counts, one aggregation)."""
        n_keys = 0

        def build(current: DataFrame) -> DataFrame:
            nonlocal n_keys
            here = current.filter(
                (F.col("import_batch_id") == import_batch_id) & (F.col("status") != STATUS_ROLLED_BACK)
            )
            n_keys = here.count()
            if not n_keys:
                raise KeyError(f"no batch {import_batch_id!r} to roll back")
            return self._changes((here, STATUS_ROLLED_BACK))

        keys = self.batch_status().filter(F.col("import_batch_id") == import_batch_id)
        self.log.commit(build, self.scope(keys))
        rows = self.batch_rows(import_batch_id)
        counts = {ROW_VALID: 0, ROW_REJECTED: 0}
        if rows is not None:
            for r in rows.groupBy("row_status").count().collect():
                counts[r["row_status"]] = r["count"]
        reports = self.read("import_reports")
        n_reports = 0 if reports is None else reports.filter(F.col("import_batch_id") == import_batch_id).count()
        return RollbackResult(
            import_batch_id=import_batch_id,
            ledger_rows=counts[ROW_VALID],
            error_rows=counts[ROW_REJECTED],
            report_rows=n_reports,
            batch_rows=n_keys,
        )


def error_view(rows: DataFrame) -> DataFrame:
    """Stored rejected rows -> the error table columns."""
    return rows.select(
        "source_row",
        "error_code",
        "error_message",
        F.col("posting_date").cast("string").alias("posting_date"),
        "voucher_id",
        "ac_code",
        "ac_caption",
        "description",
        F.col("rc_amount").cast("string").alias("rc_amount"),
        "raw_payload",
        "client_name",
        "client_key",
        "fiscal_year",
        "import_batch_id",
    )

