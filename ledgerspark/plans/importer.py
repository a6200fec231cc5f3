"""One import job: source DataFrame -> cleaned, checked, published batch.

Flow: map + flag -> with duplicate handling the keys of the valid rows are
written to scratch and looked up in the key index -> one partitioned write of
every row with its status -> summary states of the written rows, from which
statistics, batch keys and checks are read -> key index, error sample, report
and dataset rows -> status ``active`` (``replaced`` for older batches in
new-import mode) by one commit. What fails before it leaves a ``failed`` batch.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import client_key, strip_unicode
from ..operators import clean, duplicates
from ..session import OPEN_FILES, Scratch, short_methods
from ..operators.mapping import mapping_report_rows
from ..schema import (
    AUTO_BATCH_HEX,
    AUTO_BATCH_PREFIX,
    LEDGER_COLUMNS,
    MODE_FLAG,
    REQUIRED_LEDGER_FIELDS,
    ERROR_COLUMNS,
    ROW_ERROR_CODE,
    STATUS_FAILED,
    STATUS_STAGED,
    BatchInfo,
    Profile,
)
from . import filestats
from .keyindex import KeyIndex, import_firsts, import_keys
from .statuslog import KEY_COLUMNS
from .store import (
    ROW_REJECTED,
    ROW_SKIPPED,
    ROW_VALID,
    STORED_ROWS_SCHEMA,
    LedgerStore,
    error_view,
)
from .summary_state import ACCOUNTS, import_stats, read_states, write_states

SOURCE_TYPES = {"excel", "csv", "table"}
IMPORT_MODES = {"new", "append"}
DUPLICATE_MODES = {None, "mark", "skip", "strict"}


class ImportError_(ValueError):
    pass


def auto_batch_id() -> str:
    return AUTO_BATCH_PREFIX + uuid.uuid4().hex[:AUTO_BATCH_HEX]


@dataclass
class ImportResult:
    task_id: str
    client_name: str
    source_type: str
    source_path: str
    source_table: str | None
    target_table: str
    fiscal_year: int | None
    import_batch_id: str
    import_mode: str
    total_rows: int
    success_rows: int
    failed_rows: int
    duplicate_rows: int
    positive_rows: int
    negative_rows: int
    zero_rows: int
    posting_date_min: str | None
    posting_date_max: str | None
    field_mapping_report: list[dict] = field(default_factory=list)
    import_errors: list[dict] = field(default_factory=list)
    dataset_path: str | None = None
    status: str = "success"
    error_code: str | None = None
    error_message: str | None = None
    quality: dict | None = None

    # The keys of the report, in order.
    REPORT_KEYS = [
        "task_id", "client_name", "source_type", "source_path", "source_table", "target_table", "fiscal_year",
        "import_batch_id", "import_mode", "total_rows", "success_rows", "failed_rows", "duplicate_rows",
        "positive_rows", "negative_rows", "zero_rows", "field_mapping_report", "import_errors", "status", "error_code",
        "error_message",
    ]

    def to_json(self) -> str:
        d = asdict(self)
        out = {k: d[k] for k in self.REPORT_KEYS}
        if self.quality is not None:
            out["quality"] = self.quality
        return json.dumps(out, ensure_ascii=False, indent=2, default=str)


REPORT_SCHEMA = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("client_name", T.StringType()),
        T.StructField("fiscal_year", T.IntegerType()),
        T.StructField("import_batch_id", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("import_mode", T.StringType()),
        T.StructField("total_rows", T.LongType()),
        T.StructField("success_rows", T.LongType()),
        T.StructField("failed_rows", T.LongType()),
        T.StructField("duplicate_rows", T.LongType()),
        T.StructField("positive_rows", T.LongType()),
        T.StructField("negative_rows", T.LongType()),
        T.StructField("zero_rows", T.LongType()),
        T.StructField("report_json", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)
DATASET_SCHEMA = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("client_name", T.StringType()),
        T.StructField("fiscal_year", T.IntegerType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("posting_date_min", T.StringType()),
        T.StructField("posting_date_max", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("import_batch_id", T.StringType()),
        T.StructField("profile_name", T.StringType()),
        T.StructField("ledger_path", T.StringType()),
        T.StructField("source_file", T.StringType()),
    ]
)


def _check_request(source_type: str, import_mode: str, duplicate_mode, profile) -> None:
    if source_type not in SOURCE_TYPES:
        raise ImportError_(f"unsupported source type: {source_type}")
    if profile is None:
        raise ImportError_("an import needs a confirmed profile")
    if import_mode not in IMPORT_MODES:
        raise ImportError_("import mode must be 'new' or 'append'")
    if duplicate_mode not in DUPLICATE_MODES:
        raise ImportError_(f"unknown duplicate mode: {duplicate_mode}")


def import_batch(
    source: DataFrame,
    profile: Profile,
    batch: BatchInfo,
    store: LedgerStore,
    *,
    source_type: str = "csv",
    source_path: str = "",
    import_mode: str = "append",
    duplicate_mode: str | None = "mark",
    dataset_name: str | None = None,
    keep_payload: bool = True,
    error_sample_limit: int = 200,
    quality: bool = False,
    allow_many_clients: bool = False,
    cluster_files: int | None = None,
) -> ImportResult:
    """Clean ``source`` (which should carry ``source_row``) with ``profile``
    and publish it as one batch of ``store``.

    One write stores every row with its status (valid / rejected / skipped
    duplicate); statistics, batch keys and the error sample are read back
    from that batch's partitions. Until the status log says ``active`` the
    batch is invisible, so a failure at any point publishes nothing. With
    ``cluster_files`` the rows are written along a space-filling curve, in
    about so many files (more if those got too large), and statistics by file
    are kept (``filestats``).
    """
    _check_request(source_type, import_mode, duplicate_mode, profile)
    batch_id = batch.import_batch_id if isinstance(batch.import_batch_id, str) and batch.import_batch_id else auto_batch_id()
    batch = BatchInfo(batch.client_name, batch.fiscal_year, batch_id, batch.source_file)
    if store.batch_id_used(batch_id):
        # rows of an earlier attempt would share the partition folder
        raise ImportError_(f"batch id {batch_id!r} is already used in this store; import under a new id")

    if not isinstance(batch.client_name, Column) and not (batch.client_name or "").strip():
        raise ImportError_("an import needs a client name")

    flagged = clean.map_ledger(source, profile, batch, payload=keep_payload, extra_columns=True)
    if clean.SOURCE_ROW not in flagged.columns:
        if duplicate_mode is not None:
            raise ImportError_("duplicate handling needs source_row; import with duplicate_mode=None without it")
        flagged = flagged.withColumn(clean.SOURCE_ROW, F.lit(None).cast("long"))
    invalid = F.col(clean.INVALID)
    constant = not isinstance(batch.client_name, Column) and not isinstance(batch.fiscal_year, Column)
    keys = None
    if constant:  # what is about to be written is on record before it is
        keys = store.spark.range(1).select(
            client_key(F.lit(batch.client_name)).alias("client_key"),
            F.lit(batch.client_name).alias("client_name"),
            F.lit(batch.fiscal_year).cast("int").alias("fiscal_year"),
            F.lit(batch_id).alias("import_batch_id"),
        )
        store.set_status(keys, STATUS_STAGED)
    try:
        with Scratch(store.spark) as scratch:
            since = indexed = None
            if duplicate_mode is None:
                found = flagged.withColumn("client_key", client_key("client_name"))
                rows = flagged.withColumn("is_duplicate", F.lit(False))
            else:
                since = store.log.state().version  # what the marks are made from
                with short_methods(store.spark):  # the filter repeats the whole mapping below it
                    found = scratch.write(import_keys(flagged, ~invalid, duplicates.places(flagged)), "import-keys")
                firsts = scratch.write(import_firsts(found), "import-firsts")
                seen = scratch.write(KeyIndex(store).seen(firsts, scratch.write), "import-seen")
                fresh = firsts
                if not seen.isEmpty():
                    fresh = scratch.write(firsts.join(seen, duplicates.HASH, "left_anti"), "import-fresh")
                    scratch.drop(firsts, seen)
                bits = duplicates.place_bits(fresh, scratch.write)
                rows = duplicates.mark(flagged, found, fresh, ~invalid, bits)
                skipped = duplicate_mode == "skip"
                indexed = found.join(fresh, duplicates.HASH, "left_semi") if skipped else found
            by_key, few_keys = not constant and not cluster_files, False
            if by_key:  # a task has a file open for each of them and each status
                status = 3 if duplicate_mode == "skip" else 2
                keys_in = found.select("client_key", "fiscal_year").distinct().limit(OPEN_FILES)
                few_keys = status * keys_in.count() <= OPEN_FILES
            scratch.drop()
            rows = _with_status(rows, duplicate_mode == "skip", keep_payload)
            if cluster_files:
                rows = filestats.clustered(scratch.write(rows, "import-rows"), cluster_files)
            n_written = store.write_rows(rows, batch_id, by_key, few_keys)
            written = store.batch_rows(batch_id)
            if written is None:  # a source without rows
                written = store.spark.createDataFrame([], STORED_ROWS_SCHEMA)
            write_states(store, written, batch_id)
            states = read_states(store, ACCOUNTS, batch_id)
            stats = import_stats(states).first()
            if stats["total_rows"] != n_written:
                raise ImportError_(f"{n_written} rows were written, {stats['total_rows']} found")
            if keys is None:  # columns: the keys that the rows have
                keys = states.select(*KEY_COLUMNS).distinct()
            # rows without a client are rejected and name no second one
            clients = states.filter(strip_unicode("client_name") != "").select("client_name").distinct()
            if not allow_many_clients and clients.limit(2).count() > 1:
                raise ImportError_("one client per batch")
            dup_rows = stats["duplicate_rows"]
            if duplicate_mode == "strict" and dup_rows:
                raise duplicates.DuplicateError(f"{dup_rows} duplicate rows (strict mode)", dup_rows)
            missing = sorted(set(REQUIRED_LEDGER_FIELDS) - set(written.columns))
            if missing:
                raise ImportError_("written rows lack required columns: " + ", ".join(missing))
            if indexed is not None:
                scratch.drop()
                KeyIndex(store).add(indexed)
            if cluster_files:
                filestats.write_stats(store, batch_id)

            rejected = error_view(written.filter(F.col("row_status") == ROW_REJECTED)).select(*ERROR_COLUMNS)
            sample = [r.asDict() for r in clean.error_sample(rejected, error_sample_limit).collect()]
            result = ImportResult(
                task_id=batch_id,
                client_name=batch.client_name if isinstance(batch.client_name, str) else "",
                source_type=source_type,
                source_path=source_path,
                source_table=None,
                target_table="ledger",
                fiscal_year=batch.fiscal_year if isinstance(batch.fiscal_year, int) else None,
                import_batch_id=batch_id,
                import_mode=import_mode,
                total_rows=stats["total_rows"],
                success_rows=stats["success_rows"],
                failed_rows=stats["total_rows"] - stats["success_rows"],
                duplicate_rows=dup_rows,
                positive_rows=stats["positive_rows"],
                negative_rows=stats["negative_rows"],
                zero_rows=stats["zero_rows"],
                posting_date_min=stats["posting_date_min"],
                posting_date_max=stats["posting_date_max"],
                field_mapping_report=mapping_report_rows(store.spark, profile),
                import_errors=sample,
                dataset_path=store.path("rows"),
            )
            if quality:
                ledger = written.filter(F.col("row_status") == ROW_VALID)
                result.quality = import_quality(source, profile, ledger)
            # the report is there before the batch is; store.reports() leaves
            # out those of batches that never became active
            name = _write_report(store, result, profile, dataset_name, batch)
            store.publish(keys, replace=import_mode == "new", since=since)
    except Exception:
        if keys is not None:
            store.set_status(keys, STATUS_FAILED)
        raise
    from .history import record_open

    record_open(store, name)  # a new dataset heads the recent list
    return result


def _with_status(rows: DataFrame, skip: bool, keep_payload: bool) -> DataFrame:
    """Every row's status, and why it was rejected."""
    invalid = F.col(clean.INVALID)
    return rows.select(
        "*",
        F.when(invalid, F.lit(ROW_REJECTED))
        .when(F.col("is_duplicate") & F.lit(skip), F.lit(ROW_SKIPPED))
        .otherwise(F.lit(ROW_VALID))
        .alias("row_status"),
        F.when(invalid, F.lit(ROW_ERROR_CODE)).alias("error_code"),
        F.when(invalid, clean.error_message(rows.columns)).alias("error_message"),
        (F.col(clean.PAYLOAD) if keep_payload else F.lit(None).cast("string")).alias("raw_payload"),
    )


def import_quality(source: DataFrame, profile: Profile, ledger: DataFrame) -> dict:
    """Amount report and warnings, per-column missing / cast failures and
    the voucher balance check, each one aggregation (small results)."""
    from ..operators import quality as Q

    def one(df: DataFrame) -> dict:
        return {k: (str(v) if v is not None and not isinstance(v, (int, bool)) else v) for k, v in df.first().asDict().items()}

    return {
        "amount_mode": profile.amount.mode,
        "debit_values": list(getattr(profile.amount, "debit", ())) if profile.amount.mode == MODE_FLAG else [],
        "credit_values": list(getattr(profile.amount, "credit", ())) if profile.amount.mode == MODE_FLAG else [],
        "amount_report": one(Q.amount_report(source, profile)),
        "amount_warnings": one(Q.amount_warnings(source, profile)),
        "columns": [r.asDict() for r in Q.cast_failures(source, profile).collect()],
        "voucher_balance": one(Q.balance_report(ledger)),
    }


def _write_report(store: LedgerStore, r: ImportResult, profile: Profile, dataset_name, batch: BatchInfo) -> None:
    import datetime as dt

    spark = store.spark
    now = dt.datetime.now().replace(microsecond=0)
    rep = [
        (
            r.task_id, r.client_name, r.fiscal_year, r.import_batch_id, r.source_type, r.source_path, r.import_mode,
            r.total_rows, r.success_rows, r.failed_rows, r.duplicate_rows, r.positive_rows, r.negative_rows,
            r.zero_rows, r.to_json(), now,
        )
    ]
    store.append("import_reports", spark.createDataFrame(rep, REPORT_SCHEMA))
    name = dataset_name or f"{r.client_name}_{r.fiscal_year}_{r.import_batch_id}"
    src_file = batch.source_file if isinstance(batch.source_file, str) else r.source_path
    ds = [
        (
            1, name, r.client_name, r.fiscal_year, r.success_rows, r.posting_date_min, r.posting_date_max, now,
            r.import_batch_id, profile.name, store.path("rows"), src_file,
        )
    ]
    store.append("datasets", spark.createDataFrame(ds, DATASET_SCHEMA))
    return name
