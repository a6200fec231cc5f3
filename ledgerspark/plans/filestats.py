"""Clustered ledger files and statistics that prune them before listing.

``clustered`` orders a batch's rows along a space-filling curve of posting
date, account and amount before they are written, so a file holds a box of the
three and not a slice of one.  ``write_stats`` then keeps one row by file: the
ranges of the three, and for caption and description a bitmap of the trigrams
that occur.  A form filter reads the statistics first: files whose ranges miss
it, or that lack a trigram of the text searched, are never opened.  The filter
itself stays the exact test, so a file kept in vain costs time only.

A searched text is a LIKE pattern: its literal runs of three characters and
more must occur.  Wildcards, and texts shorter than that, keep every file.
Batches without statistics are read whole.
"""

from __future__ import annotations

import re
from decimal import Decimal
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import LedgerFilter, _date
from ..schema import LEDGER_COLUMNS, LEDGER_SCHEMA
from .store import ROW_VALID, STORED_ROWS_SCHEMA, LedgerStore, batch_folder

STATS = "file_stats"
RANK_BITS = 6  # a coordinate of the curve is one of 64 ranks
FILE_ROWS = 1 << 19  # most rows of a clustered file, about: a task sorts one
GRAM = 3
GRAM_BITS = 32_768  # of Spark's bitmap functions
TEXTS = ["ac_caption", "description"]
AMOUNT = T.DecimalType(18, 2)
STATS_SCHEMA = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("date_min", T.DateType()),
        T.StructField("date_max", T.DateType()),
        T.StructField("account_min", T.StringType()),
        T.StructField("account_max", T.StringType()),
        T.StructField("amount_max", AMOUNT),
        *[T.StructField(f"grams_{c}", T.BinaryType()) for c in TEXTS],
        T.StructField("batch_key", T.StringType()),
    ]
)


def _coordinates() -> list[Column]:
    """Numbers in the order of date, account (its first six bytes) and amount."""
    first = F.rpad(F.hex(F.substring(F.encode("ac_code", "UTF-8"), 1, 6)), 12, "0")
    return [
        F.unix_date("posting_date").cast("long"),
        F.conv(first, 16, 10).cast("long"),
        F.abs("rc_amount").cast("double"),
    ]


def _below(cuts: list, column: str) -> Column:
    """How many of the cuts a value lies behind."""
    return F.size(F.filter(F.array(*[F.lit(v) for v in cuts]), lambda v: v < F.col(column)))


def clustered(rows: DataFrame, files: int) -> DataFrame:
    """Rows dealt out to about ``files`` tasks along the curve, or to more so
    that none sorts more than FILE_ROWS. rows: written already, they are read
    twice. Ranks come from approximate quantiles."""
    at = {f"_x{i}": c for i, c in enumerate(_coordinates())}
    placed = rows.withColumns(at)
    steps = [k / (1 << RANK_BITS) for k in range(1, 1 << RANK_BITS)]
    bounds = placed.agg(*[F.percentile_approx(x, steps, 1000).alias(x) for x in at], F.count(F.lit(1)).alias("n")).first()
    files = max(files, -(-bounds["n"] // FILE_ROWS))
    z = F.lit(0)
    for i, x in enumerate(at):
        cuts = sorted(set(bounds[x] or []))
        if not cuts:
            continue
        rank = F.when(F.col(x).isNull(), 0).otherwise(_below(cuts, x))
        for bit in range(RANK_BITS):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)), 3 * bit + 2 - i))
    placed = placed.withColumn("_z", z)
    # ties of the curve are cut by date, so a common box fills several files
    return placed.repartitionByRange(files, "_z", "_x0", "source_row").sortWithinPartitions("_z", "_x0").drop("_z", *at)


def _grams(text: Column) -> Column:
    """The bits of a text's trigrams."""
    last = F.length(text) - GRAM + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: _bit(F.substring(text, i, F.lit(GRAM))))


def _bit(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_BITS)).cast("long")


def write_stats(store: LedgerStore, batch_id: str) -> None:
    """Statistics of a batch's ledger files; the trigrams of a file are made
    distinct where it is read, so a task holds GRAM_BITS of them a file."""
    rows = store.batch_rows(batch_id)
    if rows is None:
        return
    rows = rows.filter(F.col("row_status") == ROW_VALID)
    rows = rows.select("posting_date", "ac_code", "rc_amount", *TEXTS, F.col("_metadata.file_path").alias("file"))
    ranges = rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("posting_date").alias("date_min"), F.max("posting_date").alias("date_max"),
        F.min("ac_code").alias("account_min"), F.max("ac_code").alias("account_max"),
        F.max(F.abs("rc_amount")).cast(AMOUNT).alias("amount_max"),
    )
    for c in TEXTS:
        bits = rows.select("file", F.explode(_grams(F.col(c))).alias("bit")).distinct()
        grams = bits.groupBy("file").agg(F.bitmap_construct_agg("bit").alias(f"grams_{c}"))
        ranges = ranges.join(grams, "file", "left")
    names = [f.name for f in STATS_SCHEMA.fields if f.name != "batch_key"]
    ranges.select(*names).write.mode("append").parquet(store.path(f"{STATS}/batch_key={batch_folder(batch_id)}"))


def literal_runs(pattern: str) -> list[str]:
    """Runs of a LIKE needle that must occur as they stand; what a wildcard
    touches is left out."""
    return [run for run in re.split(r"[%_]", pattern) if len(run) >= GRAM]


def _has_bit(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0


def may_match(f: LedgerFilter, account: str = "") -> Column:
    """Condition on a file's statistics: it may hold a row of the filter (and
    of the account). A missing bound or bitmap means no such value at all."""
    keep = F.lit(True)
    if account:
        keep = keep & F.coalesce((F.col("account_min") <= account) & (F.col("account_max") >= account), F.lit(False))
    if f.date_from.strip():
        keep = keep & F.coalesce(F.col("date_max") >= F.lit(_date(f.date_from.strip())), F.lit(False))
    if f.date_to.strip():
        keep = keep & F.coalesce(F.col("date_min") <= F.lit(_date(f.date_to.strip())), F.lit(False))
    if f.min_amount.strip():
        keep = keep & F.coalesce(F.col("amount_max") >= F.lit(Decimal(f.min_amount.strip())), F.lit(False))
    for column, text in (("ac_caption", f.ac_name), ("description", f.summary)):
        for run in literal_runs(text.strip()):
            for i in range(len(run) - GRAM + 1):
                has = _has_bit(F.col(f"grams_{column}"), _bit(F.lit(run[i : i + GRAM])))
                keep = keep & F.coalesce(has, F.lit(False))
    return keep


class PrunedLedger:
    """The active ledger, cut to the files that may match a filter; ``files``
    of ``all_files`` remain."""

    def __init__(self, store: LedgerStore, f: LedgerFilter, account: str = ""):
        active = store.active_keys().select("import_batch_id").distinct().collect()  # a row by batch, as the listing has
        folders = [batch_folder(r[0]) for r in active]
        stats = store.read_parts(STATS, STATS_SCHEMA).filter(F.col("batch_key").isin(folders))
        told = stats.select("file", "batch_key", may_match(f, account).alias("keep")).collect()  # a row by file
        self.all_files = len(told)
        paths = [unquote(r["file"]) for r in told if r["keep"]]  # told as URLs
        self.files = len(paths)
        whole = set(folders) - {r["batch_key"] for r in told}
        paths += [p for b in sorted(whole) if store.exists(p := f"rows/batch_key={b}")]
        paths = [p if "://" in p or p.startswith(("/", "file:")) else store.path(p) for p in paths]
        spark = store.spark
        if not paths:
            self.rows = spark.createDataFrame([], LEDGER_SCHEMA)
            return
        rows = spark.read.schema(STORED_ROWS_SCHEMA).option("basePath", store.path("rows")).parquet(*paths)
        rows = store.active_only(rows.filter(F.col("row_status") == ROW_VALID))
        if account:
            rows = rows.filter(F.col("ac_code") == account)
        self.rows = rows.select(*LEDGER_COLUMNS)
