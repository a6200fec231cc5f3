"""Distributed 1-based row numbers.

``row_number() OVER ()`` / ``OVER (ORDER BY ..)`` without a partition moves
every row into one task. Here rows stay spread out; only one count per file
(or per file split) is combined. The offset table has a row by file or split;
the join back has no hint, so Spark broadcasts it only under its size bound.

Numbering must not depend on a recomputation giving the same partitions: a
shuffle's output order and a range partitioner's sampled bounds can change
between two runs of the same plan (and after a lost executor). So an ordered
numbering first writes the sorted rows once to the shared checkpoint folder
(which also cuts the lineage) and numbers them by file order on read-back;
a file-order numbering reads a deterministic scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

# Written file names: part-<task index>-<uuid>-c<file index within task>...
_TASK_RE = r"^part-(\d+)-"
_FILE_RE = r"-c(\d+)(?:\.|$)"


def _running_offset(counts: DataFrame, part_cols: list[str], order_cols: list[str]) -> DataFrame:
    w = Window.partitionBy(*part_cols) if part_cols else Window.partitionBy(F.lit(0))
    w = w.orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def number_written(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Number the rows of a Parquet folder written by one ordered write, in
    (task index, file index, row index within file) order."""
    tagged = df.withColumn("_f", F.col("_metadata.file_name")).withColumn("_r", F.col("_metadata.row_index"))
    files = (
        tagged.groupBy("_f")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_t", F.regexp_extract("_f", _TASK_RE, 1).cast("long"))
        .withColumn("_c", F.regexp_extract("_f", _FILE_RE, 1).cast("long"))
    )
    offsets = _running_offset(files, [], ["_t", "_c", "_f"]).select("_f", "_off")
    return (
        tagged.join(offsets, "_f")
        .withColumn(name, F.col("_off") + F.col("_r") + F.lit(1))
        .drop("_f", "_r", "_off")
    )


def written_order(path: str) -> tuple[int, int]:
    """(task, file within the task) of a written file."""
    name = path.rsplit("/", 1)[-1]
    task, file = re.search(_TASK_RE, name), re.search(_FILE_RE, name)
    return (int(task[1]) if task else 0, int(file[1]) if file else 0)


def write_sorted(df: DataFrame, order: list[Column | str], label: str = "sorted") -> str:
    path = scratch_path(df.sparkSession, label)
    df.sort(*order).write.parquet(path)
    return path


def with_row_index(df: DataFrame, order: list[Column | str], name: str = "row_index") -> DataFrame:
    """Add ``name`` = position of the row in the total order ``order``
    (1-based, like ROW_NUMBER() OVER (ORDER BY order)).

    One range-partitioned sort, one write to the shared checkpoint folder;
    the result reads that folder, so it is stable across recomputation.
    """
    path = write_sorted(df, order, "rowindex")
    return number_written(df.sparkSession.read.parquet(path), name)


def first_rows(df: DataFrame, order: list[Column | str], n: int, name: str = "row_index") -> DataFrame:
    """The first ``n`` rows of the order with their positions, by a top-k:
    nothing is sorted or written beyond them."""
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def with_source_row(df: DataFrame, name: str = "source_row") -> DataFrame:
    """1-based row number in file order, per source file, for a file scan
    (CSV/JSON/text read with ``spark.read``), without a shuffle of rows.

    Rows of one split are contiguous in monotonically_increasing_id and
    splits of one file are ordered by block start; the offset table has one
    row per (file, split).
    """
    tagged = (
        df.withColumn("_f", F.col("_metadata.file_path"))
        .withColumn("_b", F.col("_metadata.file_block_start"))
        .withColumn("_rid", F.monotonically_increasing_id())
    )
    splits = tagged.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_rid").alias("_m0"))
    offsets = _running_offset(splits, ["_f"], ["_b"]).select("_f", "_b", "_m0", "_off")
    return (
        tagged.join(offsets, ["_f", "_b"])
        .withColumn(name, F.col("_off") + (F.col("_rid") - F.col("_m0")) + F.lit(1))
        .drop("_f", "_b", "_rid", "_m0", "_off")
    )
