"""Journal CSV files: header row, every column read as text (no inference
pass; leading zeros kept), many files per read, file-order source row.

One pass over the raw lines tells, for each file, its header and whether a
quoted value holds a line break. Files with the same columns in the same order
are read together, others with their own header and joined by name, so no value
lands under another column's name. Only files with quoted line breaks are read
unsplit. A record with more or fewer values than its header is not cut or
filled up in silence: ``MALFORMED`` holds its text, and cleaning rejects it.
"""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rowindex import with_source_row
from ..schema import MALFORMED

# Read-side marker for a quoted empty field (""), turned back into ''. An
# unquoted empty field stays NULL, as in DuckDB's CSV reader.
_QUOTED_EMPTY = "\ue000"


def text_options(reader, delimiter: str = ",", encoding: str = "UTF-8"):
    """Header, text, doubled quotes, and the text of malformed records."""
    return (
        reader.option("header", True)
        .option("sep", delimiter)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", MALFORMED)
        .option("emptyValue", _QUOTED_EMPTY)
    )


def text_columns(columns: list[str]) -> list[Column]:
    """The columns with quoted empty values as '', and MALFORMED."""
    named = [F.col("`" + c.replace("`", "``") + "`") for c in columns]
    return [
        *[F.when(c == _QUOTED_EMPTY, F.lit("")).otherwise(c).alias(n) for c, n in zip(named, columns)],
        F.col(MALFORMED),
    ]


def unique_names(names: list[str]) -> list[str]:
    """Repeated or empty header names get a number, as in ``a``, ``a_1``."""
    out: list[str] = []
    for i, name in enumerate(names):
        base = name or f"column{i}"
        n, k = base, 0
        while n in out:
            k += 1
            n = f"{base}_{k}"
        out.append(n)
    return out


def file_layouts(
    spark: SparkSession, paths: str | list[str], delimiter: str = ",", encoding: str = "UTF-8"
) -> list[tuple[tuple[str, ...], bool, list[str]]]:
    """(columns, quoted line breaks, files) of the files under ``paths``.

    One aggregation over the raw lines. A row by file reaches the driver,
    which lists the files anyway."""
    paths = [paths] if isinstance(paths, str) else paths
    lines = spark.read.option("encoding", encoding).text(paths)
    lines = lines.select("value", "_metadata.file_path", "_metadata.file_block_start").withColumn(
        "line", F.monotonically_increasing_id()
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    at = F.struct("file_block_start", "line")
    files = (
        lines.groupBy(F.col("file_path").alias("path"))
        .agg(F.min_by("value", at).alias("header"), F.max(quotes % 2 == 1).alias("broken"))
        .orderBy("path")
        .collect()
    )
    layouts: dict[tuple, list[str]] = {}
    for f in files:
        names = next(csv.reader([f["header"].lstrip("\ufeff")], delimiter=delimiter), [])
        layouts.setdefault((tuple(unique_names(names)), f["broken"]), []).append(unquote(f["path"]))  # told as a URL
    return [(names, broken, found) for (names, broken), found in layouts.items()]


def read_journal_csv(
    spark: SparkSession,
    paths: str | list[str],
    *,
    source_row: bool = True,
    encoding: str = "UTF-8",
    delimiter: str = ",",
) -> DataFrame:
    """Rows of one or many CSV files as strings, plus ``source_row`` (1-based
    per file), ``source_file`` (file name) and MALFORMED. A column that a
    file lacks is NULL in its rows."""
    parts = []
    for names, broken, files in file_layouts(spark, paths, delimiter, encoding):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, MALFORMED]])
        reader = text_options(spark.read.schema(schema), delimiter, encoding).option("multiLine", broken)
        part = reader.csv(files).select(*text_columns(list(names)), "_metadata")
        part = part.withColumn("source_file", F.col("_metadata.file_name"))
        if source_row:
            part = with_source_row(part)
        parts.append(part.drop("_metadata"))
    if not parts:
        raise ValueError(f"no CSV file with a header under {paths}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Header of a CSV file (reads the schema only)."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("escape", '"')
    return reader.csv(path).columns
