"""Grid sort, paging, page counts, and sheet-split export.

A shallow page is a top-k (``TakeOrderedAndProject``: each task keeps only
offset+size rows). A single deep page is found by counting (``selection``) and
nothing is written; for many pages of one frame a copy is sorted once
(``Pages``) and each page reads the files that hold it. An export numbers the
rows of such a copy. Nothing the size of the result goes through one task or
the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ROWS_PER_SHEET
from ..session import delete_path
from .filters import folded, search_condition
from .ordering import total_order
from .rowindex import number_written, write_sorted, written_order
from .selection import SortKey, page_by_rank

# A top-k sends up to offset + size rows of each input partition to one task;
# a page is cut that way only while all of them stay under this. Later pages
# come from a sorted copy (``Pages``). Both need, and get, a total order.
TOPK_MERGE_ROWS = 100_000


def use_topk(df: DataFrame, end: int) -> bool:
    return end * max(1, df.rdd.getNumPartitions()) <= TOPK_MERGE_ROWS


def grid_key(df: DataFrame, column: str) -> Column:
    """Sort key of one grid column: text case-folded, everything else as is."""
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, T.StringType):
        return folded(c)
    return c


def grid_order(df: DataFrame, column: str, descending: bool = False, tiebreak: bool = True) -> list[Column]:
    """NULLs last when ascending, first when descending."""
    k = grid_key(df, column)
    lead = k.desc_nulls_first() if descending else k.asc_nulls_last()
    return total_order(df, [lead], [column], tiebreak)


def grid_page(df: DataFrame, column: str, descending: bool, size: int, index: int) -> DataFrame:
    """Page ``index`` (0-based; past the end: the last page) of the grid
    sorted by a column, at any depth, without a sorted copy."""
    keys = [SortKey(grid_key(df, column), descending, nulls_first=descending)]
    keys += [SortKey(F.col(f"`{c}`")) for c in df.columns if c != column]
    if isinstance(df.schema[column].dataType, T.StringType):
        keys.append(SortKey(F.col(f"`{column}`")))  # values that differ in case only
    size, total = max(1, int(size)), df.count()
    return page_by_rank(df, keys, size, clamp_page(int(index), math.ceil(total / size)) * size, total)


def sort_grid(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    return df.orderBy(*grid_order(df, column, descending))


class Pages:
    """All pages of a frame in one order, sorted and written once.

    The rows are range-partitioned and sorted into files of the shared scratch
    folder; a page reads only the files that hold its rows, found by their row
    counts. Callers keep the object for all pages and call ``drop`` when done
    (or use it in a ``with`` block), which deletes the copy."""

    def __init__(self, df: DataFrame, order: list[Column]):
        self.spark = df.sparkSession
        self.path = write_sorted(df, order, "pages")
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)
        counted = self.rows.groupBy(F.col("_metadata.file_path").alias("f")).count().collect()  # a row by file
        files = sorted((written_order(r["f"]), r["f"], r["count"]) for r in counted)
        self.files, self.total = [], 0
        for _, name, n in files:
            self.files.append((self.total, n, name))
            self.total += n

    def page(self, size: int | None, index: int) -> DataFrame:
        """Page ``index`` (0-based, brought into range) of ``size`` rows."""
        size = max(1, self.total) if size is None else max(1, int(size))
        start = clamp_page(int(index), math.ceil(self.total / size)) * size
        held = [(a, name) for a, n, name in self.files if a < start + size and a + n > start]
        if not held:
            return self.rows.limit(0)
        offset = F.create_map(*[F.lit(x) for a, name in held for x in (name, a)])
        rows = self.spark.read.schema(self.rows.schema).parquet(*[name for _, name in held])
        at = F.element_at(offset, F.col("_metadata.file_path")) + F.col("_metadata.row_index")
        rows = rows.withColumn("_row", at).filter((F.col("_row") >= start) & (F.col("_row") < start + size))
        return rows.orderBy("_row").drop("_row")

    def drop(self) -> None:
        delete_path(self.spark, self.path)

    def __enter__(self) -> "Pages":
        return self

    def __exit__(self, *exc) -> None:
        self.drop()


def page(df: DataFrame, order: list[Column], size: int | None, index: int) -> DataFrame:
    """Rows of page ``index`` (0-based; past the end: the last page) of
    ``size`` rows in ``order``, which must be total; ``size=None`` is one page
    with every row. For many pages of one frame use ``Pages``."""
    if size is None:
        return df.orderBy(*order)
    size = max(1, int(size))
    start = clamp_page(int(index), math.ceil(df.count() / size)) * size
    if use_topk(df, start + size):
        return df.orderBy(*order).offset(start).limit(size) if start else df.orderBy(*order).limit(size)
    return Pages(df, order).page(size, start // size)


def page_info(df: DataFrame, needle: str = "", size: int | None = 50) -> DataFrame:
    """One row: total rows, rows matching the search, page count and the
    'filtered / total' label, from a single aggregation."""
    match = search_condition(df, needle)
    row = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(match).alias("filtered_rows"))
    filtered = F.col("filtered_rows")
    if size is None:
        pages = F.when(filtered > 0, F.lit(1)).otherwise(F.lit(0))
    else:
        pages = F.ceil(filtered / F.lit(max(1, int(size))))
    label = F.when(filtered == F.col("total_rows"), filtered.cast("string")).otherwise(
        F.concat_ws(" / ", filtered.cast("string"), F.col("total_rows").cast("string"))
    )
    return row.select("total_rows", "filtered_rows", pages.cast("long").alias("page_count"), label.alias("row_label"))


def clamp_page(index: int, page_count: int) -> int:
    return 0 if page_count == 0 else min(max(0, index), page_count - 1)


def split_sheets(df: DataFrame, order: list[Column], rows_per_sheet: int = ROWS_PER_SHEET, tiebreak: bool = True) -> DataFrame:
    """Rows with ``row_index`` (1-based, in order) and ``sheet_no``."""
    n = max(1, int(rows_per_sheet))
    full = total_order(df, list(order), [], tiebreak)
    numbered = number_written(df.sparkSession.read.parquet(write_sorted(df, full, "sheets")), "row_index")
    return numbered.withColumn("sheet_no", (F.floor((F.col("row_index") - 1) / n) + 1).cast("long"))


def sheet_summary(numbered: DataFrame, rows_per_sheet: int = ROWS_PER_SHEET) -> DataFrame:
    """Sheet count (at least one), total rows and whether a split happened."""
    n = max(1, int(rows_per_sheet))
    total = F.count(F.lit(1))
    sheets = F.greatest(F.lit(1).cast("long"), F.ceil(total / F.lit(n)).cast("long"))
    return numbered.agg(sheets.alias("sheet_count"), total.alias("total_rows")).withColumn(
        "split_applied", F.col("sheet_count") > 1
    )


def sheet_rows(numbered: DataFrame) -> DataFrame:
    """Rows per sheet."""
    return numbered.groupBy("sheet_no").agg(F.count(F.lit(1)).alias("rows"))


def export_sheets(numbered: DataFrame, path: str) -> None:
    """One CSV file per sheet (folder ``sheet_no=k``), header in each, NULL as
    '', rows in order. Sheets are dealt out by range into as many tasks as the
    session's shuffle partitions, each writing its sheets one after the other."""
    cols = [F.col("`" + c.replace("`", "``") + "`") for c in numbered.columns if c not in ("row_index", "sheet_no")]
    if numbered.isEmpty():  # still one sheet, header only
        numbered.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(
            f"{path.rstrip('/')}/sheet_no=1"
        )
        return
    (
        numbered.repartitionByRange("sheet_no")
        .sortWithinPartitions("sheet_no", "row_index")
        .select(*cols, "sheet_no")
        .write.mode("overwrite")
        .partitionBy("sheet_no")
        .option("header", True)
        .csv(path)
    )
