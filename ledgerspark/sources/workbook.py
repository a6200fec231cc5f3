"""Workbook (.xlsx) folders as DataFrames.

A Spark job over many workbooks: ``binaryFile`` lists and loads the files,
``mapInPandas`` parses one workbook per task (an .xlsx is a zip of XML
parts; only the standard library is used) and streams rows out in batches.
Cells are kept as text; cells with a date format as ISO dates. The first row
of a sheet is its header, repeated or empty names numbered; source_row counts
from the header by the sheet's own row numbers. A workbook is read as one
value, so it must stay under 2 GB.

Output of the cell reader is long: (file, sheet, source_row, cells map)
so that workbooks with different headers share one DataFrame;
``workbook_table`` turns it into named text columns for a profile.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from typing import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reach_package
from .csv import unique_names

_NS = {
    "m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "rel": "http://schemas.openxmlformats.org/package/2006/relationships",
}
_M = "{%s}" % _NS["m"]
_R = "{%s}" % _NS["r"]
_CELL_REF = re.compile(r"^([A-Z]+)(\d+)$")
_BATCH = 5000

SHEETS_SCHEMA = "file string, sheet string, sheet_index int"
CELLS_SCHEMA = "file string, sheet string, source_row long, cells map<string,string>"

# Fallback sheet list when a workbook cannot be read.
DEFAULT_SHEETS = ["Sheet1"]


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _sheet_targets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, part path) in workbook order."""
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    by_id = {r.get("Id"): r.get("Target") for r in rels.findall("rel:Relationship", _NS)}
    out = []
    for s in wb.findall("m:sheets/m:sheet", _NS):
        target = by_id.get(s.get(_R + "id"), "")
        path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
        out.append((s.get("name"), path))
    return out


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(_M + "t")) for si in root.findall("m:si", _NS)]


def _number_text(v: str) -> str:
    """Numeric cell text; integral values without a trailing '.0'."""
    if v.endswith(".0") and v[:-2].lstrip("-").isdigit():
        return v[:-2]
    return v


# Number formats that show a date or time: the fixed ids of the file format.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_FORMAT_TEXT = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]|_.')  # literal text, colours, padding


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Indexes of the cell styles whose number format shows a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    dated = set(_DATE_FORMATS)
    for f in root.findall("m:numFmts/m:numFmt", _NS):
        code = _FORMAT_TEXT.sub("", (f.get("formatCode") or "").split(";")[0]).lower()
        own = int(f.get("numFmtId"))
        dated.discard(own)
        if code != "general" and re.search("[ymdhs]", code):
            dated.add(own)
    styles = root.findall("m:cellXfs/m:xf", _NS)
    return {i for i, x in enumerate(styles) if int(x.get("numFmtId") or 0) in dated}


def _epoch(z: zipfile.ZipFile) -> dt.datetime:
    """Day 0 of date serials; some workbooks count from 1904."""
    props = ET.fromstring(z.read("xl/workbook.xml")).find("m:workbookPr", _NS)
    late = props is not None and props.get("date1904") in ("1", "true")
    return dt.datetime(1904, 1, 1) if late else dt.datetime(1899, 12, 30)


def _date_text(serial: str, epoch: dt.datetime) -> str:
    """ISO date of a serial, with the time unless it is midnight; a serial
    that is no date stays as it is."""
    try:
        at = epoch + dt.timedelta(seconds=round(float(serial) * 86400))
    except (ValueError, OverflowError):
        return serial
    return at.strftime("%Y-%m-%d" if at.time() == dt.time() else "%Y-%m-%d %H:%M:%S")


def _cell_value(c: ET.Element, book: "_Book") -> str | None:
    t = c.get("t")
    if t == "inlineStr":
        return "".join(x.text or "" for x in c.iter(_M + "t"))
    v = c.find(_M + "v")
    if v is None or v.text is None:
        return None
    if t == "s":
        i = int(v.text)
        return book.shared[i] if 0 <= i < len(book.shared) else None
    if t == "b":
        return "true" if v.text.strip() == "1" else "false"
    if t in ("str", "e", "d"):
        return v.text
    if int(c.get("s") or 0) in book.dated:
        return _date_text(v.text, book.epoch)
    return _number_text(v.text)


class _Book:
    """What the cells of a workbook refer to."""

    def __init__(self, z: zipfile.ZipFile):
        self.shared, self.dated, self.epoch = _shared_strings(z), _date_styles(z), _epoch(z)


def _rows(z: zipfile.ZipFile, part: str, book: _Book) -> Iterator[tuple[int, list[str | None]]]:
    """(row number in the sheet, cells) of the rows that the sheet lists. A
    row's elements are dropped once read, so a long sheet does not stay in
    memory."""
    holder, number = None, 0
    with z.open(part) as fh:
        for event, el in ET.iterparse(fh, events=("start", "end")):
            if event == "start":
                if el.tag == _M + "sheetData":
                    holder = el
                continue
            if el.tag != _M + "row":
                continue
            number = int(el.get("r") or number + 1)
            values: dict[int, str | None] = {}
            nxt = 0
            for c in el.findall(_M + "c"):
                ref = c.get("r")
                m = _CELL_REF.match(ref) if ref else None
                idx = _col_index(m.group(1)) if m else nxt
                values[idx] = _cell_value(c, book)
                nxt = idx + 1
            if holder is not None:
                holder.clear()
            width = max(values) + 1 if values else 0
            yield number, [values.get(i) for i in range(width)]


def _workbook_sheets(content: bytes) -> list[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return _sheet_targets(z)


def _list_sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                names = [n for n, _ in _workbook_sheets(content)]
            except Exception:  # unreadable workbook: fixed fallback
                names = list(DEFAULT_SHEETS)
            out += [(path, n, i) for i, n in enumerate(names)]
        yield pd.DataFrame(out, columns=["file", "sheet", "sheet_index"])


def _read_cells(sheet: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    book = _Book(z)
                    for name, part in _sheet_targets(z):
                        if sheet is not None and name != sheet:
                            continue
                        header: list[str] | None = None
                        buf: list[tuple] = []
                        for number, values in _rows(z, part, book):
                            if header is None:
                                header, top = unique_names([v or "" for v in values]), number
                                continue
                            cells = {h: (values[i] if i < len(values) else None) for i, h in enumerate(header)}
                            buf.append((path, name, number - top, cells))
                            if len(buf) >= _BATCH:
                                yield pd.DataFrame(buf, columns=["file", "sheet", "source_row", "cells"])
                                buf = []
                        if buf:
                            yield pd.DataFrame(buf, columns=["file", "sheet", "source_row", "cells"])

    return run


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path)


def workbook_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, sheet_index) for every workbook under ``path``."""
    reach_package(spark)
    files = _files(spark, path).select("path", "content")
    return files.mapInPandas(_list_sheets, SHEETS_SCHEMA)


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Long cell rows of every workbook (one sheet by name, or all sheets).

    A workbook is never split, and the file scan packs whole workbooks into
    tasks of at most spark.sql.files.maxPartitionBytes; a task parses its
    workbooks one after another and streams rows out in batches. No shuffle
    of file bytes."""
    reach_package(spark)
    files = _files(spark, path).select("path", "content")
    return files.mapInPandas(_read_cells(sheet), CELLS_SCHEMA)


def workbook_table(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Named text columns from the cell maps (missing header -> NULL),
    with file, sheet and source_row kept for lineage."""
    return cells.select(
        F.col("file").alias("source_file"),
        "sheet",
        "source_row",
        *[F.col("cells")[c].alias(c) for c in columns],
    )


def workbook_headers(cells: DataFrame) -> DataFrame:
    """(file, sheet, columns) from the cell maps, for mapping inference."""
    return cells.groupBy("file", "sheet").agg(F.first(F.map_keys("cells")).alias("columns"))

