"""Tolerant text -> DATE parsing.

Spark's own string-to-date cast accepts a bare year ('2024' -> 2024-01-01),
a year-month, five-digit years and trailing garbage after a space, and it
rejects '/' separators. The accepted shapes are therefore matched explicitly
and rebuilt as 'yyyy-m-d' before a try_cast, so anything else becomes NULL
(the row is kept).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_text

# year sep month sep day, the same separator twice, optional time part.
YMD_PATTERN = r"^\s*(\d{1,4})([-/ \\])(\d{1,2})\2(\d{1,2})(?:[ T]\d{1,2}:\d{2}.*)?\s*$"
# day sep month sep four-digit year, for day-first sources.
DMY_PATTERN = r"^\s*(\d{1,2})([-/. ])(\d{1,2})\2(\d{4})(?:[ T]\d{1,2}:\d{2}.*)?\s*$"


# Marks a matched value; the groups are rebuilt with a separator that cannot
# occur in a matched value. One regex pass per pattern, then a split.
_MARK = "\u0001"
_SEP = "\u0002"


def _parse(v: Column, pattern: str, order: tuple[int, int, int]) -> tuple[Column, Column]:
    """(matched?, date) for ``pattern`` with year/month/day group numbers."""
    y, m, d = order
    r = F.regexp_replace(v, pattern, f"{_MARK}${y}{_SEP}${m}{_SEP}${d}")
    matched = F.startswith(r, F.lit(_MARK))
    parts = F.split(F.substring(r, 2, 64), _SEP)
    date = F.concat_ws("-", F.lpad(F.get(parts, F.lit(0)), 4, "0"), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))).try_cast("date")
    return matched, date


def _plain_iso(v: Column) -> Column:
    """Exactly 'dddd-dd-dd' (the common case): no regex needed."""
    return (F.length(v) == 10) & (F.translate(v, "0123456789", "") == "--") & (F.substring(v, 5, 1) == "-") & (
        F.substring(v, 8, 1) == "-"
    )


def tolerant_date(c: Column | str, dayfirst: bool = False) -> Column:
    v = as_text(c)
    ok, ymd = _parse(v, YMD_PATTERN, (1, 3, 4))
    out = F.when(_plain_iso(v), v.try_cast("date")).when(ok, ymd)
    if dayfirst:
        ok2, dmy = _parse(v, DMY_PATTERN, (4, 3, 1))
        out = F.when(ok2, dmy).otherwise(out)
    return out
