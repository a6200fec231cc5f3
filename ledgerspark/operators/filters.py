"""Form filters over a ledger and free-text search over any result."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_like, row_text
from ..schema import FORM_LIMIT
from .ordering import desc_last, top, total_order


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class LedgerFilter:
    """Blank fields are ignored; all given fields are ANDed."""

    ac_name: str = ""
    voucher_no: str = ""
    summary: str = ""
    min_amount: str = ""
    date_from: str = ""
    date_to: str = ""


def _date(text: str) -> dt.date:
    try:
        return dt.date.fromisoformat(text)
    except ValueError as exc:
        raise FilterError(f"not a date: {text!r}") from exc


def filter_condition(f: LedgerFilter) -> F.Column:
    cond = F.lit(True)
    if f.ac_name.strip():
        cond = cond & contains_like("ac_caption", f.ac_name.strip())
    if f.voucher_no.strip():
        cond = cond & (F.col("voucher_id") == F.lit(f.voucher_no.strip()))
    if f.summary.strip():
        cond = cond & contains_like("description", f.summary.strip())
    if f.min_amount.strip():
        try:
            v = Decimal(f.min_amount.strip())
        except InvalidOperation as exc:
            raise FilterError("minimum amount must be a number") from exc
        if not v.is_finite():
            raise FilterError("minimum amount must be a number")
        cond = cond & (F.abs("rc_amount") >= F.lit(v))
    if f.date_from.strip():
        cond = cond & (F.col("posting_date") >= F.lit(_date(f.date_from.strip())))
    if f.date_to.strip():
        cond = cond & (F.col("posting_date") <= F.lit(_date(f.date_to.strip())))
    return cond


def filter_ledger(df: DataFrame, f: LedgerFilter, limit: int | None = FORM_LIMIT, tiebreak: bool = True) -> DataFrame:
    """Filtered rows, newest first, at most ``limit`` (None: all)."""
    hit = df.filter(filter_condition(f))
    order = total_order(hit, [desc_last("posting_date"), desc_last("voucher_id")], ["posting_date", "voucher_id"], tiebreak)
    return top(hit, order, limit)


build_journal_query = filter_ledger


def search_condition(df: DataFrame, needle: str) -> F.Column:
    n = needle.strip()
    if not n:
        return F.lit(True)
    return folded(row_text([F.col(f"`{c}`") for c in df.columns])).contains(folded(F.lit(n)))


def folded(c: Column) -> Column:
    """Text without regard to case: upper and then lower case, so that letters
    with a longer capital form (as ss for the sharp s) meet it too."""
    return F.lower(F.upper(c))


def search_rows(df: DataFrame, needle: str) -> DataFrame:
    """Rows whose values, joined by a space (NULL as ''), contain the
    case-folded needle."""
    n = needle.strip()
    return df.filter(search_condition(df, n)) if n else df
