"""A page at any depth by order statistics: no sort, no copy.

The row at a rank is found by rounds of counting.  A round draws a bounded
sample of one sort column's values in the current range, cuts the range at
them, and counts the rows between and at the cuts in one aggregation; the rank
falls into one part, which is the next round's range.  If it falls onto a cut's
value, the next sort column is cut among the rows that have it.  Once a part
holds few rows, the page is those rows and the ones up to the page's last row:
one filter and a small top-k.

Each round reads the frame with the sort columns cut so far; about one round
takes a range to a fiftieth.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 256  # values drawn by a round
CUTS = 48  # of them that a round cuts at
PART_ROWS = 20_000  # a part of so many rows needs no further round


@dataclass(frozen=True)
class SortKey:
    expr: Column
    descending: bool = False
    nulls_first: bool = False

    def order(self) -> Column:
        if self.descending:
            return self.expr.desc_nulls_first() if self.nulls_first else self.expr.desc_nulls_last()
        return self.expr.asc_nulls_first() if self.nulls_first else self.expr.asc_nulls_last()

    def against(self, value) -> tuple[Column, Column]:
        """(rows before the value, rows that have it)."""
        if value is None:
            return (F.lit(False) if self.nulls_first else self.expr.isNotNull()), self.expr.isNull()
        v = F.lit(value)
        earlier = self.expr > v if self.descending else self.expr < v
        return F.coalesce(earlier, F.lit(self.nulls_first)), self.expr.eqNullSafe(v)


def _before(keys: list[SortKey], values: list) -> tuple[Column, Column]:
    """(rows before, rows with) the values of the first sort columns."""
    before, same = F.lit(False), F.lit(True)
    for key, value in zip(keys, values):
        b, s = key.against(value)
        before, same = before | (same & b), same & s
    return before, same


@dataclass
class Part:
    """A run of rows in the order, with the rank of its first row."""

    first: int
    rows: int
    not_before: Column  # rows of the part and behind it
    not_behind: Column  # rows of the part and before it
    equal: bool  # all its rows have the same values


def locate(df: DataFrame, keys: list[SortKey], rank: int, total: int) -> Part:
    """The part that holds the row at ``rank`` (from 0) of ``total``."""
    first, rows, values = 0, total, []
    low = high = None  # (value,) of the cuts around the range of the column
    while rows > PART_ROWS and len(values) < len(keys):
        key = keys[len(values)]
        inside = _before(keys, values)[1]
        for bound, behind in ((low, True), (high, False)):
            if bound is not None:
                b, s = key.against(bound[0])
                inside = inside & (~(b | s) if behind else b)
        here = df.filter(inside)
        drawn = here.select(key.expr.alias("v")).orderBy(F.rand(7)).limit(SAMPLE).distinct()
        top = SortKey(F.col("v"), key.descending, key.nulls_first).order()
        drawn = [r["v"] for r in drawn.orderBy(top).collect()]
        step = max(1, len(drawn) // CUTS)
        cuts = drawn[step // 2 :: step]
        at = reduce(lambda x, y: x + y, [F.when(b, 0).when(s, 1).otherwise(2) for b, s in map(key.against, cuts)])
        counted = {r["at"]: r["count"] for r in here.groupBy(at.alias("at")).count().collect()}
        place = first
        for part in sorted(counted):
            if rank < place + counted[part]:
                break
            place += counted[part]
        first, rows = place, counted[part]
        if part % 2:  # onto a cut's value
            values.append(cuts[part // 2])
            low = high = None
        else:
            low = (cuts[part // 2 - 1],) if part else low
            high = (cuts[part // 2],) if part // 2 < len(cuts) else high
    before, same = _before(keys, values)
    not_before, not_behind = ~before, before | same
    if low is not None:
        b, s = _before(keys, [*values, low[0]])
        not_before = ~(b | s)
    if high is not None:
        not_behind = _before(keys, [*values, high[0]])[0]
    return Part(first, rows, not_before, not_behind, len(values) == len(keys))


def page_by_rank(df: DataFrame, keys: list[SortKey], size: int, start: int, total: int | None = None) -> DataFrame:
    """``size`` rows from rank ``start`` in the order of ``keys``, which must
    be total but for equal rows; nothing is written."""
    order = [k.order() for k in keys]
    total = df.count() if total is None else total
    size = min(size, total - start)
    if size <= 0:
        return df.limit(0)
    a = locate(df, keys, start, total)
    b = a if start + size <= a.first + a.rows else locate(df, keys, start + size - 1, total)
    if not a.equal:
        near = df.filter(a.not_before & b.not_behind)
        return near.orderBy(*order).offset(start - a.first).limit(size)
    # rows that are all equal: any of them
    some = min(size, a.first + a.rows - start)
    out = df.filter(a.not_before & a.not_behind).limit(some)
    if some < size:
        rest = df.filter(~a.not_behind & b.not_behind)
        out = out.unionByName(rest.orderBy(*order).limit(size - some)).orderBy(*order)
    return out
