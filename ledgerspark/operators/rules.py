"""Audit rules over a ledger: high value, weekend posting, empty description,
and a registry to run one or all of them."""

from __future__ import annotations

from decimal import Decimal
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import HIGH_VALUE_THRESHOLD, RULE_LIMIT
from .ordering import desc_last, top, total_order


def _dec(v) -> Column:
    return F.lit(Decimal(str(v)))


def is_high_value(threshold=HIGH_VALUE_THRESHOLD) -> Column:
    return F.abs("rc_amount") >= _dec(threshold)


def is_weekend() -> Column:
    """Weekday: Monday=0 .. Sunday=6."""
    return F.weekday("posting_date").isin(5, 6)


def is_undescribed() -> Column:
    return F.col("description").isNull() | (F.trim("description") == "")


def high_value(
    df: DataFrame, threshold=HIGH_VALUE_THRESHOLD, limit: int | None = RULE_LIMIT, tiebreak: bool = True
) -> DataFrame:
    """|rc_amount| >= threshold, largest first, then newest."""
    hit = df.filter(is_high_value(threshold))
    order = total_order(hit, [desc_last(F.abs("rc_amount")), desc_last("posting_date")], ["posting_date"], tiebreak)
    return top(hit, order, limit)


def _newest(df: DataFrame, hit: Column, limit: int | None, tiebreak: bool) -> DataFrame:
    found = df.filter(hit)
    lead = ["posting_date", "voucher_id"]
    return top(found, total_order(found, [desc_last(c) for c in lead], lead, tiebreak), limit)


def weekend_entries(df: DataFrame, limit: int | None = RULE_LIMIT, tiebreak: bool = True) -> DataFrame:
    """Posted on a Saturday or Sunday."""
    return _newest(df, is_weekend(), limit, tiebreak)


def empty_description(df: DataFrame, limit: int | None = RULE_LIMIT, tiebreak: bool = True) -> DataFrame:
    """Description NULL or blank after trimming spaces."""
    return _newest(df, is_undescribed(), limit, tiebreak)


RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "high_value": high_value,
    "weekend_entry": weekend_entries,
    "empty_description": empty_description,
}

# Display labels of the three rules.
RULE_LABELS = {"high_value": "大额凭证", "weekend_entry": "周末入账", "empty_description": "摘要为空"}


def list_rules() -> dict[str, str]:
    return dict(RULE_LABELS)


def run_rule(df: DataFrame, name: str, **kw) -> DataFrame:
    key = name
    if key not in RULES:
        by_label = {v: k for k, v in RULE_LABELS.items()}
        if key not in by_label:
            raise KeyError(f"unknown rule: {name}")
        key = by_label[key]
    return RULES[key](df, **kw)


# Condition of a rule, and whether its hits go by amount before they go by date.
_CONDITIONS: dict[str, tuple[Callable[..., Column], bool]] = {
    "high_value": (is_high_value, True),
    "weekend_entry": (is_weekend, False),
    "empty_description": (is_undescribed, False),
}


def run_rules(df: DataFrame, names: list[str] | None = None, params: dict[str, dict] | None = None) -> DataFrame:
    """All (or the named) rules as one DataFrame with a ``rule`` column.

    One scan: a row is tagged with the rules it meets, and the first rows of
    each rule are kept by a window whose limit is applied in every task before
    the shuffle."""
    params = {name: dict((params or {}).get(name, {})) for name in names or list(RULES)}
    limits = {name: p.pop("limit", RULE_LIMIT) for name, p in params.items()}
    met = [F.when(_CONDITIONS[name][0](**p), F.lit(name)) for name, p in params.items()]
    tags = F.filter(F.array(*met), lambda t: t.isNotNull())
    tagged = df.withColumn("rule", F.explode(tags))
    by_amount = F.col("rule").isin([n for n in params if _CONDITIONS[n][1]])
    order = [
        F.when(by_amount, F.abs("rc_amount")).desc_nulls_last(),
        desc_last("posting_date"),
        F.when(~by_amount, F.col("voucher_id")).desc_nulls_last(),
        *[F.col(f"`{c}`").asc_nulls_last() for c in df.columns],
    ]
    place = F.row_number().over(Window.partitionBy("rule").orderBy(*order))
    most = max((v for v in limits.values() if v is not None), default=None)
    if any(v is None for v in limits.values()):
        most = None
    out = tagged.withColumn("_place", place)
    if most is not None:
        out = out.filter(F.col("_place") <= most)
    for name, limit in limits.items():
        if limit is not None and limit != most:
            out = out.filter((F.col("rule") != name) | (F.col("_place") <= limit))
    return out.drop("_place")
