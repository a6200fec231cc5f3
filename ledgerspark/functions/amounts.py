"""Amount parsing and the three amount conventions -> one signed amount."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import AMOUNT_TYPE, DirectAmount, FlaggedAmount, Profile
from .text import as_text


def parse_amount(c: Column | str, remove_commas: bool = False) -> Column:
    """Tolerant DECIMAL(18,2): unparseable or overflowing text -> NULL."""
    v = as_text(c)
    if remove_commas:
        v = F.regexp_replace(v, ",", "")
    return v.try_cast(AMOUNT_TYPE)


def flag_in(flag: Column, values) -> Column:
    """Exact, case-sensitive membership; an empty set matches nothing."""
    values = list(values)
    if not values:
        return F.lit(False)
    return flag.isin(values)


def signed_amount(profile: Profile, src: Callable[[str], Column], remove_commas: bool = False) -> Column:
    """Debit positive, credit negative, as DECIMAL(18,2).

    direct: the parsed value. flag: +abs / -abs by flag set, NULL for an
    unknown flag. two columns: coalesce(abs(debit),0) - coalesce(abs(credit),0),
    never NULL.
    """
    rules, s = profile.amount, profile.amount_columns()
    if isinstance(rules, DirectAmount):
        return parse_amount(src(s["amount"]), remove_commas)
    if isinstance(rules, FlaggedAmount):
        amount = F.abs(parse_amount(src(s["amount"]), remove_commas))
        flag = as_text(src(s["drcr"]))
        return (
            F.when(flag_in(flag, rules.debit), amount)
            .when(flag_in(flag, rules.credit), -amount)
            .otherwise(F.lit(None).cast(AMOUNT_TYPE))
        )
    debit = F.coalesce(F.abs(parse_amount(src(s["debit"]), remove_commas)), F.lit(0).cast(AMOUNT_TYPE))
    credit = F.coalesce(F.abs(parse_amount(src(s["credit"]), remove_commas)), F.lit(0).cast(AMOUNT_TYPE))
    return (debit - credit).try_cast(AMOUNT_TYPE)
