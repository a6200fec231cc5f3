"""Import quality reports, each one aggregation over the source rows:
amount warnings, amount report, voucher balance, missing / cast-failure
counts per mapped column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import flag_in, parse_amount, signed_amount
from ..functions.dates import tolerant_date
from ..functions.text import as_text, is_blank
from ..schema import IMBALANCE_TOLERANCE, MODE_DEBIT_CREDIT, MODE_FLAG, TOTAL_TYPE, Profile
from .clean import source_col


def _parts(profile: Profile) -> dict[str, Column]:
    commas = profile.clean.amount_remove_commas
    out = {"rc": signed_amount(profile, lambda n: as_text(source_col(n)), commas)}
    for k, name in profile.amount_columns().items():
        raw = as_text(source_col(name))
        out[f"raw_{k}"] = raw
        out[f"num_{k}"] = parse_amount(raw, commas)
    return out


def amount_report(df: DataFrame, profile: Profile) -> DataFrame:
    """One row: rows converted, empty amount, unknown flag, both columns
    filled; debit, credit (as a positive number) and net totals."""
    p = _parts(profile)
    mode = profile.amount.mode
    rc = p["rc"]
    zero = F.lit(0)
    if mode == MODE_DEBIT_CREDIT:
        empty = is_blank(p["raw_debit"]) & is_blank(p["raw_credit"])
        both = ~is_blank(p["raw_debit"]) & ~is_blank(p["raw_credit"])
        unknown = F.lit(False)
    else:
        empty = is_blank(p["raw_amount"])
        both = F.lit(False)
        unknown = F.lit(False)
        if mode == MODE_FLAG:
            r = profile.amount
            unknown = ~is_blank(p["raw_amount"]) & ~flag_in(p["raw_drcr"], r.debit) & ~flag_in(p["raw_drcr"], r.credit)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(rc.isNotNull()).alias("converted_rows"),
        F.count_if(empty).alias("empty_amount_rows"),
        F.count_if(F.coalesce(unknown, F.lit(True))).alias("unknown_flag_rows"),
        F.count_if(both).alias("both_filled_rows"),
        F.coalesce(F.sum(F.when(rc > zero, rc)), zero).cast(TOTAL_TYPE).alias("debit_total"),
        F.coalesce(-F.sum(F.when(rc < zero, rc)), zero).cast(TOTAL_TYPE).alias("credit_total"),
        F.coalesce(F.sum(rc), zero).cast(TOTAL_TYPE).alias("net_total"),
    )


def amount_warnings(df: DataFrame, profile: Profile) -> DataFrame:
    """One row of warning counts: amounts all one sign, both columns filled,
    both blank, a negative value in a debit/credit column, unknown flags."""
    p = _parts(profile)
    mode = profile.amount.mode
    rc = p["rc"]
    zero = F.lit(0)
    if mode == MODE_DEBIT_CREDIT:
        both = ~is_blank(p["raw_debit"]) & ~is_blank(p["raw_credit"])
        neither = is_blank(p["raw_debit"]) & is_blank(p["raw_credit"])
        negative = (F.coalesce(p["num_debit"], zero) < 0) | (F.coalesce(p["num_credit"], zero) < 0)
        unknown = F.lit(False)
    else:
        both = neither = negative = F.lit(False)
        unknown = F.lit(False)
        if mode == MODE_FLAG:
            r = profile.amount
            unknown = ~flag_in(p["raw_drcr"], r.debit) & ~flag_in(p["raw_drcr"], r.credit)
    agg = df.agg(
        F.count_if(rc > zero).alias("positive_rows"),
        F.count_if(rc < zero).alias("negative_rows"),
        F.count_if(both).alias("both_filled_rows"),
        F.count_if(neither).alias("both_blank_rows"),
        F.count_if(negative).alias("negative_source_rows"),
        F.count_if(F.coalesce(unknown, F.lit(True))).alias("unknown_flag_rows"),
    )
    one_sign = ((F.col("positive_rows") == 0) | (F.col("negative_rows") == 0)) & (
        (F.col("positive_rows") + F.col("negative_rows")) > 0
    )
    return agg.withColumn("all_one_sign", one_sign)


def balance_report(ledger: DataFrame, tolerance=IMBALANCE_TOLERANCE) -> DataFrame:
    """One row: vouchers, unbalanced vouchers (|sum| > tolerance), total
    absolute imbalance, and vouchers seen on more than one posting date."""
    from decimal import Decimal

    per = ledger.groupBy("voucher_id").agg(
        F.sum("rc_amount").alias("s"), F.count_distinct("posting_date").alias("dates")
    )
    tol = F.lit(Decimal(str(tolerance)))
    return per.agg(
        F.count(F.lit(1)).alias("vouchers"),
        F.count_if(F.abs("s") > tol).alias("unbalanced_vouchers"),
        F.coalesce(F.sum(F.when(F.abs("s") > tol, F.abs("s"))), F.lit(0)).cast(TOTAL_TYPE).alias("imbalance_total"),
        F.count_if(F.col("dates") > 1).alias("repeated_vouchers"),
    )


def cast_failures(df: DataFrame, profile: Profile) -> DataFrame:
    """Per mapped target: rows with a missing (blank) source value and rows
    whose non-blank value failed its cast. Long format, one row per target."""
    commas = profile.clean.amount_remove_commas
    checks: list[tuple[str, str, Column | None]] = []
    for t, name in profile.mapping.items():
        raw = as_text(source_col(name))
        parsed = None
        if t == "posting_date":
            parsed = tolerant_date(raw, profile.clean.date_dayfirst)
        elif t in ("lc_amount", "rc_amount"):
            parsed = parse_amount(raw, commas)
        checks.append((t, name, parsed))
    for k, name in profile.amount_columns().items():
        if name and k != "drcr":
            checks.append((f"amount:{k}", name, parse_amount(as_text(source_col(name)), commas)))
    aggs = []
    for i, (t, name, parsed) in enumerate(checks):
        raw = as_text(source_col(name))
        aggs.append(F.count_if(is_blank(raw)).alias(f"m{i}"))
        fail = (~is_blank(raw) & parsed.isNull()) if parsed is not None else F.lit(False)
        aggs.append(F.count_if(fail).alias(f"f{i}"))
    row = df.agg(*aggs)
    stack = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(t).alias("target_field"), F.lit(n).alias("source_field"),
                    F.col(f"m{i}").alias("missing_rows"), F.col(f"f{i}").alias("cast_failed_rows"),
                )
                for i, (t, n, _) in enumerate(checks)
            ]
        )
    )
    return row.select(stack)
