"""Profile-driven cleaning: field mapping, typed casts, prefix rules, signed
amount, lineage constants, reject split, import statistics, error sample and
amount preview. Everything is one projection of the source DataFrame; the
valid and rejected rows are two filters of it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import flag_in, parse_amount, signed_amount
from ..functions.dates import tolerant_date
from ..functions.text import as_text, is_blank, prefixed
from ..functions.text import strip_unicode
from ..schema import (
    AMOUNT_TYPE,
    DEFAULT_REQUIRED_FIELDS,
    ERROR_COLUMNS,
    ERROR_SAMPLE_LIMIT,
    EXTRA_LEDGER_FIELDS,
    LEDGER_COLUMNS,
    MAPPING_TARGETS,
    PREVIEW_ROWS,
    REASON_ACCOUNT,
    REASON_AMOUNT,
    MALFORMED,
    REASON_CAPTION,
    REASON_CELLS,
    REASON_CLIENT,
    REASON_SEPARATOR,
    REASON_VOUCHER,
    REASON_YEAR,
    ROW_ERROR_CODE,
    UNKNOWN_FLAG_TEXT,
    BatchInfo,
    DirectAmount,
    FlaggedAmount,
    Profile,
)

INVALID = "_invalid"
PAYLOAD = "_payload"
SOURCE_ROW = "source_row"


class MappingError(ValueError):
    """A mapped source column is missing."""


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def source_col(name: str) -> Column:
    return F.col(quote(name))


def required_sources(profile: Profile) -> list[str]:
    """Source columns an import needs: the five core targets plus the
    columns of the amount mode."""
    return [profile.source(t) for t in DEFAULT_REQUIRED_FIELDS] + list(profile.amount_columns().values())


def check_source_columns(columns: list[str], profile: Profile) -> None:
    """Every required mapped column must exist; an empty name counts as missing."""
    present = set(columns)
    targets = DEFAULT_REQUIRED_FIELDS
    needed = required_sources(profile)
    missing = []
    for i, name in enumerate(needed):
        if not name:
            missing.append(f"<{targets[i] if i < len(targets) else 'amount'} unmapped>")
        elif name not in present:
            missing.append(name)
    if missing:
        raise MappingError("source is missing mapped columns: " + ", ".join(missing))


def _const(v, dtype: str) -> Column:
    if isinstance(v, Column):
        return v.cast(dtype)
    return F.lit(v).cast(dtype)


def map_ledger(
    df: DataFrame,
    profile: Profile,
    batch: BatchInfo,
    *,
    extra_columns: bool = False,
    keep: list[str] | None = None,
    payload: bool = False,
) -> DataFrame:
    """Source rows -> ledger columns + ``source_row`` (if present) + ``_invalid``.

    ``keep`` names source columns carried along unchanged. ``payload`` adds
    ``_payload``: the source row as JSON, computed for rejected rows only.
    """
    check_source_columns(df.columns, profile)
    clean = profile.clean
    tokens = list(clean.empty_tokens)

    def src(name: str) -> Column:
        c = as_text(source_col(name))
        if tokens:
            c = F.when(F.trim(c).isin(tokens), F.lit(None).cast("string")).otherwise(c)
        return c

    def text(target: str, name: str | None = None) -> Column:
        """The target's source as text with its prefix; NULL if unmapped."""
        name = name or profile.source(target)
        return prefixed(src(name), profile.prefixes.get(target)) if name else F.lit(None).cast("string")

    local = profile.source("lc_amount")
    cols = {t: text(t) for t in LEDGER_COLUMNS if t in MAPPING_TARGETS}
    cols |= {
        "posting_date": tolerant_date(src(profile.source("posting_date")), clean.date_dayfirst),
        "drcr": text("drcr", profile.source("drcr") or profile.amount_columns().get("drcr")),
        "rc_amount": signed_amount(profile, src, clean.amount_remove_commas),
        "lc_amount": parse_amount(src(local), clean.amount_remove_commas) if local else F.lit(None).cast(AMOUNT_TYPE),
        "client_name": _const(batch.client_name, "string"),
        "fiscal_year": _const(batch.fiscal_year, "int"),
        "source_file": _const(batch.source_file, "string"),
        "import_batch_id": _const(batch.import_batch_id, "string"),
        "created_at": F.localtimestamp(),
    }
    exprs = []
    if SOURCE_ROW in df.columns:
        exprs.append(F.col(SOURCE_ROW).cast("long").alias(SOURCE_ROW))
    exprs += [cols[c].alias(c) for c in LEDGER_COLUMNS]
    if extra_columns:
        exprs += [text(c).alias(c) for c in EXTRA_LEDGER_FIELDS]
    for k in keep or []:
        exprs.append(source_col(k).alias(k))
    src_names = [c for c in df.columns if c not in (SOURCE_ROW, MALFORMED)]
    if MALFORMED in df.columns:
        exprs.append(F.col(MALFORMED))
    if payload:
        exprs += [source_col(c).alias(f"_src_{i}") for i, c in enumerate(src_names)]
    mapped = df.select(*exprs)
    mapped = mapped.withColumn(INVALID, invalid_condition(mapped.columns))
    if payload:
        raw = F.to_json(F.struct(*[F.col(f"_src_{i}").alias(c) for i, c in enumerate(src_names)]))
        mapped = mapped.withColumn(PAYLOAD, F.when(F.col(INVALID), raw)).drop(
            *[f"_src_{i}" for i in range(len(src_names))]
        )
    return mapped


def _faults(columns: list[str]) -> list[tuple[Column, str]]:
    """(condition, reason) in the order of the report: blank voucher_id,
    ac_code or ac_caption (after prefixing), no amount; then no fiscal year or
    no client, which a stored row needs, and a record that does not fit its
    header."""
    faults = [
        (is_blank("voucher_id"), REASON_VOUCHER),
        (is_blank("ac_code"), REASON_ACCOUNT),
        (is_blank("ac_caption"), REASON_CAPTION),
        (F.col("rc_amount").isNull(), REASON_AMOUNT),
        (F.col("fiscal_year").isNull(), REASON_YEAR),
        (F.coalesce(strip_unicode("client_name"), F.lit("")) == "", REASON_CLIENT),
    ]
    return faults + [(F.col(MALFORMED).isNotNull(), REASON_CELLS)] * (MALFORMED in columns)


def invalid_condition(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c for c, _ in _faults(columns)])


def error_message(columns: list[str]) -> Column:
    """Reasons in fixed order, joined by '; '."""
    return F.concat_ws(REASON_SEPARATOR, *[F.when(c, F.lit(r)) for c, r in _faults(columns)])


def ledger_rows(flagged: DataFrame, extra: list[str] | None = None) -> DataFrame:
    return flagged.filter(~F.col(INVALID)).select(*LEDGER_COLUMNS, *(extra or []))


def error_rows(flagged: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Rejected rows with reasons; key fields as text."""
    src_row = F.col(SOURCE_ROW) if SOURCE_ROW in flagged.columns else F.lit(None).cast("long")
    return flagged.filter(F.col(INVALID)).select(
        src_row.alias("source_row"),
        F.lit(ROW_ERROR_CODE).alias("error_code"),
        error_message(flagged.columns).alias("error_message"),
        F.col("posting_date").cast("string").alias("posting_date"),
        "voucher_id",
        "ac_code",
        "ac_caption",
        "description",
        F.col("rc_amount").cast("string").alias("rc_amount"),
        *(extra or []),
    )


def split_valid(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return ledger_rows(flagged), error_rows(flagged)


def import_stats(flagged: DataFrame) -> DataFrame:
    """One row: total, accepted, failed, positive / negative / zero amounts
    and the date range of accepted rows, from one aggregation."""
    ok = ~F.col(INVALID)
    amt = F.col("rc_amount")
    return flagged.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(ok).alias("success_rows"),
        F.count_if(F.col(INVALID)).alias("failed_rows"),
        F.count_if(ok & (amt > 0)).alias("positive_rows"),
        F.count_if(ok & (amt < 0)).alias("negative_rows"),
        F.count_if(ok & (amt == 0)).alias("zero_rows"),
        F.min(F.when(ok, F.col("posting_date"))).cast("string").alias("posting_date_min"),
        F.max(F.when(ok, F.col("posting_date"))).cast("string").alias("posting_date_max"),
    )


def ledger_stats(ledger: DataFrame) -> DataFrame:
    """Same statistics over an already accepted ledger."""
    amt = F.col("rc_amount")
    return ledger.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(amt > 0).alias("positive_rows"),
        F.count_if(amt < 0).alias("negative_rows"),
        F.count_if(amt == 0).alias("zero_rows"),
        F.min("posting_date").cast("string").alias("posting_date_min"),
        F.max("posting_date").cast("string").alias("posting_date_max"),
    )


def error_sample(errors: DataFrame, limit: int = ERROR_SAMPLE_LIMIT) -> DataFrame:
    """First ``limit`` rejected rows by source row (top-k, no full sort)."""
    lead = ["source_file"] if "source_file" in errors.columns else []
    rest = [c for c in errors.columns if c not in ("source_row", *lead)]
    order = [F.col(c).asc_nulls_last() for c in ["source_row", *lead, *rest]]
    return errors.orderBy(*order).limit(max(0, int(limit)))


@dataclass(frozen=True)
class _PreviewCols:
    drcr: Column
    amount: Column
    debit: Column
    credit: Column
    rc_amount: Column


def _fmt2(v: Column) -> Column:
    """'%.2f' text of a scale-2 decimal (its plain text form)."""
    return v.cast("string")


def amount_preview(
    df: DataFrame, profile: Profile, n: int = PREVIEW_ROWS, order: list[Column | str] | None = None
) -> DataFrame:
    """Per sample row: flag, amount, debit, credit and converted amount text.

    Commas are removed before parsing; blank -> ''; an unknown flag gives the
    fixed unknown-flag text. Sample = first ``n`` rows of ``order`` (or of the
    source when no order is given).
    """
    rules = profile.amount
    srcs = profile.amount_columns()

    def raw(name: str) -> Column:
        return F.coalesce(as_text(source_col(name)), F.lit("")) if name else F.lit("")

    def num(name: str) -> Column:
        return parse_amount(F.trim(raw(name)), remove_commas=True)

    empty = F.lit("")
    if isinstance(rules, DirectAmount):
        a = num(srcs["amount"])
        cols = _PreviewCols(empty, raw(srcs["amount"]), empty, empty, F.coalesce(_fmt2(a), empty))
    elif isinstance(rules, FlaggedAmount):
        a = num(srcs["amount"])
        flag = raw(srcs["drcr"])
        conv = (
            F.when(a.isNull(), empty)
            .when(flag_in(flag, rules.debit), _fmt2(F.abs(a)))
            .when(flag_in(flag, rules.credit), _fmt2(-F.abs(a)))
            .otherwise(F.lit(UNKNOWN_FLAG_TEXT))
        )
        cols = _PreviewCols(flag, raw(srcs["amount"]), empty, empty, conv)
    else:
        d = F.coalesce(num(srcs["debit"]), F.lit(0))
        c = F.coalesce(num(srcs["credit"]), F.lit(0))
        cols = _PreviewCols(empty, empty, raw(srcs["debit"]), raw(srcs["credit"]), _fmt2(F.abs(d) - F.abs(c)))
    sample = df.orderBy(*order).limit(n) if order else df.limit(n)
    keep = [SOURCE_ROW] if SOURCE_ROW in df.columns else []
    return sample.select(
        *keep,
        cols.drcr.alias("drcr_value"),
        cols.amount.alias("amount_value"),
        cols.debit.alias("debit_value"),
        cols.credit.alias("credit_value"),
        cols.rc_amount.alias("rc_amount"),
    )
