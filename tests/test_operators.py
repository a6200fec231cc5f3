"""Operator-level checks: source column check, request checks, extra
columns, legacy migration, SQL guard, paging and sheet export, rules."""

import glob
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import clean, paging, rules, views
from ledgerspark.operators.filters import FilterError, LedgerFilter, filter_condition
from ledgerspark.plans.importer import ImportError_, _check_request
from ledgerspark.schema import (
    MODE_DEBIT_CREDIT,
    MODE_DIRECT,
    DirectAmount,
    FlaggedAmount,
    BatchInfo,
    Profile,
    TwoColumnAmount,
    ProfileError,
)

BASE = dict(posting_date="d", voucher_id="v", ac_code="c", ac_caption="n", description="s")


def src(spark):
    return spark.createDataFrame(
        [(1, "2024-01-06", "V1", "1001", "Cash", "x", "10", "Alice", "CNY"),
         (2, "2024-01-07", "V2", "1002", "Bank", "", "-3", None, "USD")],
        "source_row int, d string, v string, c string, n string, s string, a string, emp string, cur string",
    )


def test_source_column_check(spark):
    prof = Profile("p", {**BASE}, TwoColumnAmount("dr", "a"))
    with pytest.raises(clean.MappingError, match="dr"):
        clean.map_ledger(src(spark), prof, BatchInfo("c", 2024, "b"))
    empty = Profile("p", {**{**BASE, "description": ""}}, DirectAmount("a"))
    with pytest.raises(clean.MappingError, match="description unmapped"):
        clean.map_ledger(src(spark), empty, BatchInfo("c", 2024, "b"))
    with pytest.raises(ProfileError, match="unknown targets: nope"):
        Profile("p", {**BASE, "nope": "x"})


def test_direct_mode_falls_back_to_mapped_rc_amount(spark):
    prof = Profile("p", {**BASE, "rc_amount": "a"}, DirectAmount())
    out = clean.ledger_rows(clean.map_ledger(src(spark), prof, BatchInfo("c", 2024, "b")))
    assert sorted(r[0] for r in out.select("rc_amount").collect()) == [Decimal("-3.00"), Decimal("10.00")]


def test_request_checks():
    prof = Profile("p", {**BASE}, DirectAmount())
    with pytest.raises(ImportError_):
        _check_request("pdf", "append", None, prof)
    with pytest.raises(ImportError_):
        _check_request("csv", "merge", None, prof)
    with pytest.raises(ImportError_):
        _check_request("csv", "append", None, None)
    with pytest.raises(ImportError_):
        _check_request("csv", "append", "maybe", prof)
    _check_request("excel", "new", "skip", prof)


def test_extra_columns_opt_in(spark):
    prof = Profile("p", {**BASE, "employee_name": "emp", "currency": "cur"}, DirectAmount("a"))
    plain = clean.map_ledger(src(spark), prof, BatchInfo("c", 2024, "b"))
    assert "currency" not in plain.columns
    extra = clean.map_ledger(src(spark), prof, BatchInfo("c", 2024, "b"), extra_columns=True)
    rows = extra.orderBy("source_row").select("employee_name", "currency", "department").collect()
    assert [tuple(r) for r in rows] == [("Alice", "CNY", None), (None, "USD", None)]


def test_legacy_migration_and_derived(spark):
    old = spark.createDataFrame([("2024-03-05", "V1", "Cash", "s")], "book_date string, voucher_no string, ac_name string, summary string")
    new = views.migrate_legacy(old)
    assert new.columns == ["posting_date", "voucher_id", "ac_caption", "description"]
    d = views.with_legacy_derived(new.withColumn("posting_date", F.col("posting_date").cast("date")))
    assert d.first()["month"] == 3


def test_sql_guard(spark):
    for bad in ["", "   ", "DROP TABLE x", "insert into t values (1)", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a",
                "CREATE TABLE t AS SELECT 1", "nonsense"]:
        with pytest.raises(views.SqlGuardError):
            views.guard_sql(spark, bad)
    assert views.guard_sql(spark, "  WITH a AS (SELECT 1) SELECT * FROM a ") .startswith("WITH")
    assert views.run_sql(spark, "select 1 as x").first()["x"] == 1


def test_form_filter_errors():
    with pytest.raises(FilterError):
        filter_condition(LedgerFilter(min_amount="abc"))
    with pytest.raises(FilterError):
        filter_condition(LedgerFilter(date_from="2024-13-01"))


def test_paging_and_export(spark, workdir):
    df = spark.range(0, 2500).select(F.col("id"), (F.col("id") % 7).cast("string").alias("k"))
    order = paging.grid_order(df, "id")
    p = paging.page(df, order, 100, 3).collect()
    assert [r["id"] for r in p] == list(range(300, 400))
    assert paging.page(df, order, None, 0).count() == 2500
    info = paging.page_info(df, "", 500).first()
    assert (info["total_rows"], info["filtered_rows"], info["page_count"], info["row_label"]) == (2500, 2500, 5, "2500")
    assert paging.clamp_page(9, 5) == 4 and paging.clamp_page(3, 0) == 0
    numbered = paging.split_sheets(df, [F.col("id").desc()], 1000)
    s = paging.sheet_summary(numbered, 1000).first()
    assert (s["sheet_count"], s["total_rows"], s["split_applied"]) == (3, 2500, True)
    out = os.path.join(workdir, "export")
    paging.export_sheets(numbered, out)
    files = sorted(glob.glob(os.path.join(out, "sheet_no=*", "*.csv")))
    assert len(files) == 3
    with open([f for f in files if "sheet_no=1" in f][0]) as fh:
        lines = fh.read().splitlines()
    assert lines[0] == "id,k" and lines[1].startswith("2499,") and len(lines) == 1001
    none = paging.split_sheets(df.limit(0), [F.col("id")], 1000)
    empty = paging.sheet_summary(none, 1000).first()
    assert (empty["sheet_count"], empty["total_rows"], empty["split_applied"]) == (1, 0, False)
    out2 = os.path.join(workdir, "export-empty")
    paging.export_sheets(none, out2)
    files = glob.glob(os.path.join(out2, "sheet_no=1", "*.csv"))
    assert len(files) == 1 and open(files[0]).read() == "id,k\n"


def test_grid_sort_nulls_and_case(spark):
    df = spark.createDataFrame([("b",), (None,), ("A",), ("c",)], "v string")
    asc = [r[0] for r in paging.sort_grid(df, "v").collect()]
    desc = [r[0] for r in paging.sort_grid(df, "v", descending=True).collect()]
    assert asc == ["A", "b", "c", None] and desc == [None, "c", "b", "A"]


def test_rule_registry(spark):
    df = spark.createDataFrame(
        [("2024-01-06", "V1", Decimal("2000000.00"), " "), ("2024-01-08", "V2", Decimal("5.00"), "x")],
        "d string, voucher_id string, rc_amount decimal(18,2), description string",
    ).withColumn("posting_date", F.col("d").cast("date")).drop("d")
    assert rules.run_rule(df, "大额凭证").count() == 1
    assert rules.run_rule(df, "weekend_entry").count() == 1
    allr = rules.run_rules(df)
    assert sorted(r[0] for r in allr.groupBy("rule").count().collect()) == ["empty_description", "high_value", "weekend_entry"]
    with pytest.raises(KeyError):
        rules.run_rule(df, "nope")
