"""End-to-end import scenarios (CSV -> cleaned, published ledger -> query)."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import new_store, write_csv
from ledgerspark.operators import summaries, views
from ledgerspark.plans.importer import import_batch
from ledgerspark.plans import history
from ledgerspark.schema import (
    MODE_DEBIT_CREDIT,
    MODE_DIRECT,
    MODE_FLAG,
    DirectAmount,
    FlaggedAmount,
    BatchInfo,
    Profile,
    TwoColumnAmount,
)
from ledgerspark.sources.csv import read_journal_csv

BASE = dict(posting_date="posting_date", voucher_id="voucher_id", ac_code="ac_code", ac_caption="ac_caption", description="description")


def direct_profile(**rules):
    return Profile(
        "direct", {**BASE}, DirectAmount("amount"), **rules
    )


def run_import(spark, workdir, text, profile, batch_id="b1", client="Client A", year=2024, store=None, **kw):
    path = write_csv(workdir, f"{batch_id}.csv", text)
    src = read_journal_csv(spark, path)
    store = store or new_store(spark, workdir)
    res = import_batch(src, profile, BatchInfo(client, year, batch_id, f"{batch_id}.csv"), store, source_path=path, **kw)
    return store, res


DIRECT = """posting_date,voucher_id,ac_code,ac_caption,description,amount
2024-01-02,V001,1001,Cash,Opening balance,100.50
2024-01-03,V002,6001,Expense,Office supplies,-25.25
"""


def test_direct_import_query_and_journal(spark, workdir):
    store, res = run_import(spark, workdir, DIRECT, direct_profile())
    assert (res.total_rows, res.success_rows, res.failed_rows) == (2, 2, 0)
    led = store.open_ledger()
    assert led.agg(F.sum("rc_amount")).first()[0] == Decimal("75.25")
    j = views.journal_view(led).orderBy("voucher_no").select("voucher_no", "ac_name").collect()
    assert [tuple(r) for r in j] == [("V001", "Cash"), ("V002", "Expense")]
    assert led.columns[:3] == ["posting_date", "voucher_id", "voucher_header"]
    assert res.positive_rows == 1 and res.negative_rows == 1 and res.zero_rows == 0
    assert (res.posting_date_min, res.posting_date_max) == ("2024-01-02", "2024-01-03")


def test_amount_with_drcr_flag(spark, workdir):
    text = """posting_date,voucher_id,ac_code,ac_caption,description,drcr,amount
2024-01-02,V001,1001,Cash,debit,借,100
2024-01-03,V002,1001,Cash,credit,贷,200
"""
    prof = Profile(
        "flag",
        {**BASE, "drcr": "drcr"},
        FlaggedAmount("amount", "drcr", ("借",), ("贷",)),
    )
    store, _ = run_import(spark, workdir, text, prof)
    got = dict(store.open_ledger().select("voucher_id", "rc_amount").collect())
    assert got == {"V001": Decimal("100.00"), "V002": Decimal("-200.00")}


def test_debit_credit_columns(spark, workdir):
    text = """posting_date,voucher_id,ac_code,ac_caption,description,debit,credit
2024-01-02,V001,1001,Cash,debit,300,
2024-01-03,V002,1001,Cash,credit,,80
"""
    prof = Profile(
        "dc", {**BASE}, TwoColumnAmount("debit", "credit")
    )
    store, _ = run_import(spark, workdir, text, prof)
    assert store.open_ledger().agg(F.sum("rc_amount")).first()[0] == Decimal("220.00")


ERRORS = """posting_date,voucher_id,ac_code,ac_caption,description,amount
2024-01-02,V001,1001,Cash,valid,100
bad-date,V002,1001,Cash,bad date,200
2024-01-04,,1001,Cash,blank voucher,300
2024-01-05,V004,1001,Cash,,400
2024-01-06,V005,1001,Cash,bad amount,not-a-number
"""


def test_import_errors(spark, workdir):
    store, res = run_import(spark, workdir, ERRORS, direct_profile())
    assert (res.total_rows, res.success_rows, res.failed_rows) == (5, 3, 2)
    rows = [e["source_row"] for e in res.import_errors]
    assert rows == [3, 5]
    assert res.import_errors[0]["error_message"] == "voucher_id 为空"
    assert res.import_errors[1]["error_message"] == "rc_amount 无法转换或借贷标识无法识别"
    led = store.open_ledger()
    assert led.filter(F.col("voucher_id") == "V002").first()["posting_date"] is None
    errs = store.open_errors()
    assert errs.count() == 2
    payload = errs.filter(F.col("source_row") == 5).first()["raw_payload"]
    assert '"amount":"not-a-number"' in payload


def test_prefix_rules(spark, workdir):
    text = """posting_date,voucher_id,ac_code,ac_caption,description,vendor_id,customer_id,amount
2024-01-02,001,1001,Cash,desc,88,99,120
2024-01-03,002,1002,Bank,,,,300
"""
    prof = Profile(
        "prefix",
        {**BASE, "vendor_id": "vendor_id", "customer_id": "customer_id"},
        DirectAmount("amount"),
        prefixes={
            "voucher_id": "v_",
            "ac_code": "ac_",
            "vendor_id": "s_",
            "customer_id": "c_",
        },
    )
    store, _ = run_import(spark, workdir, text, prof)
    got = sorted(tuple(r) for r in store.open_ledger().select("voucher_id", "ac_code", "vendor_id", "customer_id").collect())
    assert got == [("v_001", "ac_1001", "s_88", "c_99"), ("v_002", "ac_1002", None, None)]


def test_sql_history_one_entry(spark, workdir):
    store = new_store(spark, workdir)
    assert history.record_query(store, "SELECT * FROM ledger LIMIT 1", "ds")
    assert history.record_query(store, "  SELECT * FROM ledger LIMIT 1  ", "ds")
    assert not history.record_query(store, "   ", "ds")
    rows = history.recent_queries(store).collect()
    assert len(rows) == 1 and rows[0]["sql_text"] == "SELECT * FROM ledger LIMIT 1"
    history.run_logged(store, "select 2 as x", "ds").collect()
    with pytest.raises(Exception):
        history.run_logged(store, "select nope_column_zz from range(1)", "ds")
    assert [r["sql_text"] for r in history.recent_queries(store).collect()] == ["select 2 as x", "SELECT * FROM ledger LIMIT 1"]


def test_bare_parquet(spark, workdir):
    import datetime as dt
    import os

    path = os.path.join(workdir, "bare.parquet")
    spark.createDataFrame(
        [(dt.date(2024, 7, 1), "V001", "1001", "Cash", Decimal("10.00"), "bare row")],
        "posting_date date, voucher_id string, ac_code string, ac_caption string, rc_amount decimal(18,2), description string",
    ).write.parquet(path)
    df = spark.read.parquet(path)
    led = views.register_views(spark, df, "bare_ledger", "bare_journal")
    s = summaries.dataset_summary(led).first()
    assert s["row_count"] == "1" and s["client_name"] == "" and s["fiscal_year"] == ""
    j = spark.sql("SELECT client_name, fiscal_year FROM bare_journal").first()
    assert j["client_name"] is None and j["fiscal_year"] is None


def test_missing_required_column_is_an_error(spark, workdir):
    df = spark.createDataFrame([("V1",)], "voucher_id string")
    with pytest.raises(views.LedgerSchemaError) as e:
        views.check_required(df)
    assert "ac_caption, ac_code, description, posting_date, rc_amount" in str(e.value)


def test_invariants_and_rollback(spark, workdir):
    store, r1 = run_import(spark, workdir, DIRECT, direct_profile(), batch_id="b1")
    _, r2 = run_import(spark, workdir, ERRORS, direct_profile(), batch_id="b2", store=store)
    led = store.open_ledger()
    total = led.agg(F.sum("rc_amount")).first()[0]
    by_voucher = sum(r["voucher_amount"] for r in summaries.voucher_imbalance(led, tolerance=-1).collect())
    by_account = sum(r["total_amount"] for r in summaries.account_summary(led).collect())
    assert total == by_voucher == by_account
    assert r1.success_rows + r1.failed_rows == r1.total_rows
    assert led.count() == 5
    rb = store.rollback_batch("b2")
    assert rb.ledger_rows == 3 and rb.error_rows == 2 and rb.batch_rows == 1
    assert sorted(r[0] for r in store.open_ledger().select("import_batch_id").distinct().collect()) == ["b1"]
    store.rollback_batch("b1")  # the only batch of its client and year
    assert store.open_ledger().count() == 0


def test_new_import_replaces_client_year(spark, workdir):
    store, _ = run_import(spark, workdir, DIRECT, direct_profile(), batch_id="old")
    run_import(spark, workdir, ERRORS, direct_profile(), batch_id="new1", store=store, import_mode="new")
    ids = {r[0] for r in store.open_ledger().select("import_batch_id").distinct().collect()}
    assert ids == {"new1"}
    # another client's year is untouched by a new import
    run_import(spark, workdir, DIRECT, direct_profile(), batch_id="other", client="Client B", store=store, import_mode="new")
    ids = {r[0] for r in store.open_ledger().select("import_batch_id").distinct().collect()}
    assert ids == {"new1", "other"}


def test_duplicates_skip_mark_strict(spark, workdir):
    store, _ = run_import(spark, workdir, DIRECT, direct_profile(), batch_id="d1")
    _, r = run_import(spark, workdir, DIRECT, direct_profile(), batch_id="d2", store=store, duplicate_mode="skip")
    assert r.duplicate_rows == 2 and r.success_rows == 0
    assert store.open_ledger().count() == 2
    _, r = run_import(spark, workdir, DIRECT + DIRECT.splitlines()[1] + "\n", direct_profile(), batch_id="d3", store=store, duplicate_mode="mark")
    flags = store.open_ledger(with_duplicate_flag=True).filter(F.col("import_batch_id") == "d3")
    assert flags.filter("is_duplicate").count() == 3
    from ledgerspark.operators.duplicates import DuplicateError

    with pytest.raises(DuplicateError):
        run_import(spark, workdir, DIRECT, direct_profile(), batch_id="d4", store=store, duplicate_mode="strict")
    assert "d4" not in {r[0] for r in store.open_ledger().select("import_batch_id").distinct().collect()}


def test_blank_csv_fields_null_or_empty(spark, workdir):
    text = 'posting_date,voucher_id,ac_code,ac_caption,description,amount\n2024-01-02,"",1001,Cash,x,1\n2024-01-02,,1001,Cash,x,1\n'
    _, r = run_import(spark, workdir, text, direct_profile())
    assert r.failed_rows == 2


def test_quality_report_and_dataset_lookup(spark, workdir):
    import json

    store, r = run_import(spark, workdir, ERRORS, direct_profile(), batch_id="q1", quality=True, dataset_name="Q ds")
    q = json.loads(r.to_json())["quality"]
    assert q["amount_report"]["converted_rows"] == 4 and q["amount_report"]["empty_amount_rows"] == 0
    cols = {c["target_field"]: c for c in q["columns"]}
    assert cols["posting_date"]["cast_failed_rows"] == 1 and cols["voucher_id"]["missing_rows"] == 1
    assert q["voucher_balance"]["vouchers"] == 3
    assert store.open_dataset("Q ds").count() == 3
    recent = history.recent_datasets(store).collect()
    assert [r["dataset_name"] for r in recent] == ["Q ds"]
    ov = history.overview(store).first()
    assert (ov["dataset_name"], ov["row_count"], ov["status"]) == ("Q ds", "3", "可查询")
    rep = store.read("import_reports").first()
    assert json.loads(rep["report_json"])["import_batch_id"] == "q1"


def test_batch_id_cannot_be_reused(spark, workdir):
    from ledgerspark.plans.importer import ImportError_

    store, _ = run_import(spark, workdir, DIRECT, direct_profile(), batch_id="same")
    with pytest.raises(ImportError_, match="already used"):
        run_import(spark, workdir, DIRECT, direct_profile(), batch_id="same", store=store)
    assert store.open_ledger().count() == 2
