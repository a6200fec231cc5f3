"""Column expressions against DuckDB on the same inputs (the engine whose
casts and LIKE the behaviour is defined by)."""

from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerspark.functions.amounts import parse_amount, signed_amount
from ledgerspark.functions.dates import tolerant_date
from ledgerspark.functions.text import client_key, contains_like, is_blank, normalise_name, prefixed, safe_name
from ledgerspark.schema import FlaggedAmount, Profile

DATES = [
    "2024-01-02", "2024-1-2", " 2024-01-02 ", "2024-01-02 10:11:12", "2024-01-02T10:11", "2024/01/02",
    "2024 01 02", "2024\\01\\02", "2024", "2024-01", "45292", "2024-01-02 xx", "20240102", "01/02/2024",
    "2024.01.02", "2024-13-01", "2024-02-30", "2024-02-29", "bad-date", "", None, "0024-01-02", "2024-01/02",
]
AMOUNTS = ["1,234.5", " 12 ", "1e3", "100.555", "12345678901234567890", "", None, "-0.005", "abc", "-25.25", "+7"]


def duck(sql_expr, values, typ="VARCHAR"):
    con = duckdb.connect()
    out = []
    for v in values:
        out.append(con.execute(f"SELECT {sql_expr.format(x='CAST(? AS ' + typ + ')')}", [v]).fetchone()[0])
    return out


def spark_vals(spark, col_fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(col_fn(F.col("v"))).collect()]


def test_dates_agree_with_duckdb(spark):
    got = spark_vals(spark, tolerant_date, DATES)
    want = duck("TRY_CAST({x} AS DATE)", DATES)
    assert got == want


def test_dayfirst_dates(spark):
    got = spark_vals(spark, lambda c: tolerant_date(c, dayfirst=True), ["02/01/2024", "2024-01-02", "31.12.2023", "32/01/2024"])
    import datetime as dt

    assert got == [dt.date(2024, 1, 2), dt.date(2024, 1, 2), dt.date(2023, 12, 31), None]


def test_amounts_agree_with_duckdb(spark):
    got = spark_vals(spark, parse_amount, AMOUNTS)
    want = duck("TRY_CAST({x} AS DECIMAL(18,2))", AMOUNTS)
    assert got == want
    got = spark_vals(spark, lambda c: parse_amount(c, remove_commas=True), ["1,234.5"])
    assert got == [Decimal("1234.50")]


def test_flags_exact_match(spark):
    df = spark.createDataFrame([("借 ", "5"), ("d", "5"), (None, "5"), ("借", "5"), ("H", "-5")], "f string, a string")
    rules = FlaggedAmount("a", "f")
    out = [r[0] for r in df.select(signed_amount(Profile("p", {}, rules), lambda n: F.col(n))).collect()]
    assert out == [None, None, None, Decimal("5.00"), Decimal("-5.00")]


@pytest.mark.parametrize("needle", ["a_b", "50%", "x\\y", "it's", "%", "_"])
def test_like_needles_agree_with_duckdb(spark, needle):
    rows = ["a_b", "axb", "50%", "500", "x\\y", "xy", "it's", "its"]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string").orderBy("i").select(contains_like("v", needle)).collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT ? LIKE ?", [v, "%" + needle + "%"]).fetchone()[0] for v in rows]
    assert got == want


def test_blanks_and_prefix(spark):
    vals = ["   ", "\t", None, "", " 7 "]
    assert spark_vals(spark, is_blank, vals) == [True, False, True, True, False]
    assert spark_vals(spark, lambda c: prefixed(c, "v_"), vals) == [None, "v_\t", None, None, "v_7"]
    assert spark_vals(spark, lambda c: prefixed(c, None), vals) == vals


def test_client_key_safe_name_normalise(spark):
    import hashlib

    names = ["Acme Ltd", "  Acme Ltd\t", "客户甲"]
    want = ["client_" + hashlib.sha1(n.strip().encode()).hexdigest()[:8] for n in names]
    assert spark_vals(spark, client_key, names) == want

    def py_safe(v):
        s = "".join(ch if ch.isalnum() or ch in "-_" else "_" for ch in v).strip("_")
        return s or "ledger_dataset"

    ds = ["ABC 2024 Ledger", "__x__", "###", "客户/甲-2024", "a.b"]
    assert spark_vals(spark, safe_name, ds) == [py_safe(v) for v in ds]
    hd = [" Voucher_No ", "凭证　号", "AC CODE"]
    assert spark_vals(spark, normalise_name, hd) == [v.strip().lower().replace(" ", "").replace("_", "").replace("　", "") for v in hd]
