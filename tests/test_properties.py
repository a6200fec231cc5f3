"""Property checks: generated date-like and number-like text parses the same
as DuckDB's TRY_CAST; the distributed row index equals a sort."""

import duckdb
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerspark.functions.amounts import parse_amount
from ledgerspark.functions.dates import tolerant_date
from ledgerspark.operators.rowindex import with_row_index

sep = st.sampled_from(["-", "/", " ", "\\\\", "."])
date_text = st.one_of(
    st.builds(
        lambda y, s1, m, s2, d, tail, pad: f"{pad}{y}{s1}{m}{s2}{d}{tail}{pad}",
        st.integers(1, 9999).map(str),
        sep,
        st.integers(0, 14).map(lambda v: str(v).zfill(st_z) if (st_z := v % 2 + 1) else str(v)),
        sep,
        st.integers(0, 33).map(str),
        st.sampled_from(["", " 10:11", "T08:00:00", " xx", ":"]),
        st.sampled_from(["", " "]),
    ),
    st.text(alphabet="0123456789-/ .:T", max_size=12),
)
number_text = st.one_of(
    st.decimals(allow_nan=False, allow_infinity=False, places=3, min_value=-10**12, max_value=10**12).map(str),
    # exponent forms are covered by the explicit table in test_expressions;
    # DuckDB also accepts '56E3.' and '0E77', which no journal amount looks like
    st.text(alphabet="0123456789-+. ,", max_size=10),
    st.builds(lambda m, e: f"{m}e{e}", st.integers(1, 999), st.integers(-3, 6)),
)


def _duck(expr, values):
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, v VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    return [r[0] for r in con.execute(f"SELECT {expr} FROM t ORDER BY i").fetchall()]


def _spark(spark, fn, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


@settings(max_examples=4, deadline=None, phases=[Phase.explicit, Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(date_text, min_size=50, max_size=120))
def test_dates_match_duckdb(spark, values):
    # five-digit years are NULL here on purpose; the generator stays within four
    assert _spark(spark, tolerant_date, values) == _duck("TRY_CAST(v AS DATE)", values)


@settings(max_examples=4, deadline=None, phases=[Phase.explicit, Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(number_text, min_size=50, max_size=120))
def test_amounts_match_duckdb(spark, values):
    assert _spark(spark, parse_amount, values) == _duck("TRY_CAST(v AS DECIMAL(18,2))", values)


@settings(max_examples=3, deadline=None, phases=[Phase.explicit, Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 10**6)), min_size=1, max_size=300, unique=True))
def test_row_index_is_a_sort(spark, pairs):
    df = spark.createDataFrame(pairs, "a int, b int").repartition(5)
    got = {(r.a, r.b): r.rn for r in with_row_index(df, [F.col("a").desc(), "b"], "rn").collect()}
    want = {p: i + 1 for i, p in enumerate(sorted(pairs, key=lambda p: (-p[0], p[1])))}
    assert got == want
