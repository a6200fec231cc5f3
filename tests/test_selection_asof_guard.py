"""Pages by rank, the as-of join, the guard's policy and the containment join."""

import datetime as dt
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import mapping, paging, selection, views
from ledgerspark.operators.asof import asof_join
from ledgerspark.operators.selection import SortKey, page_by_rank


@pytest.fixture
def grid(spark):
    rng = random.Random(1)
    word = lambda: rng.choice([None, "", "a", "B", "b", "Ä", "日本", "zz", "z'\\z"])
    day = lambda: rng.choice([None, dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(40))])
    rows = [(word(), rng.choice([None, rng.randrange(30)]), day(), rng.random() // 0.2) for _ in range(3000)]
    rows += [("b", 7, None, 1.0)] * 400  # equal rows
    return spark.createDataFrame(rows, "s string, n int, d date, f double").repartition(4)


@pytest.mark.parametrize("part_rows", [5, 200])
def test_pages_equal_a_sort(spark, grid, monkeypatch, part_rows):
    monkeypatch.setattr(selection, "PART_ROWS", part_rows)
    monkeypatch.setattr(selection, "CUTS", 6)
    for column, descending in (("s", True), ("n", False)):
        want = [tuple(r) for r in paging.sort_grid(grid, column, descending).collect()]
        pages = [(7, 0), (13, 100), (500, 3), (10, 10**6), (4000, 0)]
        for size, index in pages:
            got = [tuple(r) for r in paging.grid_page(grid, column, descending, size, index).collect()]
            start = min(index, -(-len(want) // size) - 1) * size
            part = want[start : start + size]
            fold = lambda rows: [(r[0].lower() if column == "s" and r[0] else r[0], *r[1:]) for r in rows]
            assert fold(got) == fold(part) and sorted(map(str, got)) == sorted(map(str, part))


def test_nothing_is_written(spark, grid, monkeypatch):
    monkeypatch.setattr(paging, "write_sorted", None)
    assert paging.grid_page(grid, "n", False, 10, 200).count() == 10
    assert paging.grid_page(grid.limit(0), "n", False, 10, 3).count() == 0
    keys = [SortKey(F.col(c)) for c in grid.columns]
    assert page_by_rank(grid, keys, 5, 10**6).count() == 0


# -- as-of join -----------------------------------------------------------------


def asof_brute(left, right):
    con = duckdb.connect()
    con.register("l", pd.DataFrame(left, columns=["id", "k", "t"]))
    con.register("r", pd.DataFrame(right, columns=["k", "rt", "rate"]))
    q = "SELECT id, rt, rate FROM l ASOF LEFT JOIN (SELECT k, rt, max(rate) AS rate FROM r WHERE k IS NOT NULL GROUP BY ALL) r ON l.k = r.k AND l.t >= r.rt"
    return {r[0]: (None if r[1] is None or r[1] != r[1] else r[2]) for r in con.execute(q).fetchall()}


def test_asof_equals_duckdb(spark):
    rng = random.Random(2)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 400))
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "none", None])
    left = [(i, key(), at()) for i in range(2000)]
    right = [(rng.choice(["hot", "a", "b", None]), at(), float(rng.randrange(99))) for _ in range(300)]
    right += [(r[0], r[1], r[2] + 1) for r in right[:20]]
    lf = spark.createDataFrame(left, "id long, k string, t timestamp_ntz").withColumn("rate_note", F.lit("x"))
    rf = spark.createDataFrame(right, "k string, rt timestamp_ntz, rate double")
    want = asof_brute(left, right)
    for bucket in ("year", "month", "hour"):
        out = asof_join(lf, rf, ["k"], "t", "rt", bucket=bucket)
        assert out.columns == ["id", "k", "t", "rate_note", "rt", "rate"]
        got = out.collect()
        assert len(got) == 2000 and {r["id"]: r["rate"] for r in got} == want
    empty = asof_join(lf, rf.filter("false"), ["k"], "t", "rt")
    assert empty.count() == 2000 and empty.filter("rate IS NOT NULL").count() == 0
    assert asof_join(lf.limit(0), rf, ["k"], "t", "rt").count() == 0


def test_asof_spreads_one_key(spark):
    """All rows have one key: its buckets lie in many partitions."""
    left = spark.range(40_000).select(
        F.lit("k").alias("k"), F.expr("date_add(date'2000-01-01', CAST(id % 4000 AS INT))").alias("t"), "id"
    )
    right = left.filter("id % 400 = 0").select("k", F.col("t").alias("rt"), F.col("id").alias("rate"))
    out = asof_join(left, right, ["k"], "t", "rt")
    seen = out.select("id", "rate").collect()
    assert len(seen) == 40_000 and all(r["rate"] is not None for r in seen)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_b" in plan and "SinglePartition" not in plan


# -- guard ------------------------------------------------------------------------

LEDGER = "posting_date date, voucher_id string, ac_code string, ac_caption string, rc_amount decimal(18,2), description string"


def test_guard_policy(spark, workdir):
    views.register_views(spark, spark.createDataFrame([(None, "V", "1", "Cash", None, "x")], LEDGER))
    path = os.path.join(workdir, "secret")
    spark.range(1).write.parquet(path)
    java = "java_method('java.lang.System', 'setProperty', 'guard.test', 'ran')"
    spark.udf.register("mine", lambda x: x)
    for bad in (
        f"SELECT {java}",
        f"SELECT reflect('java.lang.System', 'setProperty', 'guard.test', 'ran') FROM ledger",
        f"SELECT try_reflect('java.lang.System', 'setProperty', 'guard.test', 'ran')",
        f"WITH x AS (SELECT {java} AS y) SELECT * FROM x",
        f"SELECT * FROM ledger WHERE ac_code IN (SELECT {java})",
        f"SELECT * FROM VALUES ({java}) AS t(a)",
        f"SELECT * FROM ledger l LATERAL VIEW explode(array({java})) t AS z",
        f"SELECT count(*) FROM ledger GROUP BY {java}",
        f"SELECT * FROM parquet.`{path}`",
        f"SELECT (SELECT max(id) FROM parquet.`{path}`) AS m FROM ledger",
        f"WITH x AS (SELECT * FROM parquet.`{path}`) SELECT * FROM x",
        "SELECT mine(ac_code) FROM ledger",
        "DROP VIEW ledger",
        "INSERT INTO ledger SELECT * FROM ledger",
    ):
        with pytest.raises(views.SqlGuardError):
            views.run_sql(spark, bad)
    assert spark.sparkContext._jvm.java.lang.System.getProperty("guard.test") is None
    for good in (
        "SELECT * FROM ledger",
        "SELECT 1 AS one",
        "WITH a AS (SELECT * FROM ledger) SELECT a.ac_code, count(*) FROM a JOIN journal ON true GROUP BY ROLLUP (a.ac_code)",
        "SELECT * FROM ledger WHERE EXISTS (SELECT 1 FROM journal) AND rc_amount > (SELECT avg(rc_amount) FROM ledger)",
        "SELECT explode(array(1, 2)) AS x, from_json('{\"a\":1}', 'a INT').a AS a, transform(array(1), v -> v + 1) AS t",
        "SELECT * FROM range(3) UNION ALL SELECT * FROM VALUES (1), (2) AS t(id)",
        "SELECT ac_code, rank() OVER (ORDER BY rc_amount) FROM ledger ORDER BY 2 LIMIT 3",
    ):
        views.run_sql(spark, good).collect()
    assert views.run_sql(spark, "SHOW VIEWS").count() >= 2


# -- containment join ----------------------------------------------------------------


def test_profiles_without_pairs(spark):
    """Many headers and profiles of one client: only headers that have a
    requirement's rarest column meet it."""
    n = 400
    files = [(i, "c", "csv", None, ["date", "voucher", "account", "name", "text", f"amount{i % 50}"]) for i in range(n)]
    need = {"posting_date": "date", "voucher_id": "voucher", "ac_code": "account", "ac_caption": "name", "description": "text"}
    profs = [(f"p{j}", j, "c", "csv", None, need, f"amount{j % 60}") for j in range(120)]
    ff = spark.createDataFrame(files, "file_id int, client_name string, source_type string, source_sheet string, columns array<string>")
    pf = spark.createDataFrame(
        profs,
        "profile_name string, profile_order int, client_name string, source_type string, source_sheet string, "
        "mapping map<string,string>, direct_amount_field string",
    ).select(
        "*", F.lit("direct").alias("amount_mode"),
        *[F.lit(None).cast("string").alias(c) for c in ("amount_field", "drcr_field", "debit_field", "credit_field")],
    )
    pf = pf.withColumn("amount_mode", F.lit(mapping.MODE_DIRECT))
    got = {r["file_id"]: (r["profile_name"], r["required_sources"]) for r in mapping.match_profiles(ff, pf).collect()}
    assert got == {i: (f"p{i % 50}", 6) for i in range(n)}
