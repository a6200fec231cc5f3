"""The store under collisions, crashes, many batches and a growing log."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import new_store, write_csv
from ledgerspark.functions import text
from ledgerspark.operators import paging
from ledgerspark.operators.duplicates import DuplicateError
from ledgerspark.plans.importer import import_batch
from ledgerspark.plans.store import LedgerStore
from ledgerspark.schema import BatchInfo, DirectAmount, Profile
from ledgerspark.session import open_files
from ledgerspark.sources.csv import read_journal_csv

HEAD = "posting_date,voucher_id,ac_code,ac_caption,description,amount\n"
PROFILE = Profile("p", {c: c for c in HEAD.split(",")[:5]}, DirectAmount("amount"))


def rows(n, voucher="V", day="2024-01-02"):
    return HEAD + "".join(f"{day},{voucher}{i},1001,Cash,x,{i + 1}\n" for i in range(n))


def load(spark, workdir, store, body, batch, client="Client A", year=2024, name=None, **kw):
    src = read_journal_csv(spark, write_csv(workdir, f"{name or batch}.csv", body))
    return import_batch(src, PROFILE, BatchInfo(client, year, batch, F.col("source_file")), store, **kw)


def files(store, table):
    return [f for f in os.listdir(store.path(table)) if f.endswith(".commit")]


def test_clients_that_share_a_key_stay_apart(spark, workdir, monkeypatch):
    monkeypatch.setattr(text, "CLIENT_KEY_HEX", 0)
    store = new_store(spark, workdir)
    load(spark, workdir, store, rows(2), "a", client="Client A")
    load(spark, workdir, store, rows(3), "b", client="Client B", import_mode="new")
    assert store.open_ledger().count() == 5
    assert store.open_ledger(client_name="Client A").count() == 2
    assert store.open_ledger(client_name=" Client B ").count() == 3
    assert store.open_ledger(with_duplicate_flag=True).filter("is_duplicate").count() == 0


def test_a_failure_before_publishing_changes_nothing(spark, workdir, monkeypatch):
    store = new_store(spark, workdir)
    load(spark, workdir, store, rows(2), "a")

    def broken(*args, **kw):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(LedgerStore, "publish", broken)
        with pytest.raises(RuntimeError):
            load(spark, workdir, store, rows(3, "W"), "b", import_mode="new")
    assert store.open_ledger().count() == 2
    with monkeypatch.context() as m:
        m.setattr(LedgerStore, "write_rows", broken)
        with pytest.raises(RuntimeError):
            load(spark, workdir, store, rows(3, "X"), "c")
    status = {r["import_batch_id"]: r["status"] for r in store.batch_status().collect()}
    assert status["a"] == "active" and status["c"] == "failed"
    load(spark, workdir, store, rows(4, "Y"), "d", import_mode="new")
    assert store.open_ledger().count() == 4
    assert {r["import_batch_id"]: r["status"] for r in store.batch_status().collect()}["a"] == "replaced"


def test_log_stays_small(spark, workdir):
    store = new_store(spark, workdir)
    for i in range(4):
        load(spark, workdir, store, rows(1, f"V{i}-"), f"b{i}")
    assert len(files(store, "batch_status/log")) == 8  # staged and active
    before = sorted(tuple(r)[:5] for r in store.batch_status().collect())
    store.compact_log()
    assert len(store.log.state().folders) == 1
    assert sorted(tuple(r)[:5] for r in store.batch_status().collect()) == before
    assert store.open_ledger().count() == 4


def test_dataset_of_many_batches(spark, workdir):
    store = new_store(spark, workdir)
    for i in range(3):
        load(spark, workdir, store, rows(2, f"V{i}-"), f"b{i}", dataset_name="all")
    assert store.open_dataset("all").count() == 6
    store.rollback_batch("b1")
    assert store.open_dataset("all").count() == 4
    assert os.path.isdir(store.read("datasets").first()["ledger_path"])


def test_duplicates_over_files_and_without_row_numbers(spark, workdir):
    store = new_store(spark, workdir)
    folder = os.path.join(workdir, "in")
    os.makedirs(folder)
    for name in ("one.csv", "two.csv"):
        write_csv(folder, name, rows(2))
    src = read_journal_csv(spark, folder)
    import_batch(src, PROFILE, BatchInfo("Client A", 2024, "a", F.col("source_file")), store)
    led = store.open_ledger(with_duplicate_flag=True)
    assert sorted((r["source_file"], r["is_duplicate"]) for r in led.collect()) == [
        ("one.csv", False), ("one.csv", False), ("two.csv", True), ("two.csv", True)
    ]
    with pytest.raises(ValueError, match="source_row"):
        import_batch(src.drop("source_row"), PROFILE, BatchInfo("Client A", 2024, "b", "f"), store)
    with pytest.raises(DuplicateError) as found:
        import_batch(src, PROFILE, BatchInfo("Client A", 2024, "c", F.col("source_file")), store, duplicate_mode="strict")
    assert found.value.rows == 4 and store.open_ledger().count() == 4


def test_rows_without_a_year_are_rejected(spark, workdir):
    store = new_store(spark, workdir)
    body = "y," + HEAD + "2024,2024-01-02,V1,1,Cash,x,1\nno year,2024-01-02,V2,1,Cash,x,1\n"
    src = read_journal_csv(spark, write_csv(workdir, "y.csv", body))
    import_batch(src, PROFILE, BatchInfo("Client A", F.expr("try_cast(y AS INT)"), "a", "y.csv"), store)
    assert [r["voucher_id"] for r in store.open_ledger().collect()] == ["V1"]
    assert store.read("import_reports").first()["failed_rows"] == 1


def test_pages_read_once_sorted(spark, workdir):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"), (F.col("id") % 3).cast("string").alias("s"))
    with paging.Pages(df.repartition(4), [F.col("id").desc()]) as pages:
        assert [r["id"] for r in pages.page(30, 2).collect()] == list(range(939, 909, -1))
        assert [r["id"] for r in pages.page(30, 99).collect()] == list(range(9, -1, -1))  # past the end: the last page
        assert len(pages.page(30, 2).inputFiles()) <= 2
        assert pages.page(None, 0).count() == 1000
        path = pages.path
    assert not os.path.exists(path)
    assert paging.Pages(df.limit(0), [F.col("id")]).page(10, 3).count() == 0
    assert [r["id"] for r in paging.page(df, [F.col("id").asc()], 300, 7).collect()] == list(range(900, 1000))


def test_partitioned_writes_of_an_import_do_not_sort_the_rows(spark, workdir, monkeypatch):
    writer = type(spark.range(1).write)
    real, seen = writer.parquet, {}

    def parquet(self, path, *args, **kw):
        seen[path.split("/store-")[-1].split("/")[1]] = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
        return real(self, path, *args, **kw)

    monkeypatch.setattr(writer, "parquet", parquet)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    store = new_store(spark, workdir)
    load(spark, workdir, store, rows(3) + "2024-01-02,,1001,Cash,x,1\n", "a")
    assert all(int(seen[t]) > 0 for t in ("rows", "summary_accounts", "summary_vouchers"))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert store.open_ledger().count() == 3 and store.open_errors().count() == 1


def test_a_write_of_more_partitions_than_open_files_is_whole(spark, workdir):
    path = os.path.join(workdir, "many")
    with open_files(spark, 2):
        spark.range(0, 1000, 1, 1).withColumn("p", F.col("id") % 7).write.partitionBy("p").parquet(path)
    back = spark.read.parquet(path)
    assert back.filter("p = id % 7").count() == 1000 == back.select("id").distinct().count()


def test_few_active_batches_are_filtered_and_many_joined_alike(spark, workdir, monkeypatch):
    from ledgerspark.plans import store as store_module

    store = new_store(spark, workdir)
    load(spark, workdir, store, rows(3), "a", client="Client A")
    load(spark, workdir, store, rows(4, "W"), "b", client="Client B", year=None)
    load(spark, workdir, store, rows(5, "X"), "c", client="Client A", year=2023)
    store.rollback_batch("c")

    def opened():
        led, errors = store.open_ledger(), store.open_errors()
        plan = led._jdf.queryExecution().optimizedPlan().toString()
        return "Join" in plan, sorted(r[0] for r in led.select("voucher_id").collect()), errors.count()

    few = opened()
    monkeypatch.setattr(store_module, "FILTER_KEYS", 1)
    many = opened()
    assert (few[0], many[0]) == (False, True)
    assert few[1:] == many[1:] == (["V0", "V1", "V2"], 4)
    store.rollback_batch("a")
    store.rollback_batch("b")
    assert store.open_ledger().count() == 0
