"""The versioned status log, odd batch ids, the key index and summary states."""

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from conftest import new_store
from ledgerspark.operators import duplicates, quality, summaries
from ledgerspark.operators.duplicates import DuplicateError
from ledgerspark.plans import keyindex
from ledgerspark.plans.keyindex import KeyIndex
from ledgerspark.plans.statuslog import CommitConflict, StatusLog
from ledgerspark.plans.store import LedgerStore
from ledgerspark.plans.summary_state import LedgerSummaries
from ledgerspark.session import Scratch
from test_store import HEAD, load, rows


def key(spark, batch, client="client_a", year=2024):
    return spark.createDataFrame([(client, client, year, batch)], "client_key string, client_name string, fiscal_year int, import_batch_id string")


def status(log):
    return {r["import_batch_id"]: r["status"] for r in log.current().collect()}


def changes(store, keys, name):
    return lambda current: store._changes((keys, name))


def test_commits_are_one_after_the_other(spark, workdir):
    log = new_store(spark, workdir).log
    store = LedgerStore(spark, os.path.dirname(log.path))
    assert log.state().version == 0 and log.current().count() == 0
    assert [log.commit(changes(store, key(spark, b), "active"), ["client_a"]) for b in "abc"] == [1, 2, 3]
    assert status(log) == {"a": "active", "b": "active", "c": "active"}
    assert not log._put_if_absent(f"{3:020d}.commit", {"version": 3})
    assert not [f for f in os.listdir(f"{log.path}/log") if "commit" not in f]  # no temporary file is left


def test_a_commit_in_between_rebuilds_what_depends_on_it(spark, workdir):
    store = new_store(spark, workdir)
    calls = []

    def build(current):
        calls.append(current.count())
        if len(calls) == 1:  # another writer commits while this one writes
            store.log.commit(changes(store, key(spark, "other", who), "active"), [who])
        return store._changes((key(spark, "mine"), "active"))

    who = "client_b"  # another client: only the version moves on
    assert store.log.commit(build, ["client_a"]) == 2 and calls == [0]
    calls.clear()
    who = "client_a"
    assert store.log.commit(build, ["client_a"]) == 4 and calls == [2, 3]
    calls.clear()
    with pytest.raises(CommitConflict):
        store.log.commit(build, ["client_a"], since=store.log.state().version)
    assert len(calls) == 1 and set(status(store.log)) == {"mine", "other"}


def test_many_writers_lose_nothing(spark, workdir):
    store = new_store(spark, workdir)

    def write(n):
        for i in range(4):
            store.log.commit(changes(store, key(spark, f"{n}-{i}"), "active"), None)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    store.log.snapshot()
    for t in threads:
        t.join()
    assert store.log.state().version == 12 and len(status(store.log)) == 12


def test_compaction_loses_nothing(spark, workdir, monkeypatch):
    store = new_store(spark, workdir)
    store.log.commit(changes(store, key(spark, "a"), "active"), None)
    write, log = StatusLog._put_if_absent, store.log

    def late(self, name, body):
        if name.endswith(".snapshot"):  # a batch becomes active while the snapshot is written
            monkeypatch.setattr(StatusLog, "_put_if_absent", write)
            log.commit(changes(store, key(spark, "b"), "active"), None)
        return write(self, name, body)

    monkeypatch.setattr(StatusLog, "_put_if_absent", late)
    before = log.state()
    store.compact_log()
    assert status(log) == {"a": "active", "b": "active"} and log.state().tail == 1
    assert log.rows(before).count() == 1  # a reader of the old version is not disturbed
    store.log.snapshot()
    assert store.log.vacuum(dt.timedelta(0)) > 0
    assert status(log) == {"a": "active", "b": "active"} and len(os.listdir(f"{log.path}/data")) == 1
    log.commit(changes(store, key(spark, "c"), "active"), None)
    assert log.state().version == 3 and len(status(log)) == 3


def test_snapshots_are_added_by_writers(spark, workdir, monkeypatch):
    monkeypatch.setattr("ledgerspark.plans.statuslog.SNAPSHOT_EVERY", 2)
    store = new_store(spark, workdir)
    for i in range(7):
        store.log.commit(changes(store, key(spark, f"b{i}"), "active"), None)
    assert store.log.state().tail <= 3 and len(status(store.log)) == 7


IDS = ["a/b", "b{1}", "50%", "[a]", "2024:Q1", "x*y", "x1y", "c d?", "ü=#\\", ".hidden", "_under"]


def test_batch_ids_of_any_characters(spark, workdir):
    store = new_store(spark, workdir)
    for i, batch in enumerate(IDS):
        got = load(spark, workdir, store, rows(i + 1, f"V{i}-"), batch, name=f"f{i}", duplicate_mode=None)
        assert (got.total_rows, got.success_rows) == (i + 1, i + 1)
    counts = {r["import_batch_id"]: r["count"] for r in store.open_ledger().groupBy("import_batch_id").count().collect()}
    assert counts == {b: i + 1 for i, b in enumerate(IDS)}
    assert store.batch_rows("x*y").count() == 6  # not those of x1y as well
    assert store.rollback_batch("a/b").ledger_rows == 1
    with pytest.raises(DuplicateError):
        load(spark, workdir, store, rows(2, "V1-"), "p/q", name="again", duplicate_mode="strict")
    assert store.open_ledger().count() == sum(range(2, len(IDS) + 1))
    with pytest.raises(ValueError, match="already used"):
        load(spark, workdir, store, rows(2), "b{1}", name="twice")


def test_written_rows_that_are_not_found_fail_the_import(spark, workdir, monkeypatch):
    store = new_store(spark, workdir)
    with monkeypatch.context() as m:
        m.setattr(LedgerStore, "batch_rows", lambda self, batch: None)
        with pytest.raises(ValueError, match="3 rows were written, 0 found"):
            load(spark, workdir, store, rows(3), "a", duplicate_mode=None)
    assert store.open_ledger().count() == 0 and status(store.log) == {"a": "failed"}
    got = load(spark, workdir, store, HEAD, "empty", duplicate_mode=None)
    assert got.total_rows == 0


def test_stale_duplicate_marks_are_not_published(spark, workdir, monkeypatch):
    store = new_store(spark, workdir)
    load(spark, workdir, store, rows(1), "a")
    add = KeyIndex.add

    def meanwhile(self, found):
        monkeypatch.setattr(KeyIndex, "add", add)
        load(spark, workdir, store, rows(2, "W"), "other", duplicate_mode=None)
        add(self, found)

    monkeypatch.setattr(KeyIndex, "add", meanwhile)
    with pytest.raises(CommitConflict):
        load(spark, workdir, store, rows(2, "W"), "b", duplicate_mode="strict")
    assert status(store.log) == {"a": "active", "other": "active", "b": "failed"}
    assert [r["import_batch_id"] for r in store.reports().orderBy("import_batch_id").collect()] == ["a", "other"]


def test_rows_without_a_client_are_rejected(spark, workdir):
    store = new_store(spark, workdir)
    body = "who," + HEAD + "A,2024-01-02,V1,1,Cash,x,1\n,2024-01-02,V2,1,Cash,x,1\n \t,2024-01-02,V3,1,Cash,x,1\nA,,,1,Cash,x,1\n"
    got = load(spark, workdir, store, body, "a", client=F.col("who"), duplicate_mode=None)
    assert (got.total_rows, got.success_rows, got.failed_rows) == (4, 1, 3)
    assert store.open_ledger().count() == 1
    reasons = sorted(r["error_message"] for r in store.open_errors().collect())
    assert len(reasons) == 3 and sum("client_name" in r for r in reasons) >= 1
    for nobody in (None, " "):
        with pytest.raises(ValueError, match="client name"):
            load(spark, workdir, store, rows(1), "b", client=nobody, name=f"n{nobody}")


# -- key index ------------------------------------------------------------------


def test_history_is_not_read(spark, workdir, monkeypatch):
    store = new_store(spark, workdir)
    load(spark, workdir, store, rows(50), "a")
    load(spark, workdir, store, rows(50, "W", "2024-03-01"), "b")
    asked = []
    own = LedgerStore._rows

    def only_own(self, client_name=None, fiscal_year=None, batch=None):
        asked.append(batch)
        return own(self, client_name, fiscal_year, batch)

    monkeypatch.setattr(LedgerStore, "_rows", only_own)
    got = load(spark, workdir, store, rows(60), "c")
    assert got.duplicate_rows == 50 and set(asked) == {"c"}


def test_index_equals_plain_marking(spark, workdir, monkeypatch):
    """Small filters (many false hits), several buckets, nulls in keys, other
    clients, rolled back batches and batches imported without an index."""
    monkeypatch.setattr(keyindex, "KEY_BITS", 1)
    monkeypatch.setattr(keyindex, "BUCKET_KEYS", 40)
    store = new_store(spark, workdir)
    line = lambda i, d: f"{d},V{i},{i % 7},Cash,{'x' if i % 5 else ''},{i % 3}\n"
    days = ["2024-01-02", "2024-02-03", "no date"]
    body = lambda a, b: HEAD + "".join(line(i % 200, days[i % 3]) for i in range(a, b))
    load(spark, workdir, store, body(0, 150), "plain", duplicate_mode=None)
    load(spark, workdir, store, body(100, 220), "marked")
    load(spark, workdir, store, body(300, 400), "other", client="Client B")
    load(spark, workdir, store, body(380, 420), "gone")
    store.rollback_batch("gone")
    load(spark, workdir, store, body(120, 420), "new")
    new = store.open_ledger(with_duplicate_flag=True).filter("import_batch_id = 'new'")
    history = store.open_ledger(client_name="Client A").filter("import_batch_id != 'new'")
    plain = store.batch_rows("new").filter("row_status = 'valid'").drop("is_duplicate")
    want = duplicates.mark_duplicates(plain, history)
    count = lambda df: {tuple(r) for r in df.groupBy("voucher_id", "posting_date", "is_duplicate").count().collect()}
    assert count(new) == count(want) and 0 < want.filter("is_duplicate").count() < want.count()


def test_a_bucket_is_one_file_whatever_the_number_of_tasks(spark, workdir, monkeypatch):
    """Bitmaps and buckets are made where their keys meet: neither their files
    nor the bitmaps in a shuffle grow with tasks times blocks."""
    monkeypatch.setattr(keyindex, "BUCKET_KEYS", 500)
    monkeypatch.setattr(keyindex, "KEY_BITS", 200)  # 32 blocks
    store = new_store(spark, workdir)
    n = F.col("id")
    keys = spark.range(4000).repartition(16).select(
        F.lit("a").alias("client_key"), F.lit("a").alias("client_name"), F.lit(2024).alias("fiscal_year"),
        F.lit("x").alias("import_batch_id"), F.lit("b_x").alias("batch_key"), F.lit(None).cast("date").alias("posting_date"),
        F.xxhash64(n).alias("h1"), F.xxhash64(n, n).alias("h2"),
    )
    asked = []
    monkeypatch.setattr(keyindex.F, "bitmap_construct_agg", lambda c, f=F.bitmap_construct_agg: asked.append(1) or f(c))
    KeyIndex(store).add(keys)
    assert len(asked) == keyindex.PROBES
    files = [d for d, _, names in os.walk(store.path(keyindex.KEYS)) for x in names if x.endswith(".parquet")]
    assert len(files) == len(set(files)) == 8
    filters = store.read_parts(keyindex.FILTERS, keyindex.FILTER_SCHEMA)
    assert filters.count() == filters.select("block").distinct().count() == 32
    index = store.read_parts(keyindex.KEYS, keyindex.KEY_SCHEMA)
    assert index.count() == index.distinct().count() == 4000
    held = index.join(filters.select("blocks", "block", "bits"), F.pmod("h1", "blocks") == F.col("block"))
    assert held.filter(keyindex._may_hold("bits")).count() == 4000


def test_skipped_rows_are_not_indexed_as_the_batch_s_own(spark, workdir):
    store = new_store(spark, workdir)
    load(spark, workdir, store, rows(3), "a")
    got = load(spark, workdir, store, rows(5), "b", duplicate_mode="skip")
    assert (got.duplicate_rows, got.success_rows) == (3, 2)
    store.rollback_batch("a")
    assert load(spark, workdir, store, rows(5), "c", duplicate_mode="mark").duplicate_rows == 2


def test_hot_key_is_marked_by_place(spark):
    df = spark.range(20_000).select(
        F.lit("f").alias("source_file"), F.col("id").alias("source_row"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
    )
    out = duplicates.mark_duplicates(df, keys=["k"])
    assert out.filter("is_duplicate").count() == 6666
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


# -- summary states ---------------------------------------------------------------


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_summaries_from_states(spark, workdir, monkeypatch):
    store = new_store(spark, workdir)
    body = rows(20) + "2024-02-05,V1,1001,Cash,x,7\nbad,V2,2,Bank,x,-2\n2024-02-05,,2,Bank,x,-2\n"
    load(spark, workdir, store, body, "a")
    load(spark, workdir, store, rows(5, "W", "2024-05-06"), "b")
    load(spark, workdir, store, rows(2, "V", "2024-05-06"), "next", year=2025)

    def equal():
        ledger = store.open_ledger()
        s = LedgerSummaries(store)
        same(s.account_summary(), summaries.account_summary(ledger))
        same(s.monthly_summary(), summaries.monthly_summary(ledger))
        same(s.voucher_imbalance(), summaries.voucher_imbalance(ledger))
        same(s.balance_report(), quality.balance_report(ledger))
        same(s.dataset_summary().drop("fiscal_year"), summaries.dataset_summary(ledger).drop("fiscal_year"))
        for df in (s.account_summary(), s.voucher_imbalance()):
            assert not any("/rows/" in f for f in df.inputFiles())

    equal()
    store.rollback_batch("b")
    equal()
    load(spark, workdir, store, rows(3, "Z"), "c", import_mode="new")
    equal()
    store.rollback_batch("c")
    store.rollback_batch("next")
    equal()
    one = LedgerSummaries(store, client_name="Nobody")
    assert one.account_summary().count() == 0


def test_place_bits_mark_as_the_join_does(spark, workdir):
    """Rows meet the first places as bitmaps and are not shuffled themselves."""
    rows = [(f, i * 11_111, f"k{i % 13}" if i % 5 else None, "x" * 50) for f in ("a", "b", None) for i in range(60)]
    df = spark.createDataFrame(rows, "source_file string, source_row long, k string, wide string").repartition(4)
    where = F.col("source_row") % 3 != 0
    part = df.filter(where).select("source_file", "source_row", *duplicates.key_hashes(["k"]))
    fresh = duplicates.first_rows(part)
    with Scratch(spark) as scratch:
        bits = duplicates.place_bits(fresh, scratch.write)
        out = duplicates.mark(df, part, fresh, where, bits)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        want = duplicates.mark(df, part, fresh, where)
        assert out.columns == want.columns
        assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
        all_rows = duplicates.mark(df, df.select(*part.columns[:2]), fresh, None, bits).filter("NOT is_duplicate")
        assert all_rows.count() == 14


def test_place_bits_of_far_or_missing_numbers_are_not_made(spark, workdir, monkeypatch):
    monkeypatch.setattr(duplicates, "MOST_BLOCKS", 5)
    df = spark.range(10).select((F.col("id") * (1 << 40)).alias("source_row"), F.col("id").alias("k"))
    first = lambda d: duplicates.first_rows(d.select("source_row", *duplicates.key_hashes(["k"])))
    with Scratch(spark) as scratch:
        assert duplicates.place_bits(first(df), scratch.write) is None
        none = df.limit(2).withColumn("source_row", F.lit(None).cast("long"))
        assert duplicates.place_bits(first(none), scratch.write) is None
        near = df.withColumn("source_row", F.col("k") - 5)
        assert duplicates.place_bits(first(near), scratch.write).count() == 2
