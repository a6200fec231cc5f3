"""Clustered files: statistics keep every row of a filter and skip files."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import new_store
from ledgerspark.operators.filters import LedgerFilter, filter_ledger
from ledgerspark.plans import filestats
from ledgerspark.plans.filestats import PrunedLedger, literal_runs
from ledgerspark.plans.importer import import_batch
from ledgerspark.schema import BatchInfo, DirectAmount, Profile

PROFILE = Profile(
    "p", {c: c for c in ("posting_date", "voucher_id", "ac_code", "ac_caption", "description")}, DirectAmount("amount")
)
N = 6000


def journal(spark, shift=0):
    n = F.col("id") + shift
    words = F.array(*[F.lit(w) for w in ("red gizmo", "blue gear", "Büro Köln", "x_y%z", "", "日本語の帳簿")])
    return spark.range(N).select(
        (F.col("id") + 1).alias("source_row"),
        F.when(n % 97 == 0, "no date").otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (n * 7919 % 366).cast("int")).cast("string")).alias("posting_date"),
        F.concat(F.lit("V"), n.cast("string")).alias("voucher_id"),
        (1000 + n * 31 % 40).cast("string").alias("ac_code"),
        F.concat(F.lit("Account "), (n % 11).cast("string")).alias("ac_caption"),
        F.concat(F.element_at(words, (n % 6 + 1).cast("int")), F.lit(" no "), (n % 50).cast("string")).alias("description"),
        (n * 37 % 10000 - 3000).cast("string").alias("amount"),
    )


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    store = new_store(spark, str(tmp_path_factory.mktemp("files")))
    info = lambda b: BatchInfo("Client A", 2024, b, "f.csv")
    import_batch(journal(spark), PROFILE, info("a"), store, duplicate_mode=None, cluster_files=48)
    import_batch(journal(spark, N).limit(500), PROFILE, info("plain"), store, duplicate_mode=None)
    import_batch(journal(spark, 2 * N).limit(500), PROFILE, info("gone"), store, duplicate_mode=None, cluster_files=4)
    store.rollback_batch("gone")
    return store


FILTERS = [
    LedgerFilter(),
    LedgerFilter(date_from="2024-03-01", date_to="2024-03-31"),
    LedgerFilter(min_amount="6900", date_from="2024-11-01"),
    LedgerFilter(summary="red gizmo", date_to="2024-02-01"),
    LedgerFilter(summary="Büro Köln no 4"),
    LedgerFilter(summary="no such text"),
    LedgerFilter(summary="x_y%z"),
    LedgerFilter(ac_name="Account 1_", summary="日本語"),
    LedgerFilter(ac_name="t 1", min_amount="100"),
    LedgerFilter(date_from="2030-01-01"),
]


@pytest.mark.parametrize("i", range(len(FILTERS)))
def test_same_rows(store, i):
    want = filter_ledger(store.open_ledger(), FILTERS[i], limit=None)
    got = filter_ledger(PrunedLedger(store, FILTERS[i]).rows, FILTERS[i], limit=None)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_files_read(store):
    month = PrunedLedger(store, LedgerFilter(date_from="2024-03-01", date_to="2024-03-31"), account="1007")
    every = store.open_ledger().filter("posting_date BETWEEN '2024-03-01' AND '2024-03-31' AND ac_code = '1007'")
    assert sorted(r["voucher_id"] for r in month.rows.filter("posting_date BETWEEN '2024-03-01' AND '2024-03-31'").collect()) == sorted(
        r["voucher_id"] for r in every.collect()
    )
    assert month.all_files >= 24 and month.files <= month.all_files / 3
    assert PrunedLedger(store, LedgerFilter(summary="no such text")).files == 0
    assert PrunedLedger(store, LedgerFilter(summary="no")).files == month.all_files  # too short to tell
    print("files", month.files, "of", month.all_files)


def test_runs_of_a_needle():
    assert literal_runs("ab_cdef%g") == ["cdef"] and literal_runs("a%b") == [] and literal_runs("gizmo") == ["gizmo"]


def test_nothing_active(spark, workdir):
    assert PrunedLedger(new_store(spark, workdir), LedgerFilter()).rows.count() == 0


def test_files_grow_in_number_not_in_rows(spark, monkeypatch):
    rows = spark.range(1000).select(
        F.col("id").alias("source_row"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("posting_date"),
        (F.col("id") % 7).cast("string").alias("ac_code"), F.col("id").cast("decimal(18,2)").alias("rc_amount"),
    )
    assert filestats.clustered(rows, 2).rdd.getNumPartitions() == 2
    monkeypatch.setattr(filestats, "FILE_ROWS", 100)
    parts = [len(p) for p in filestats.clustered(rows, 2).rdd.glom().collect()]
    assert sum(parts) == 1000 and len(parts) == 10 and max(parts) < 300


def test_files_under_a_folder_with_spaces_are_found(spark, tmp_path):
    store = new_store(spark, str(tmp_path / "my ledgers"))
    import_batch(journal(spark), PROFILE, BatchInfo("Client A", 2024, "a", "f.csv"), store, duplicate_mode=None, cluster_files=4)
    assert PrunedLedger(store, LedgerFilter()).rows.count() == store.open_ledger().count() > 0
