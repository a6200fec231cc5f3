"""Persisted index of the duplicate keys of a store's batches.

  key_batches/  one row by batch and client: number of keys, filter blocks,
                index buckets, range of posting dates
  key_filters/  a Bloom filter by batch, in blocks of 32,768 bits (built by
                bitmap_construct_agg)
  key_index/    the keys' two hashes, in folders client_key / fiscal_year /
                batch_key / bucket

An import asks which of its keys active batches of its clients have.  Batches
outside its range of dates drop out by ``key_batches``; the filters of the rest
are merged (bitmap_or_agg) and most keys, being new, fail that; the few that
may be known are tried on each batch's filter, and only the buckets that may
hold one are read.  No stored ledger row is read, whatever the history holds.

A key sets ``PROBES`` bits in the one block that its first hash names.  Numbers
of blocks are powers of two, so the filters of one size merge, and an import
tests each size in use.

Batches that were imported without looking for duplicates are indexed when the
first import that does asks for their client.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import client_key, strip_unicode
from ..operators.duplicates import DUPLICATE_KEY, HASH, first_rows, key_hashes
from ..session import Scratch, free_shuffles
from .statuslog import KEY_COLUMNS
from .store import ROW_VALID, LedgerStore, batch_key

BATCHES, FILTERS, KEYS = "key_batches", "key_filters", "key_index"
BLOCK_BITS = 32_768  # of Spark's bitmap functions
KEY_BITS = 12  # bits of a filter by key
PROBES = 4
BUCKET_KEYS = 1 << 20  # keys in a bucket, about
MOST_BUCKETS = 256

BATCH_SCHEMA = T.StructType(
    [
        T.StructField("client_name", T.StringType()),
        T.StructField("fiscal_year", T.IntegerType()),
        T.StructField("import_batch_id", T.StringType()),
        T.StructField("client_key", T.StringType()),
        T.StructField("batch_key", T.StringType()),
        T.StructField("keys", T.LongType()),
        T.StructField("blocks", T.LongType()),
        T.StructField("buckets", T.LongType()),
        T.StructField("date_min", T.DateType()),
        T.StructField("date_max", T.DateType()),
        T.StructField("undated", T.BooleanType()),
    ]
)
_FOLDER = [
    T.StructField("client_key", T.StringType()),
    T.StructField("fiscal_year", T.IntegerType()),
    T.StructField("batch_key", T.StringType()),
]
FILTER_SCHEMA = T.StructType(
    [T.StructField("blocks", T.LongType()), T.StructField("block", T.LongType()), T.StructField("bits", T.BinaryType())]
    + _FOLDER
)
KEY_SCHEMA = T.StructType(
    [T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), *_FOLDER, T.StructField("bucket", T.LongType())]
)
WHERE = ["client_key", "fiscal_year", "batch_key"]


def client_hashes() -> list[Column]:
    """The duplicate key of a ledger row: its client's rows are compared."""
    return key_hashes([*DUPLICATE_KEY, strip_unicode("client_name")])


def _power_of_two(x: Column) -> Column:
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(x, F.lit(1))))).cast("long")


def _bit(i: int) -> Column:
    """The i-th bit that a key sets in its block."""
    return F.shiftrightunsigned("h2", 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("long")


def _may_hold(bits: str) -> Column:
    """Whether all of a key's bits are set in the block."""
    out = F.lit(True)
    for i in range(PROBES):
        byte = F.conv(F.hex(F.substring(F.col(bits), (_bit(i) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        out = out & (byte.bitwiseAND(F.pow(F.lit(2), _bit(i) % 8).cast("int")) != 0)
    return out


class KeyIndex:
    def __init__(self, store: LedgerStore):
        self.store, self.spark = store, store.spark

    # -- writing -------------------------------------------------------------
    def add(self, keys: DataFrame) -> None:
        """Indexes the keys of rows: KEY_COLUMNS, batch_key, posting_date, h1,
        h2.  ``key_batches`` comes last: a batch is in the index when all of it
        is."""
        with Scratch(self.spark) as scratch:
            distinct = keys.dropDuplicates([*KEY_COLUMNS, "batch_key", *HASH])
            distinct = scratch.write(distinct, "key-distinct")
            scratch.drop()
            self._add(distinct)

    def _add(self, keys: DataFrame) -> None:
        per = keys.groupBy(*KEY_COLUMNS, "batch_key").agg(
            F.count(F.lit(1)).alias("keys"),
            F.min("posting_date").alias("date_min"),
            F.max("posting_date").alias("date_max"),
            F.bool_or(F.col("posting_date").isNull()).alias("undated"),
        )
        whole = F.sum("keys").over(Window.partitionBy(*WHERE))  # clients may share a folder
        per = per.withColumn("blocks", _power_of_two(whole * KEY_BITS / BLOCK_BITS)).withColumn(
            "buckets", F.least(F.lit(MOST_BUCKETS), _power_of_two(whole / BUCKET_KEYS)).cast("long")
        )
        sizes = per.select(*WHERE, "blocks", "buckets").distinct()
        at = keys.select(*WHERE, *HASH).join(sizes, WHERE)
        # keys are dealt out by block, so no task makes bitmaps of another's blocks
        whose = [*WHERE, "blocks", "block"]
        dealt = at.select(*WHERE, "blocks", F.pmod("h1", "blocks").alias("block"), *HASH).repartition(*whose)
        probes = dealt.groupBy(*whose).agg(
            F.array(*[F.bitmap_construct_agg(_bit(i)) for i in range(PROBES)]).alias("probes")
        )
        probes = probes.select(*whose, F.explode("probes").alias("bits"))
        filters = probes.groupBy(*whose).agg(F.bitmap_or_agg("bits").alias("bits"))
        load = f"load={uuid.uuid4().hex}"  # writers share no folder
        filters.select("blocks", "block", "bits", *WHERE).write.partitionBy(*WHERE).parquet(
            self.store.path(f"{FILTERS}/{load}")
        )
        free_shuffles(self.spark)
        # a bucket's keys meet in one task and make one file
        index = at.select(*HASH, *WHERE, F.pmod("h1", "buckets").alias("bucket")).repartition(*WHERE, "bucket")
        index.write.partitionBy(*WHERE, "bucket").parquet(self.store.path(f"{KEYS}/{load}"))
        per.select(*BATCH_SCHEMA.names).write.parquet(self.store.path(f"{BATCHES}/{load}"))

    def catch_up(self, clients: DataFrame) -> int:
        """Indexes the active batches of these clients (client_key) that are
        not in the index yet, from their stored rows; returns how many."""
        active = self.store.active_keys().join(clients, "client_key", "left_semi")
        done = self.store.read_parts(BATCHES, BATCH_SCHEMA)
        same = [active[c].eqNullSafe(done[c]) for c in KEY_COLUMNS]
        missing = active.join(done, same, "left_anti")
        n = missing.count()
        rows = self.store._rows() if n else None
        if rows is not None:
            missing = missing.withColumn("batch_key", batch_key(F.col("import_batch_id")))
            on = [rows["batch_key"] == missing["batch_key"]] + [rows[c].eqNullSafe(missing[c]) for c in KEY_COLUMNS]
            rows = rows.filter(F.col("row_status") == ROW_VALID).join(missing, on, "left_semi")
            self.add(rows.select(*KEY_COLUMNS, "batch_key", "posting_date", *client_hashes()))
        return n

    # -- asking --------------------------------------------------------------
    def seen(self, firsts: DataFrame, materialize) -> DataFrame:
        """h1, h2 of the keys that an active batch of the key's client has.
        firsts: client_key, posting_date, h1, h2, by key; written already, it
        is read several times.  ``materialize`` writes the few candidates."""
        none = self.spark.createDataFrame([], "h1 long, h2 long")
        span = firsts.agg(
            F.min("posting_date").alias("lo"), F.max("posting_date").alias("hi"),
            F.coalesce(F.bool_or(F.col("posting_date").isNull()), F.lit(False)).alias("undated"),
        ).first()
        clients = firsts.select("client_key").distinct()
        self.catch_up(clients)
        batches = self.store.read_parts(BATCHES, BATCH_SCHEMA)
        near = F.lit(bool(span["undated"])) & F.col("undated")
        if span["lo"] is not None:
            near = near | (F.col("date_min") <= F.lit(span["hi"])) & (F.col("date_max") >= F.lit(span["lo"]))
        live = self.store.active_only(batches.filter(near)).join(clients, "client_key", "left_semi")
        live = materialize(live.select(*WHERE, "blocks", "buckets").distinct(), "key-live")
        if live.isEmpty():
            return none
        filters = self.store.read_parts(FILTERS, FILTER_SCHEMA).join(live.select(*WHERE), WHERE, "left_semi")
        merged = filters.groupBy("client_key", "blocks", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
        sizes = live.select("client_key", "blocks").distinct()
        block = F.pmod("h1", "blocks").alias("block")
        asked = firsts.select("client_key", *HASH).join(sizes, "client_key").select("*", block)
        maybe = asked.join(merged, ["client_key", "blocks", "block"]).filter(_may_hold("bits"))
        maybe = materialize(maybe.select("client_key", *HASH, "blocks", "block"), "key-maybe")
        if maybe.isEmpty():
            return none
        tried = maybe.join(filters, ["client_key", "blocks", "block"]).filter(_may_hold("bits"))
        tried = tried.join(live.select(*WHERE, "buckets"), WHERE)
        tried = materialize(tried.select(*WHERE, F.pmod("h1", "buckets").alias("bucket"), *HASH), "key-tried")
        if tried.isEmpty():
            return none
        folders = tried.select(*WHERE, "bucket").distinct()
        index = self.store.read_parts(KEYS, KEY_SCHEMA).join(folders, [*WHERE, "bucket"], "left_semi")
        return index.join(tried.select(*HASH).distinct(), HASH, "left_semi").select(*HASH).distinct()


def import_keys(flagged: DataFrame, where: Column, place: list[str]) -> DataFrame:
    """Place, batch key, date and hashes of the rows that take part."""
    return flagged.filter(where).select(
        *place, client_key("client_name").alias("client_key"), "client_name", "fiscal_year", "import_batch_id",
        batch_key(F.col("import_batch_id")).alias("batch_key"), "posting_date", *client_hashes(),
    )


def import_firsts(rows: DataFrame) -> DataFrame:
    """The first row of each key; equal keys have one client and one date."""
    return first_rows(rows, *[F.min(c).alias(c) for c in ("client_key", "posting_date")])
