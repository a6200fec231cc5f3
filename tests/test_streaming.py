import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from conftest import new_store, write_csv
from ledgerspark.schema import DirectAmount, Profile
from ledgerspark.streaming import stream_import

COLS = ["posting_date", "voucher_id", "ac_code", "ac_caption", "description", "amount"]
PROFILE = Profile(
    "direct",
    {"posting_date": "posting_date", "voucher_id": "voucher_id", "ac_code": "ac_code", "ac_caption": "ac_caption", "description": "description"},
    DirectAmount("amount"),
)


def test_stream_import_publishes_each_drop(spark, workdir):
    folder = os.path.join(workdir, "drops")
    os.makedirs(folder)
    store = new_store(spark, workdir)
    ckpt = os.path.join(workdir, "ckpt")
    write_csv(folder, "a.csv", ",".join(COLS) + "\n2024-01-02,V1,1001,Cash,x,10\n2024-01-03,,1001,Cash,y,5\n")
    q = stream_import(spark, folder, COLS, PROFILE, "Client S", 2024, store, checkpoint=ckpt)
    q.awaitTermination(120)
    assert store.open_ledger().count() == 1
    assert store.open_errors().first()["source_row"] == 2
    write_csv(folder, "b.csv", ",".join(COLS) + "\n2024-02-02,V2,1001,Cash,z,7\n")
    q = stream_import(spark, folder, COLS, PROFILE, "Client S", 2024, store, checkpoint=ckpt)
    q.awaitTermination(120)
    led = store.open_ledger()
    assert led.count() == 2
    assert sorted(r[0] for r in led.select("source_file").collect()) == ["a.csv", "b.csv"]
    assert led.select(F.countDistinct("import_batch_id")).first()[0] == 2


def test_two_streams_into_one_store(spark, workdir):
    store = new_store(spark, workdir)
    for name, client, rows in (("one", "Client A", 1), ("two", "Client B", 2)):
        folder = os.path.join(workdir, name)
        os.makedirs(folder)
        text = "".join(f"2024-01-0{i + 1},V{i},1001,Cash,x,10\n" for i in range(rows))
        write_csv(folder, "a.csv", ",".join(COLS) + "\n" + text)
        q = stream_import(spark, folder, COLS, PROFILE, client, 2024, store, checkpoint=os.path.join(workdir, "c" + name))
        q.awaitTermination(120)
        assert q.exception() is None
    assert store.open_ledger().count() == 3
    assert store.open_ledger(client_name="Client B").count() == 2


def test_stream_refuses_another_column_order(spark, workdir):
    folder = os.path.join(workdir, "drops3")
    os.makedirs(folder)
    store = new_store(spark, workdir)
    write_csv(folder, "a.csv", ",".join(reversed(COLS)) + "\n10,x,Cash,1001,V1,2024-01-02\n")
    q = stream_import(spark, folder, COLS, PROFILE, "Client S", 2024, store, checkpoint=os.path.join(workdir, "c3"))
    with pytest.raises(StreamingQueryException):
        q.awaitTermination(120)
    assert store.open_ledger().count() == 0


def test_replayed_epoch_is_not_published_twice(spark, workdir):
    folder = os.path.join(workdir, "drops2")
    os.makedirs(folder)
    store = new_store(spark, workdir)
    write_csv(folder, "a.csv", ",".join(COLS) + "\n2024-01-02,V1,1001,Cash,x,10\n")
    q = stream_import(spark, folder, COLS, PROFILE, "Client S", 2024, store, checkpoint=os.path.join(workdir, "c1"))
    q.awaitTermination(120)
    # a lost checkpoint is another stream: its rows are known duplicates
    q = stream_import(
        spark, folder, COLS, PROFILE, "Client S", 2024, store, checkpoint=os.path.join(workdir, "c2"), duplicate_mode="skip"
    )
    q.awaitTermination(120)
    assert store.open_ledger().count() == 1
