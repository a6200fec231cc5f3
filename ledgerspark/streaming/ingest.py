"""Continuous import of journal files dropped into a folder.

``readStream`` over the folder (CSV, every column text) -> ``foreachBatch``
runs the ordinary import job on each micro-batch, which becomes one batch
of the store. The stream checkpoint (in the shared checkpoint folder)
records which files were consumed.

A replayed micro-batch (after a failure) must not publish twice: each
attempt writes under its own batch id ``stream-<stream>-<epoch>-<attempt>``
and is skipped when an attempt of the same stream and epoch is already
active; a failed attempt never became active, so its files stay invisible.
``<stream>`` is the query id that Spark keeps in the checkpoint, so streams
over other folders, for other clients or with a new checkpoint never meet.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.importer import import_batch
from ..plans.store import LedgerStore
from ..schema import STATUS_ACTIVE, BatchInfo, Profile
from ..session import scratch_path
from ..sources.csv import MALFORMED, text_columns, text_options


def _epoch_active(store: LedgerStore, prefix: str) -> bool:
    s = store.batch_status()
    return s.filter(F.col("import_batch_id").startswith(prefix) & (F.col("status") == STATUS_ACTIVE)).limit(1).count() > 0


def stream_import(
    spark: SparkSession,
    folder: str,
    columns: list[str],
    profile: Profile,
    client_name: str,
    fiscal_year: int,
    store: LedgerStore,
    *,
    checkpoint: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    duplicate_mode: str | None = "mark",
) -> StreamingQuery:
    """Start the stream; ``columns`` is the CSV header (file sources need a
    schema up front)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, MALFORMED]])
    # a file whose header has other columns, or another order, stops the stream
    reader = text_options(spark.readStream.schema(schema)).option("enforceSchema", False)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.csv(folder)
    src = src.select(
        *text_columns(columns),
        F.col("_metadata.file_path").alias("_file_path"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )

    def run(batch_df: DataFrame, epoch: int) -> None:
        prefix = f"stream-{query.id}-{epoch:08d}-"
        if _epoch_active(store, prefix):
            return
        if batch_df.isEmpty():
            return
        df = _number(batch_df)
        import_batch(
            df,
            profile,
            BatchInfo(client_name, fiscal_year, prefix + uuid.uuid4().hex[:6], F.col("source_file")),
            store,
            source_type="csv",
            source_path=folder,
            duplicate_mode=duplicate_mode,
        )

    ckpt = checkpoint or scratch_path(spark, "stream-checkpoint")
    when = {"availableNow": True} if available_now else {"processingTime": "30 seconds"}
    started = threading.Event()

    def first_wait(batch_df: DataFrame, epoch: int) -> None:
        started.wait()  # the query's id is known once start() has returned
        run(batch_df, epoch)

    query = src.writeStream.foreachBatch(first_wait).option("checkpointLocation", ckpt).trigger(**when).start()
    started.set()
    return query


def _number(df: DataFrame) -> DataFrame:
    """File-order source row inside a micro-batch: the batch DataFrame holds
    whole files, the metadata columns were captured by the stream."""
    from pyspark.sql import Window

    tagged = df.withColumn("_rid", F.monotonically_increasing_id())
    splits = tagged.groupBy("_file_path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_rid").alias("_m0"))
    w = Window.partitionBy("_file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    out = tagged.join(offsets, ["_file_path", "_block"])
    out = out.withColumn("source_row", F.col("_off") + F.col("_rid") - F.col("_m0") + 1)
    return out.drop("_file_path", "_block", "_rid", "_m0", "_off", "_n")

