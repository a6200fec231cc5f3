"""Recent-first logs (one entry per key) and the dataset overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PERIOD_MISSING, PERIOD_SEPARATOR, STATUS_ACTIVE, STATUS_MISSING, STATUS_QUERYABLE


def latest_per_key(
    df: DataFrame,
    keys: list[str | Column],
    ts: str,
    n: int | None = None,
    tiebreak: list[str] | None = None,
) -> DataFrame:
    """Newest row per key (by ``ts``, then ``tiebreak`` descending), newest
    keys first, at most ``n``.

    A max over a struct is a partial aggregation, so a key holding a large
    share of the rows only sends one partial row per task through the shuffle
    (a row_number window would sort the whole hot key in one task).
    """
    tiebreak = tiebreak or []
    key_cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    key_names = [f"_k{i}" for i in range(len(key_cols))]
    order_fields = [ts, *tiebreak]
    rest = [c for c in df.columns if c not in order_fields]
    packed = F.struct(*[F.col(f"`{c}`") for c in order_fields + rest]).alias("_latest")
    g = df.groupBy(*[c.alias(nm) for c, nm in zip(key_cols, key_names)]).agg(F.max(packed).alias("_latest"))
    out = g.select(*[F.col(f"_latest.`{c}`").alias(c) for c in df.columns])
    if n is not None:
        out = out.orderBy(F.col(ts).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in tiebreak]).limit(n)
    return out


def dataset_overview(log: DataFrame, datasets: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Recent datasets (``log``: dataset_name, last_opened_at), one row each,
    with the latest dataset row of the name. A name without a dataset row, or
    (given the current batch ``status``) none of whose batches is active any
    more, has the missing status; without a dataset row its fields are empty."""
    if status is not None:
        active = status.filter(F.col("status") == STATUS_ACTIVE).select("import_batch_id").distinct()
        datasets = datasets.join(active.withColumn("live", F.lit(True)), "import_batch_id", "left")
    else:
        datasets = datasets.withColumn("live", F.lit(True))
    datasets = datasets.withColumn("live", F.coalesce("live", F.lit(False)))
    fields = ["client_name", "fiscal_year", "row_count", "posting_date_min", "posting_date_max"]
    # live batches first, then the latest
    order = [c for c in ("created_at", "import_batch_id") if c in datasets.columns]
    d = datasets.groupBy("dataset_name").agg(F.max(F.struct("live", *order, *fields)).alias("d"))
    d = d.select("dataset_name", "d.live", *[f"d.{f}" for f in fields])
    j = log.join(d, "dataset_name", "left")
    period = F.concat(
        F.coalesce(F.col("posting_date_min").cast("string"), F.lit(PERIOD_MISSING)),
        F.lit(PERIOD_SEPARATOR),
        F.coalesce(F.col("posting_date_max").cast("string"), F.lit(PERIOD_MISSING)),
    )
    dated = F.col("posting_date_min").isNotNull() | F.col("posting_date_max").isNotNull()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return j.select(
        "dataset_name",
        text("client_name"),
        text("fiscal_year"),
        text("row_count"),
        F.when(dated, period).otherwise(F.lit("")).alias("period"),
        F.col("last_opened_at").cast("string").alias("last_opened_at"),
        F.when(F.col("live"), F.lit(STATUS_QUERYABLE)).otherwise(F.lit(STATUS_MISSING)).alias("status"),
    )
