"""As-of join: each row with the latest row of a rate or price table, of the
same key, at or before its time.

Only the distinct (key, time) points of the left side are looked up; rows that
share one share the answer.  Points and rates are cut into time buckets, so a
key with most of the rows is spread over as many tasks as it has buckets.
Within a bucket the last rate is carried forward by a window; what a bucket
starts with is the last rate of the buckets before it, from a table with one
row by key and bucket.

A left row without key or time, or before its key's first rate, has no rate
(left join).  Rates without key or time are ignored; of rates with the same key
and time the one with the greatest values counts.  Columns of the right side
that the left side has too are not added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str | None = None, bucket: str = "month"
) -> DataFrame:
    """``left`` with the columns of the matching row of ``right``.

    bucket: a unit of date_trunc; the finer, the more tasks share a key."""
    right_time = right_time or time
    value = [c for c in right.columns if c not in keys and c not in left.columns]
    taken = lambda t: F.date_trunc(bucket, t).alias("_b")
    held = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])

    at = F.col(time)
    points = left.filter(held & at.isNotNull()).select(*keys, at.alias("_t")).distinct()
    points = points.select(*keys, "_t", taken("_t"), F.lit(1).alias("_side"))
    rate = F.struct(*[F.col(c) for c in value])
    rates = right.filter(held & F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("_t"), rate.alias("_v"))
    rates = rates.groupBy(*keys, "_t").agg(F.max("_v").alias("_v")).select("*", taken("_t"), F.lit(0).alias("_side"))

    # the rate that each bucket starts with
    ends = rates.groupBy(*keys, "_b").agg(F.max(F.struct("_t", "_v")).alias("_e"))
    buckets = points.select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "full")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(*keys, "_b", F.last("_e._v", ignorenulls=True).over(before).alias("_start"))

    both = points.withColumn("_v", F.lit(None).cast(rates.schema["_v"].dataType)).unionByName(rates)
    so_far = Window.partitionBy(*keys, "_b").orderBy("_t", "_side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    carried = both.withColumn("_v", F.last("_v", ignorenulls=True).over(so_far)).filter("_side = 1")
    answer = carried.join(starts, [*keys, "_b"], "left").select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], "_t", F.coalesce("_v", "_start").alias("_v")
    )
    same: list[Column] = [left[k] == answer[f"_k_{k}"] for k in keys] + [left[time] == answer["_t"]]
    out = left.join(answer, reduce(lambda a, b: a & b, same), "left")
    return out.select(*[left[c] for c in left.columns], *[F.col(f"_v.{c}").alias(c) for c in value])
