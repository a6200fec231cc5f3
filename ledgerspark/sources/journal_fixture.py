"""Raw journal derived from the generated tables (lineitem join part).

Every column is text, as a journal export arrives; defects are injected by
key arithmetic so that any engine sees the same ones. ``source_row`` is the
row's position in (l_orderkey, l_linenumber, l_partkey, l_suppkey) order,
computed with the distributed row index (no single-task window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rowindex import first_rows, with_row_index
from ..schema import DirectAmount, FlaggedAmount, Profile, TwoColumnAmount

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


_READS: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A generated (read-only) table; the read DataFrame is reused within a
    session so its file listing and footer are taken once."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    df = _READS.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _READS[key] = df
    return df


def changed_at(spark: SparkSession, sf_dir: str, name: str) -> int:
    """When a table's path was last modified, as its file system tells."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-repartition a scan that yields fewer partitions than the cluster
    has cores (e.g. one large row group); a large input already has many
    splits and is left alone, so this never adds a shuffle at scale."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, key)
    return df


def raw_journal(spark: SparkSession, sf_dir: str, source_row: bool = True, head: int | None = None) -> DataFrame:
    """The whole journal, or its first ``head`` rows."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        "l_returnflag", "l_linestatus", "l_shipdate",
    )
    li = spread(li, "l_orderkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    j = li.join(part, li.l_partkey == part.p_partkey, "inner")
    if head is not None:
        j = first_rows(j, ORDER, head, name="source_row")
    elif source_row:  # sorted before the text columns are made, which are wider
        j = with_row_index(j.drop("p_partkey"), ORDER, name="source_row")
    number = ["source_row"] if source_row or head is not None else []
    c = F.col
    amount_text = c("l_extendedprice").cast("decimal(18,2)").cast("string")
    out = j.select(
        F.when(c("l_orderkey") % 89 == 0, F.lit("bad-date"))
        .otherwise(F.substring(c("l_shipdate").cast("date").cast("string"), 1, 10))
        .alias("src_date"),
        F.when(c("l_orderkey") % 97 == 0, F.lit("  ")).otherwise(c("l_orderkey").cast("string")).alias("src_voucher"),
        F.when(c("l_partkey") % 101 == 0, F.lit(""))
        .otherwise((F.lit(1000) + c("l_suppkey") % 50).cast("string"))
        .alias("src_account"),
        F.when(c("l_partkey") % 103 == 0, F.lit(None).cast("string")).otherwise(c("p_type")).alias("src_account_name"),
        F.when(c("l_linenumber") == 7, F.lit("")).otherwise(c("p_name")).alias("src_text"),
        F.when(c("l_orderkey") % 83 == 0, F.lit("n/a")).otherwise(amount_text).alias("src_amount"),
        F.when(c("l_returnflag") == "A", F.lit("S"))
        .when(c("l_returnflag") == "R", F.lit("H"))
        .when(c("l_linestatus") == "O", F.lit("借"))
        .otherwise(F.lit("?"))
        .alias("src_drcr"),
        F.concat(F.lit("client-"), (c("l_suppkey") % 4).cast("string")).alias("src_client"),
        F.year(c("l_shipdate")).alias("src_year"),
        *number,
    )
    return out.select(
        *[n for n in out.columns if n not in number],
        F.when(c("src_drcr") == "H", F.concat(F.lit("-"), c("src_amount"))).otherwise(c("src_amount")).alias("src_signed"),
        F.when(c("src_drcr").isin("S", "借"), c("src_amount")).alias("src_debit"),
        F.when(c("src_drcr") == "H", c("src_amount")).alias("src_credit"),
        *number,
    )


_BASE = dict(
    posting_date="src_date",
    voucher_id="src_voucher",
    ac_code="src_account",
    ac_caption="src_account_name",
    description="src_text",
)


def flag_profile(prefix: str | None = "v_") -> Profile:
    return Profile(
        name="fixture-flag",
        mapping={**_BASE, "drcr": "src_drcr"},
        amount=FlaggedAmount("src_amount", "src_drcr"),
        prefixes={"voucher_id": prefix} if prefix else {},
        source_type="table",
    )


def direct_profile() -> Profile:
    return Profile(
        name="fixture-direct",
        mapping=_BASE,
        amount=DirectAmount("src_signed"),
        source_type="table",
    )


def debit_credit_profile() -> Profile:
    return Profile(
        name="fixture-debit-credit",
        mapping=_BASE,
        amount=TwoColumnAmount("src_debit", "src_credit"),
        prefixes={"ac_code": "ac_", "description": "d_"},
        source_type="table",
    )
