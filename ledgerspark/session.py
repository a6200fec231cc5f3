"""Session helpers: a configured local session for tests/bench and the shared
scratch folder taken from ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import os
import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Used only by a one-machine session that names no checkpoint folder.
LOCAL_FALLBACK_DIR = "/tmp/ledgerspark-checkpoints"
# Files that a task of a partitioned write keeps open; beyond them it sorts.
OPEN_FILES = 16
# Row groups of writes that hold that many files open.
OPEN_FILE_BYTES = 16 << 20
# Methods over so many bytes are interpreted (DontCompileHugeMethods).
JIT_BYTES = 8000
PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build_session(
    master: str | None = None, shuffle_partitions: int = 8, app: str = "ledgerspark", event_log_dir: str | None = None
) -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = SparkSession.builder
    if event_log_dir:  # stage / task times for offline inspection
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = (
        builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # no per-call Python call-site capture: each functions.* call would
        # otherwise cost several extra JVM round trips while plans are built
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a session whose tasks all run on this machine may leave it unset."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = LOCAL_FALLBACK_DIR
    return d.rstrip("/")


def reach_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.
    Where executors do not see that folder, ship it with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *paths])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Set the RDD checkpoint folder from the session setting if it is unset."""
    root = checkpoint_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster; the checkpoint folder is the cluster's shared storage)."""
    return f"{checkpoint_root(spark)}/ledgerspark/{name}-{uuid.uuid4().hex[:12]}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder that this library made."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes shuffle files once the driver has collected the plans of
    their jobs as garbage; a job with little to do on the driver may never."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def open_files(spark: SparkSession, most: int = OPEN_FILES):
    """Partitioned writes that start in here keep a file open for each of a
    task's partitions. Spark would sort the task's rows by partition before,
    which spills them all where a task has millions; rows of further partitions
    still are sorted."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def short_methods(spark: SparkSession, most: int = JIT_BYTES):
    """Jobs that start in here run a stage whose generated method the JVM would
    never compile, for its length, operator by operator."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Intermediate tables of one job: written to the shared scratch folder,
    read back (which cuts the lineage) and deleted at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        for path in self.paths:
            delete_path(self.spark, path)

    def drop(self, *frames: DataFrame) -> None:
        """Ends a step: deletes these tables, which nothing reads any more, and
        lets Spark delete the shuffle files of finished jobs."""
        for path in [p for f in frames for p in self.paths if any(f"{p}/" in x for x in f.inputFiles()[:1])]:
            delete_path(self.spark, path)
            self.paths.remove(path)
        free_shuffles(self.spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
