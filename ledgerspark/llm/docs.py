"""Helpers shared by the operators of this subpackage.

Documents reach Python as Arrow batches of (key columns, text bytes).  A batch
is worked off in slices of bounded size, so the memory of a task depends on
the longest single text and not on the number of rows.  Words are the maximal
runs of bytes outside [\\x20\\x09-\\x0D]; in UTF-8 these are the same words as
over code points.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, reach_package, scratch_path

SLICE_BYTES = (1 << 21) - 2  # with it, tables of powers fit 2^21 entries

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts the lineage with
    files that outlive a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Ends a step: deletes the folders of materialised frames that no later
    step reads, and lets Spark delete the shuffle files of finished jobs, which
    it does once the driver has collected their plans as garbage."""
    for frame in frames:
        files = frame.inputFiles()
        if files:
            delete_path(spark, files[0].rsplit("/", 1)[0])
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_bytes(docs: DataFrame, *keep: str) -> DataFrame:
    """The named columns and the text as UTF-8 bytes (null text: empty)."""
    return docs.select(*keep, F.coalesce(F.col("text").cast("binary"), F.lit(bytearray())).alias("text"))


def with_row_key(docs: DataFrame) -> DataFrame:
    """Adds k1, k2 (never null), equal only for rows with equal doc_id and
    text; results of equal rows are equal, so they may share a key."""
    return docs.withColumn("k1", F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long")).withColumn(
        "k2", F.xxhash64("doc_id", "text")
    )


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(begin, end) row ranges of at most ``limit`` bytes, one row at least."""
    return cuts([len(t) for t in texts], limit)


def cuts(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(begin, end) ranges whose sizes add up to ``limit`` at most."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n + 1
    if begin < len(sizes):
        yield begin, len(sizes)


def give_back() -> None:
    """Returns memory that earlier tasks of this worker have freed, and that it
    would hold, to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_slices(
    df: DataFrame,
    fn: Callable[[dict[str, pa.Array], list[bytes]], dict],
    schema: str,
    text: str = "text",
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Maps slices of documents: ``fn(columns, texts)`` gets the other columns
    as Arrow arrays and returns a dict of arrays or lists by output column."""
    out = _arrow_schema(df.sparkSession, schema)
    reach_package(df.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            rest = {n: batch.column(n) for n in batch.schema.names if n != text}
            for a, b in slices(texts, limit):
                got = fn({n: c.slice(a, b - a) for n, c in rest.items()}, texts[a:b])
                yield pa.RecordBatch.from_arrays([_array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def _array(x, kind: pa.DataType) -> pa.Array:
    if isinstance(x, pa.Array):
        return x if x.type == kind else x.cast(kind)
    return pa.array(x, type=kind)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_POWERS: dict[int, np.ndarray] = {}  # 16 MB a base in a worker


def _powers(n: int, base: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            have[done : 2 * done] = have[:done] * step
            done *= 2
        if size <= 1 << 21:  # those of a longer single text are not kept
            _POWERS[base] = have
    return have[:n]


@dataclass
class Words:
    """The words of a slice of documents, in order."""

    data: np.ndarray  # bytes of the slice, one blank after each text
    start: np.ndarray  # first byte of each word
    end: np.ndarray
    hash: np.ndarray  # 64-bit identity of the word
    first: np.ndarray  # index of each document's first word, and the total

    def doc(self) -> np.ndarray:
        """The document number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_bytes(w: Words, which: np.ndarray) -> pa.Array:
    """The bytes of the words at these places, as a binary column."""
    size = w.end[which] - w.start[which]
    offset = np.concatenate(([0], np.cumsum(size)))
    data = w.data[np.arange(offset[-1]) + np.repeat(w.start[which] - offset[:-1], size)]
    buffers = [None, pa.py_buffer(offset.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(size), buffers)


def words_of(texts: list[bytes], lower: bool) -> Words:
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    space = np.concatenate(([True], _SPACE[data], [True]))
    turn = np.flatnonzero(space[1:] != space[:-1])
    start, end = turn[::2], turn[1::2]
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    return Words(data, start, end, hash_spans(data, start, end), np.searchsorted(start, at))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 64-bit identities of the byte strings from start to end."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), _BASE), out=total[1:])
    value = (total[end] - total[start]) * _powers(len(data) + 1, _BASE_INV)[start]
    return mix64(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
