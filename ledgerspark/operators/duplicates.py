"""Duplicate handling for an import: mark, skip or strict.

Key = (posting_date, voucher_id, ac_code, rc_amount, description), compared
null-safe by two 64-bit hashes. A row is a duplicate when its key already
exists in the history, or when an earlier row of the same import has the key;
rows are ordered by (source_file, source_row), so the same file delivered twice
under two names, or two files with equal rows, are found too.

Only places and hashes are shuffled. The first row of each key is a partial
aggregation; a row is a duplicate if its place is not that of a first row whose
key the history lacks. Places are unique, so a key that a third of the rows
have never meets in one task. Where first places are written already, they
become bitmaps by file and block of row numbers, a bit a row, and the rows
themselves are not shuffled (``place_bits``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DUPLICATE_KEY = ["posting_date", "voucher_id", "ac_code", "rc_amount", "description"]
PLACE = ["source_file", "source_row"]
HASH = ["h1", "h2"]
BLOCK_POWER = 15  # a bitmap has 2^15 bits, 512 words
MOST_BLOCKS = 16_384  # that are broadcast: 64 MB, half a billion rows


class DuplicateError(ValueError):
    """Duplicates were found, or cannot be looked for; rows: how many."""

    def __init__(self, text: str, rows: int = 0):
        super().__init__(text)
        self.rows = rows


def key_hashes(keys: list[str | Column] = DUPLICATE_KEY) -> list[Column]:
    """h1, h2: NULL and '' differ, and so does the column a value stands in."""
    marked = [x for k in keys for x in (k, (F.col(k) if isinstance(k, str) else k).isNull())]
    return [F.xxhash64(*marked).alias("h1"), F.xxhash64(*reversed(marked)).alias("h2")]


def places(df: DataFrame) -> list[str]:
    if "source_row" not in df.columns:
        raise DuplicateError("duplicates are ordered by source_row, which the rows lack")
    return [c for c in PLACE if c in df.columns]


def first_rows(rows: DataFrame, *more: Column) -> DataFrame:
    """h1, h2 and ``at`` (the first place) by key, and ``more`` aggregates."""
    return rows.groupBy(*HASH).agg(F.min(F.struct(*places(rows))).alias("at"), *more)


def _block() -> Column:
    return F.shiftright("source_row", BLOCK_POWER)


def _word() -> Column:
    return F.shiftright("source_row", 6).bitwiseAND(F.lit((1 << BLOCK_POWER - 6) - 1)).cast("int")


def _bit() -> Column:
    return F.col("source_row").bitwiseAND(F.lit(63)).cast("int")


def place_bits(fresh: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame | None:
    """Bitmaps of the first places (``at``), by file and block of source_row;
    ``write`` writes them. None where they are too many to broadcast, as with
    row numbers far apart, or a row has no number."""
    at = fresh.select("at.*").withColumn("_block", _block())
    by = [*[c for c in PLACE[:-1] if c in at.columns], "_block"]
    blocks = at.select(*by).distinct().limit(MOST_BLOCKS + 1)
    size = blocks.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_block").isNull()).alias("none")).first()
    if size["n"] > MOST_BLOCKS or size["none"]:
        return None
    # dealt out by block first, so no task makes bitmaps of another's blocks
    words = at.repartition(*by).groupBy(*by, _word().alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit())).alias("bits")
    )
    found = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    bits = words.groupBy(*by).agg(found.alias("found")).select(
        *by,
        F.transform(
            F.sequence(F.lit(0), F.lit((1 << BLOCK_POWER - 6) - 1)),
            lambda i: F.coalesce(F.element_at("found", i), F.lit(0).cast("long")),
        ).alias("bits"),
    )
    return write(bits, "place-bits")


def mark(
    new: DataFrame, rows: DataFrame, fresh: DataFrame, where: Column | None = None, bits: DataFrame | None = None
) -> DataFrame:
    """``new`` + ``is_duplicate``. rows: the places that take part; fresh: the
    first rows (``at``) of keys that the history lacks; bits: their
    ``place_bits``, if there are any."""
    place = places(rows)

    def same(a: DataFrame, b: DataFrame, prefix: str, of: list[str] = place) -> Column:
        return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"{prefix}{c}"]) for c in of])

    if bits is not None:  # a row that takes part is a duplicate unless it is a first one
        by = [c for c in bits.columns if c != "bits"]
        known = bits.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("bits").alias("_bits"))
        at = new.withColumn("_block", _block())
        at = at.join(F.broadcast(known), same(at, known, "_b_", by), "left")
        first = F.coalesce(F.getbit(F.get("_bits", _word()), _bit()) == 1, F.lit(False))
        hit = ~first if where is None else ~first & F.coalesce(where, F.lit(False))
        return at.withColumn("is_duplicate", hit).drop("_block", "_bits", *[f"_b_{c}" for c in by])
    kept = fresh.select(*[F.col(f"at.{c}").alias(f"_f_{c}") for c in place])
    found = rows.join(kept, same(rows, kept, "_f_"), "left_anti")
    found = found.select(*[F.col(c).alias(f"_d_{c}") for c in place], F.lit(True).alias("_dup")).distinct()
    hit = F.coalesce("_dup", F.lit(False))
    if where is not None:
        hit = hit & F.coalesce(where, F.lit(False))
    out = new.join(found, same(new, found, "_d_"), "left").withColumn("is_duplicate", hit)
    return out.drop("_dup", *[f"_d_{c}" for c in place])


def mark_duplicates(
    new: DataFrame, history: DataFrame | None = None, keys: list[str] = DUPLICATE_KEY, where: Column | None = None
) -> DataFrame:
    """``new`` + boolean ``is_duplicate``. ``new`` has source_row, and
    source_file if it holds more than one file. With ``where`` only rows
    meeting it take part; others are never duplicates."""
    part = new if where is None else new.filter(where)
    rows = part.select(*places(new), *key_hashes(keys))
    fresh = first_rows(rows)
    if history is not None:
        fresh = fresh.join(history.select(*key_hashes(keys)).distinct(), HASH, "left_anti")
    return mark(new, rows, fresh, where)
