"""Removal of long repeated byte strings by bucket-pointer refinement.

A suffix's bucket is named by its first q bytes.  A bucket of 2q bytes is the
pair of the bucket at a place and the bucket q later, so names double in depth
by looking at names already made (``deepen``), up to ``LENGTH`` bytes; suffixes
with equal names share their first LENGTH bytes, which is all that the removal
asks of a suffix array.

Not every place is sent through a shuffle.  Places in a row whose window has
the same smallest ``GRAM``-byte name form a run; equal strings have equal
smallest names, so only runs with a name in common can hold equal strings.
Buckets are then refined level by level: runs by smallest name, those by the
name of the whole run (copies, settled with one row a run), and only buckets
in which runs differ, place by place.  Only the first run of equal ones is
refined further, so copies never multiply.

Names are 64 bits; rows are matched by two of them made of different depths
(128 bits).  No group of equal names is gathered: they are counted, with a
partial count before the shuffle, and joined back.

Defined cases: null and short texts lose nothing; equal rows are occurrences
of each other; overlapping occurrences within a text count; one text's strings
never reach into another; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reach_package
from .docs import _powers, map_slices, materialize, mix64, release, slices, with_bytes, with_row_key

LENGTH = 400
GRAM = 256
WINDOW = LENGTH - GRAM + 1  # GRAM-byte names within a string of LENGTH bytes
SLICE_BYTES = 1 << 20
_FOLD = 0x9FB21C651E98DF25
_FOLD_INV = pow(_FOLD, -1, 1 << 64)
_BYTE_NAME = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def deepen(name: np.ndarray, later: int) -> np.ndarray:
    """Names of the pairs (name here, name ``later`` places on)."""
    out = name[: len(name) - later] * np.uint64(0xA24BAED4963EE407)
    out += name[later:]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9FB21C651E98DF25)
    out ^= out >> np.uint64(29)
    return out


def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the GRAM and of the LENGTH bytes from each place on."""
    name, depth = _BYTE_NAME[data], 1
    while depth < GRAM:
        name = deepen(name, depth)
        depth *= 2
    return name, deepen(name, LENGTH - GRAM)


def smallest(name: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each ``size`` names in a row."""
    n = len(name) - size + 1
    block = np.full(-(-len(name) // size) * size, np.iinfo(np.uint64).max, dtype=np.uint64)
    block[: len(name)] = name
    block = block.reshape(-1, size)
    upto = np.minimum.accumulate(block, axis=1).ravel()
    since = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[:n], upto[size - 1 : size - 1 + n])


def _places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, and the places where a string of LENGTH bytes begins,
    with the number of their text."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(size) - size
    room = np.maximum(size - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(texts)), room)
    at = np.arange(int(room.sum())) - np.repeat(np.cumsum(room) - room, room) + np.repeat(begin, room)
    return data, at, doc


def runs_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of places with one smallest name: text, first place in it, length,
    smallest name, name of the whole run, and whether the smallest name may
    occur twice in it (only then can a run hold equal strings itself)."""
    data, at, doc = _places(texts)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return {"doc": none, "start": none, "len": none, "m": none, "f": none, "again": none.astype(bool)}
    gram, full = names(data)
    low = smallest(gram, WINDOW)
    m = low[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    # the run's name: a sum over its places, weighted by the place in the run
    power, back = _powers(len(at), _FOLD), _powers(len(at), _FOLD_INV)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(full[at] * power)))
    f = mix64((total[first + length] - total[first]) * back[first] + length.astype(np.uint64))
    # places whose name is the smallest of a window that holds them
    top = np.zeros(len(gram) + WINDOW, dtype=np.uint64)
    held = np.zeros(len(low), dtype=np.uint64)
    held[at] = m
    top[WINDOW - 1 : WINDOW - 1 + len(held)] = held
    most = ~smallest(~top, WINDOW)[: len(gram)]
    anchor = np.flatnonzero((gram <= most) & (most > 0))
    near = (gram[anchor][1:] == gram[anchor][:-1]) & (np.diff(anchor) <= WINDOW)
    again = np.isin(m[first], gram[anchor][1:][near]) if near.any() else np.zeros(len(first), dtype=bool)
    begin = np.cumsum([0] + [len(t) for t in texts])
    return {
        "doc": doc[first],
        "start": at[first] - begin[doc[first]],
        "len": length,
        "m": m[first].view(np.int64),
        "f": f.view(np.int64),
        "again": again,
    }


def _find_runs(keyed: DataFrame) -> DataFrame:
    def run(cols, texts):
        got = runs_of(texts)
        doc = pa.array(got.pop("doc"))
        return {"k1": cols["k1"].take(doc), "k2": cols["k2"].take(doc), **got}

    schema = "k1 long, k2 long, start long, len int, m long, f long, again boolean"
    return map_slices(keyed, run, schema, limit=SLICE_BYTES)


def _expand(rows: DataFrame) -> DataFrame:
    """Every place of the listed runs with its LENGTH-byte name."""
    reach_package(rows.sparkSession)
    schema = "k1 long, k2 long, m long, name long, at long, settled boolean"

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts, SLICE_BYTES):
                data = np.frombuffer(b"".join(texts[a:b]), dtype=np.uint8)
                begin = np.cumsum([0] + [len(t) for t in texts[a:b]])
                _, full = names(data)
                listed = batch.column("runs").slice(a, b - a)
                flat = listed.flatten()
                field = lambda n: flat.field(n).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                doc = np.repeat(np.arange(b - a), listed.value_lengths().to_numpy())
                size = field("len").astype(np.int64)
                if not len(size):
                    continue
                which = np.repeat(np.arange(len(size)), size)
                at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + field("start")[which]
                name = full[at + begin[doc[which]]].view(np.int64)
                owner = pa.array(doc[which] + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("k1").take(owner),
                        batch.column("k2").take(owner),
                        pa.array(field("m")[which]),
                        pa.array(name),
                        pa.array(at),
                        pa.array(field("settled")[which]),
                    ],
                    names=["k1", "k2", "m", "name", "at", "settled"],
                )

    return rows.select("k1", "k2", "text", "runs").mapInArrow(run, schema)


def repeated_intervals(keyed: DataFrame) -> DataFrame:
    """k1, k2, a, b: for each document with any, the begins and ends of the
    byte ranges to remove, overlapping ones included.  keyed: k1, k2 and the
    text as bytes."""
    runs = materialize(_find_runs(keyed), "repeats-runs")
    # level 1: runs that share their smallest name
    shared = runs.groupBy("m").agg(F.count("*").alias("n"), F.max("again").alias("again"))
    # written, so that the shuffle that counts is gone before the one that joins
    shared = materialize(shared.filter((F.col("n") > 1) | F.col("again")).select("m"), "repeats-shared")
    spark = keyed.sparkSession
    release(spark)
    open_runs = materialize(runs.join(shared, "m", "left_semi"), "repeats-open")
    release(spark, runs, shared)
    # level 2: equal runs, of which the first stands for all
    one = [F.first(c).alias(c) for c in ("k1", "k2", "start", "len", "again")]
    classes = open_runs.groupBy("m", "f").agg(F.count("*").alias("n"), *one)
    by_name = classes.groupBy("m").agg(F.count("*").alias("kinds"))
    classes = materialize(classes.join(by_name, "m"), "repeats-classes")
    copies = classes.filter("n > 1").select("m", "f")
    whole = open_runs.join(copies, ["m", "f"], "left_semi").select(
        "k1", "k2", F.col("start").alias("a"), (F.col("start") + F.col("len") + (LENGTH - 1)).alias("b")
    )
    # level 3: place by place where runs of one name differ
    listed = (
        classes.filter("kinds > 1 OR (n = 1 AND again)")
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("m", "start", F.col("len").cast("int").alias("len"), (F.col("n") > 1).alias("settled"))).alias("runs"))
    )
    places = materialize(_expand(keyed.join(listed, ["k1", "k2"])), "repeats-places")
    release(spark)
    twice = places.groupBy("m", "name").agg(F.count("*").alias("n")).filter("n > 1").select("m", "name")
    twice = materialize(twice, "repeats-twice")
    release(spark)
    single = places.filter("NOT settled").join(twice, ["m", "name"], "left_semi")
    both = whole.unionByName(single.select("k1", "k2", F.col("at").alias("a"), (F.col("at") + LENGTH).alias("b")))
    ranges = both.groupBy("k1", "k2").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    ranges = materialize(ranges, "repeats-ranges")
    release(spark, open_runs, classes, places, twice)
    return ranges


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeated (whether
    anything was removed), kept (the bytes left) and spans (begin and end of
    each removed run)."""
    keyed = with_bytes(with_row_key(docs.select("doc_id", "text")), "doc_id", "k1", "k2")
    ranges = repeated_intervals(keyed.drop("doc_id"))

    def run(cols, texts):
        out = {n: [] for n in ("n_removed", "n_spans", "kept_sha256", "repeated", "kept", "spans")}
        for text, a, b in zip(texts, cols["a"].to_pylist(), cols["b"].to_pylist()):
            spans = []
            if a:
                edge = np.zeros(len(text) + 1, dtype=np.int64)
                np.add.at(edge, a, 1)
                np.add.at(edge, b, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                spans = turn.reshape(-1, 2).tolist()
                text = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
            out["n_removed"].append(sum(y - x for x, y in spans))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
            out["repeated"].append(len(spans) > 0)
            out["kept"].append(text)
            out["spans"].append(spans)
        return {"doc_id": cols["doc_id"], "n_bytes": [len(t) for t in texts], **out}

    return map_slices(
        keyed.join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "a", "b"),
        run,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeated boolean, kept binary, spans array<array<long>>",
    )
