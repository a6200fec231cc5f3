"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text's set of 5-word shingles is hashed; texts with equal sets form a
   class, worked on as one from then on.
2. ``BANDS`` bands of ``ROWS`` minhashes give buckets.  Small buckets propose
   all their pairs.  A large bucket proposes its hub (the member that meets
   the most others in all its buckets) with each member.  Members of large
   buckets that then still hold several components are compared exactly: a
   pair that reaches the threshold shares one of the rarest shingles of both
   (prefix and position filter), and only pairs of different components are
   proposed.  So a bucket's size does not set the number of pairs.
3. Signatures of a proposed pair are compared in batches.  The pair is dropped
   as soon as the posterior probability that its similarity reaches the
   threshold is under ``MISS``; survivors are verified on their full sets.
4. Components of the verified links give the groups.

Pairs of classes within one component need no link of their own: only
memberships are returned, and no group is expanded into all pairs.

Chance of missing a pair at a similarity of exactly 0.75: 5e-6 that no band is
shared, MISS in each batch; both fall fast as the similarity grows.

Defined cases: null, empty and wordless texts have no set and are linked with
nothing; under five words the whole sequence is the only shingle; rows with
equal text are linked; a null doc_id never becomes a component's id unless all
of its component's are null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reach_package
from .components import components, merged
from .docs import cuts, map_slices, materialize, mix64, slices, with_bytes, with_row_key, words_of

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-5
SMALL = 16  # buckets up to this size propose all pairs

_MULTIPLIERS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = words_of(texts, lower=True)
    n = len(w.hash)
    key = np.zeros(n, dtype=np.uint64)
    if n >= SHINGLE:
        key[: n - SHINGLE + 1] = w.hash[: n - SHINGLE + 1]
        for k in range(1, SHINGLE):
            key[: n - SHINGLE + 1] = mix64(
                key[: n - SHINGLE + 1] * np.uint64(0x9E3779B97F4A7C15) + w.hash[k : n - SHINGLE + 1 + k]
            )
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(key[a : b - SHINGLE + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for h in w.hash[a:b]:
                whole = mix64(np.array([whole], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + h)[0]
            out.append(np.array([whole], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signature(own: np.ndarray) -> np.ndarray:
    """The top half of the smallest product with each multiplier."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(own), 1024):
        np.minimum(low, (own[i : i + 1024, None] * _MULTIPLIERS).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, n_shingles, cls (digest of the set, null if empty) and
    sig, one row by document."""

    def run(cols, texts):
        sets = shingles(texts)
        cls = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        sig = [signature(s).tobytes() if len(s) else None for s in sets]
        return {**cols, "n_shingles": [len(s) for s in sets], "cls": cls, "sig": sig}

    keyed = with_bytes(with_row_key(docs.select("doc_id", "text")), "doc_id", "k1", "k2")
    return map_slices(keyed, run, "doc_id long, k1 long, k2 long, n_shingles long, cls binary, sig binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """cls, band, key: one row by band."""
    reach_package(classes.sparkSession)
    schema = pa.schema([("cls", pa.binary()), ("band", pa.int32()), ("key", pa.int64())])

    def run(batches):
        for batch in batches:
            raw = b"".join(batch.column("sig").to_pylist())
            sig = np.frombuffer(raw, dtype="<u4").astype(np.uint64).reshape(-1, BANDS, ROWS)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2]).copy()
            for r in range(ROWS):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            n = len(sig)
            cls = batch.column("cls").take(pa.array(np.repeat(np.arange(n), BANDS)))
            band = np.tile(np.arange(BANDS, dtype=np.int32), n)
            yield pa.RecordBatch.from_arrays(
                [cls, pa.array(band), pa.array(key.ravel().view(np.int64))], schema=schema
            )

    return classes.select("cls", "sig").mapInArrow(run, "cls binary, band int, key long")


def least_matches(percent: int = PERCENT, miss: float = MISS) -> dict[int, int]:
    """By number of compared hashes, the matches under which the posterior
    (uniform prior) of a similarity of percent/100 or more is below miss."""
    t = percent / 100
    out = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        # P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)
        upto = 0.0
        out[n] = 0
        for m in range(n + 1):
            upto += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if upto < miss:
                out[n] = m + 1
    return out


def verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the threshold."""
    least = least_matches()
    reach_package(pairs.sparkSession)

    def prune(batches):
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
            x = np.frombuffer(b"".join(batch.column("sa").to_pylist()), dtype="<u4").reshape(-1, HASHES)
            y = np.frombuffer(b"".join(batch.column("sb").to_pylist()), dtype="<u4").reshape(-1, HASHES)
            alive = np.flatnonzero(keep)
            match = np.zeros(len(keep), dtype=np.int64)
            for n, need in least.items():
                part = slice(n - BATCH, n)
                match[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
                alive = alive[match[alive] >= need]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    side = lambda n: classes.select(
        F.col("cls").alias(n), F.col("n_shingles").alias(f"n{n}"), F.col("sig").alias(f"s{n}")
    )
    likely = materialize(
        pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(
            prune, "a binary, b binary"
        ),
        "near-likely",
    )

    def exact(batches):
        for batch in batches:
            ta, tb = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            good = []
            for i, j in cuts([max(len(x), len(y)) for x, y in zip(ta, tb)]):
                for k, (p, q) in enumerate(zip(shingles(ta[i:j]), shingles(tb[i:j])), i):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * both >= PERCENT * (len(p) + len(q) - both):
                        good.append(k)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    text = lambda n: texts.select(F.col("cls").alias(n), F.col("text").alias(f"t{n}"))
    return materialize(
        likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(
            exact, "a binary, b binary"
        ),
        "near-links",
    )


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _star(large: DataFrame) -> DataFrame:
    """Each large bucket's hub with its members; a pair may come from several
    buckets.  large: key, cls, m."""
    weight = large.groupBy("cls").agg(F.sum("m").alias("weight"))
    hub = (
        large.join(weight, "cls")
        .groupBy("key")
        .agg(F.max(F.struct("weight", "cls")).alias("hub"))
        .select("key", F.col("hub.cls").alias("hub"))
    )
    return large.join(hub, "key").filter("cls != hub").select(*_ordered(F.col("cls"), F.col("hub")))


def _cross(members: DataFrame, key: str) -> DataFrame:
    """All pairs within a bucket; for buckets of bounded size."""
    other = members.select(key, F.col("cls").alias("b"))
    return members.join(other, key).filter("cls < b").select(F.col("cls").alias("a"), "b")


def _unresolved(large: DataFrame, labels: DataFrame) -> DataFrame:
    """cls, comp: the members of large buckets that hold several components."""
    m = large.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "comp", F.coalesce("comp", "cls")
    )
    mixed = m.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    return m.join(mixed.select("key"), "key", "left_semi").select("cls", "comp").distinct()


def _prefix_pairs(open_classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of different components that can reach the threshold, from their
    shingles in order of rarity.

    A set of n shingles that shares the threshold's part with another has one
    of the other's among its n - ceil(0.75 n) + 1 rarest; and with sizes n and
    k and the shared one at places i and j, counted from 0, at most
    min(n - i, k - j) are shared, where 3/7 (n + k) are needed.  Shingles that
    one set alone has are counted, not joined."""
    reach_package(open_classes.sparkSession)

    def run(batches):
        for batch in batches:
            raw = batch.column("text").to_pylist()
            for a, b in slices(raw):
                sets = shingles(raw[a:b])
                size = np.array([len(x) for x in sets])
                offset = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("cls").slice(a, b - a),
                        batch.column("comp").slice(a, b - a),
                        pa.array(size),
                        pa.ListArray.from_arrays(pa.array(offset), pa.array(flat)),
                    ],
                    names=["cls", "comp", "n", "hs"],
                )

    sets = materialize(
        open_classes.join(texts, "cls").mapInArrow(run, "cls binary, comp binary, n long, hs array<long>"), "near-sets"
    )
    rows = sets.select("cls", "n", F.explode("hs").alias("h"))
    common = rows.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    rarest = Window.partitionBy("cls").orderBy("df", "h")
    whole = Window.partitionBy("cls")
    placed = (
        rows.join(common, "h")
        .withColumn("shared", F.count("*").over(whole))
        .withColumn("place", F.col("n") - F.col("shared") + F.row_number().over(rarest) - 1)
        .filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100))
        .join(sets.select("cls", "comp"), "cls")
        .select("h", "cls", "comp", "n", "place")
    )
    placed = materialize(placed, "near-prefix")
    for _ in range(2):  # a place too far back for the smallest set there is no use to any
        by_shingle = placed.groupBy("h").agg(
            F.min("n").alias("least"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
        )
        placed = (
            placed.join(by_shingle, "h")
            .filter("lo < hi AND 7 * (n - place) >= 3 * (n + least)")
            .select("h", "cls", "comp", "n", "place")
        )
    other = placed.select("h", *[F.col(c).alias(f"{c}2") for c in ("cls", "comp", "n", "place")])
    fits = (
        (F.col("cls") < F.col("cls2"))
        & (F.col("comp") != F.col("comp2"))
        & (100 * F.least("n", "n2") >= PERCENT * F.greatest("n", "n2"))
        & (7 * F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) >= 3 * (F.col("n") + F.col("n2")))
    )
    return placed.join(other, (placed["h"] == other["h"]) & fits).select(
        F.col("cls").alias("a"), F.col("cls2").alias("b")
    ).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, n_shingles, component_id, kept and comp (the component's
    key, null for an empty set): one row by document."""
    signed = materialize(sign(docs), "near-signed")
    classes = materialize(
        signed.filter("cls IS NOT NULL")
        .groupBy("cls")
        .agg(
            F.min("doc_id").alias("low"),
            F.min(F.struct("k1", "k2")).alias("at"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sig").alias("sig"),
        ),
        "near-classes",
    )
    bands = band_keys(classes)
    shared = bands.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    members = materialize(bands.join(shared, "key"), "near-members")
    small, large = members.filter(F.col("m") <= SMALL), members.filter(F.col("m") > SMALL)

    # texts of the classes that share a bucket, one a class
    wanted = members.select("cls").distinct().join(classes.select("cls", "at.k1", "at.k2"), "cls")
    rows = with_bytes(with_row_key(docs.select("doc_id", "text")), "k1", "k2")
    texts = materialize(
        wanted.join(rows, ["k1", "k2"]).select("cls", "text").dropDuplicates(["cls"]), "near-texts"
    )

    first = _cross(small.select("key", "cls"), "key").unionByName(_star(large)).distinct()
    links = verify(first, classes, texts)
    labels = components(links)
    still = materialize(_unresolved(large, labels), "near-open")
    if not still.isEmpty():
        more = verify(_prefix_pairs(still, texts), classes, texts)
        if not more.isEmpty():
            labels = merged(labels, more)

    # the smallest doc_id of each component
    named = classes.select("cls", "low").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    named = named.withColumn("comp", F.coalesce("comp", "cls"))
    lowest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    by_class = named.join(lowest, "comp").select("cls", "comp", "component_id")
    return (
        signed.select("doc_id", "k1", "k2", "n_shingles", "cls")
        .join(by_class, "cls", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select("doc_id", "k1", "k2", "n_shingles", "component_id", "kept", "comp")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one document of each group: the one with the
    smallest doc_id (nulls last), of rows with equal doc_id and text one.
    Documents with an empty set all stay."""
    near = materialize(near_duplicates(docs), "near-result")
    grouped = near.filter("comp IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k2", "k1")).alias("f")
    chosen = grouped.groupBy("comp").agg(first).select("f.k1", "f.k2")
    alone = near.filter("comp IS NULL").select("k1", "k2")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text").transform(with_row_key).select("row", "k1", "k2")
    once = rows.join(chosen, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return once.unionByName(rows.join(alone, ["k1", "k2"], "left_semi")).select("row.*")
