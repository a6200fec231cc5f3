"""N-gram Jaccard join by universe partition and pigeonhole.

Texts are sets of hashed 4-word shingles.  Two sets of sizes a and b link at a
similarity t only if at most H of their tokens differ, so if the universe of
tokens is cut into more than H segments by hash, one segment holds the same
subset in both.

1. Texts with equal sets form a class.  Each class emits the subsets of its
   segments as keys: in the scheme of its size band, and in that of the band
   below if a set there can still link with it.  A band's scheme has
   ``need`` = H + 1 segments and a few to spare, so empty segments need no key;
   a set with too many empty ones goes on to another partition.
2. Keys that several classes share propose pairs: small buckets all of theirs,
   large ones their hub with each member (summed up in the emitting task, so a
   hot key is shuffled as a few rows).  A histogram of each set's tokens
   bounds the differing ones from below and drops most pairs; the rest is
   verified on the full sets.
3. A class may leave out segments whose large bucket still holds several
   components as long as ``need`` others remain.  The classes that cannot are
   compared with each other: every segment's subset and its one-deletion
   neighbourhood are indexed, and each class spends ``need`` units on its
   cheapest segments, by the counted sizes of their buckets: none, one for
   equal subsets, two for at most one differing token.  By the pigeonhole a
   linked pair shares one of the chosen keys.
4. Components of the verified links.

So the result is exact but for 64-bit hashes of shingles (128 bits for classes).

Defined cases: null, empty and wordless texts have no set and are linked with
nothing; under four words the whole sequence is the only shingle; rows with
equal sets are linked; a null doc_id never becomes a component's id unless all
of its component's are null; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reach_package
from .components import components
from .docs import cuts, map_slices, materialize, mix64, release, slices, with_bytes, with_row_key, words_of

SHINGLE = 4
PERCENT = 85
SMALL = 16  # buckets up to this size propose all pairs
BLOCK = 1 << 20  # keys that a task looks through at once
LEAST = 6  # smaller sets link with equal ones only: 5 / 6 < 0.85
BAND = 1.5  # largest size by smallest of a band, about
TRIES = 32  # partitions after which a set emits its tokens themselves

PARITY = [f"s{i}" for i in range(8)]  # 512 bits
_ODD = np.uint64(0x9E3779B97F4A7C15)


def token_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = words_of(texts, lower=True)
    n = max(len(w.hash) - SHINGLE + 1, 0)
    key = w.hash[:n].copy()
    for k in range(1, SHINGLE):
        key = mix64(key * _ODD + w.hash[k : k + n])
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(key[a : b - SHINGLE + 1]))
            continue
        whole = np.full(min(b - a, 1), b - a, dtype=np.uint64)
        for h in w.hash[a:b]:
            whole = mix64(whole * _ODD + h)
        out.append(whole)
    return out


def most_differing(small: int, large: int) -> int:
    """The most tokens that differ in a linked pair whose smaller set has from
    ``small`` to ``large`` tokens."""
    top = large + 100 * large // PERCENT
    both = np.arange(max(2 * small, top - 400), top + 1)  # rises with the sum but for rounding
    return int((both - 2 * -(-PERCENT * both // (100 + PERCENT))).max())


class Bands:
    """Size bands: a linked pair's sizes lie in one band or in neighbours."""

    def __init__(self):
        self.low, self.need, self.segments = [LEAST], [], []

    def reach(self, size: int) -> None:
        while len(self.need) == 0 or self.low[-1] <= size:
            a = self.low[-1]
            self.low.append(max(100 * a // PERCENT + 1, int(a * BAND)))
            need = most_differing(a, self.low[-1] - 1) + 1
            self.need.append(need)
            self.segments.append(need + 2 + need // 16)

    def schemes(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into n, scheme): each size's band, and the one below where
        its largest set can link."""
        self.reach(int(n.max(initial=0)))
        low = np.array(self.low)
        band = np.searchsorted(low, n, side="right") - 1
        own = np.flatnonzero(band >= 0)
        lower = np.flatnonzero((band >= 1) & (100 * (low[np.maximum(band, 0)] - 1) >= PERCENT * n))
        return np.concatenate((own, lower)), np.concatenate((band[own], band[lower] - 1))


class Segments:
    """The segments of some sets, each by its scheme's partition."""

    def __init__(self, flat, first, size, scheme, count, attempt):
        """flat: tokens; by set: place of its first token, tokens, scheme and
        number of segments."""
        self.base = np.concatenate(([0], np.cumsum(count)))
        of = np.repeat(np.arange(len(size)), size)
        self.token = flat[np.arange(len(of)) + np.repeat(first - (np.cumsum(size) - size), size)]
        draw = mix64(self.token ^ mix64(np.array([attempt + 1], np.uint64) * _ODD)) >> np.uint64(32)
        self.at = self.base[of] + ((draw * count[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        self.size = np.bincount(self.at, minlength=self.base[-1])
        self.value = mix64(self.token * _ODD + np.uint64(1))
        self.sum = np.zeros(self.base[-1], np.uint64)
        np.add.at(self.sum, self.at, self.value)
        number = np.arange(self.base[-1]) - np.repeat(self.base[:-1], count)
        place = (np.repeat(scheme, count) * TRIES + attempt).astype(np.uint64) * _ODD + number.astype(np.uint64)
        self.place = mix64(place)  # tells segments, schemes and partitions apart

    def keys(self) -> np.ndarray:
        return mix64(self.sum * _ODD + self.place)

    def deletions(self) -> np.ndarray:
        """By token: its segment's key without it."""
        return mix64((self.sum[self.at] - self.value) * _ODD + self.place[self.at])


def segment_keys(sets: list[np.ndarray], bands: Bands):
    """By set: keys, tags (1: scheme of the band below, 2: the partition that
    is enough) and spare, how many of the keys of that partition may be left
    out in the own scheme and in the lower one."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    first = np.cumsum(n) - n
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc, scheme = bands.schemes(n)
    lower = np.searchsorted(np.array(bands.low), n[doc], side="right") - 1 != scheme
    need, count = np.array(bands.need)[scheme], np.array(bands.segments)[scheme]
    spare = np.full((len(sets), 2), -1, dtype=np.int64)
    parts = []
    todo = np.arange(len(doc))
    for attempt in range(TRIES):
        if not len(todo):
            break
        s = Segments(flat, first[doc[todo]], n[doc[todo]], scheme[todo], count[todo], attempt)
        used = s.size > 0
        left = np.add.reduceat(used, s.base[:-1], dtype=np.int64) - need[todo]
        of = np.repeat(np.arange(len(todo)), count[todo])[used]
        parts.append((doc[todo][of], s.keys()[used], lower[todo][of] + 2 * (left[of] >= 0)))
        enough = left >= 0
        spare[doc[todo[enough]], lower[todo[enough]].astype(int)] = left[enough]
        todo = todo[~enough]
    if len(todo):  # a linked pair shares one of any ``need`` tokens
        of = np.repeat(todo, n[doc[todo]])
        place = np.concatenate([first[d] + np.arange(n[d]) for d in doc[todo]])
        parts.append((doc[of], mix64(flat[place] + scheme[of].astype(np.uint64)), lower[of] + 2))
        spare[doc[todo], lower[todo].astype(int)] = n[doc[todo]] - need[todo]
    parts.append((np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    whose, key, tag = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(whose, kind="stable")
    offset = np.searchsorted(whose[order], np.arange(len(sets) + 1)).astype(np.int32)
    return offset, key[order], tag[order].astype(np.int32), spare


def histogram(tokens: np.ndarray) -> bytes:
    """Tokens counted by the top bits of a hash: about a cell for four."""
    bits = min(max((len(tokens) // 4).bit_length(), 6), 12)
    cell = (mix64(tokens + np.uint64(7)) >> np.uint64(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=1 << bits), 0xFFFF).astype("<u2").tobytes()


def parity(tokens: np.ndarray) -> np.ndarray:
    """A bit for each cell of tokens, set if it holds an odd number; a token
    that differs between two sets turns one bit at most."""
    cell = (mix64(tokens + np.uint64(11)) >> np.uint64(55)).astype(np.int64)  # of 512
    words = np.zeros(len(PARITY), np.uint64)
    np.bitwise_xor.at(words, cell >> 6, np.uint64(1) << (cell & 63).astype(np.uint64))
    return words.view(np.int64)


def may_link(x: bytes, y: bytes, n: int, k: int) -> bool:
    """Differences of the cells add up to at most the tokens that differ."""
    if 100 * min(n, k) < PERCENT * max(n, k):
        return False
    p, q = np.frombuffer(x, "<u2").astype(np.int64), np.frombuffer(y, "<u2").astype(np.int64)
    if max(p.max(), q.max()) == 0xFFFF:
        return True  # a full cell may hold more
    size = min(len(p), len(q))
    p, q = p.reshape(size, -1).sum(axis=1), q.reshape(size, -1).sum(axis=1)
    return int(np.abs(p - q).sum()) <= n + k - 2 * -(-PERCENT * (n + k) // (100 + PERCENT))


def _sign(docs: DataFrame) -> DataFrame:
    """One row by document: rid, doc_id, k1, k2, n, class (c1, c2; null if the
    set is empty), and of the first of each class in a task its keys, tags,
    spare numbers, parities and histogram."""
    seen: set[bytes] = set()  # of a task
    bands = Bands()

    def run(cols, texts):
        sets = token_sets(texts)
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        fresh = np.zeros(len(sets), bool)
        for i, d in enumerate(digests):
            if len(sets[i]) and d not in seen:
                fresh[i] = True
                if len(seen) < 1 << 20:
                    seen.add(d)
        none = np.zeros(0, np.uint64)
        offset, key, tag, spare = segment_keys([s if f else none for s, f in zip(sets, fresh)], bands)
        some = np.array([len(s) > 0 for s in sets], bool)
        both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        at = pa.array(offset)
        odd = np.array([parity(s) if f else np.zeros(len(PARITY), np.int64) for s, f in zip(sets, fresh)])
        lists = lambda v, kind: pa.ListArray.from_arrays(at, pa.array(v, kind))
        return {
            **cols,
            "n": [len(s) for s in sets],
            "c1": pa.array(both[:, 0], mask=~some),
            "c2": pa.array(both[:, 1], mask=~some),
            "keys": lists(key.view(np.int64), pa.int64()),
            "tags": lists(tag, pa.int32()),
            "spare0": spare[:, 0],
            "spare1": spare[:, 1],
            **{c: pa.array(np.ascontiguousarray(odd[:, i]), mask=~fresh) for i, c in enumerate(PARITY)},
            "cells": [histogram(s) if f else None for s, f in zip(sets, fresh)],
        }

    keyed = with_bytes(with_row_key(docs.select("doc_id", "text")), "doc_id", "k1", "k2")
    schema = (
        "doc_id long, k1 long, k2 long, n long, c1 long, c2 long, keys array<long>, tags array<int>, "
        "spare0 long, spare1 long, cells binary, " + ", ".join(f"{c} long" for c in PARITY)
    )
    return map_slices(keyed, run, schema).withColumn("rid", F.monotonically_increasing_id())


# kinds of rows on the way to pairs
_ROW, _HUB, _LARGE, _PAIR = 0, 1, 2, 3
_FOUND = "kind int, x long, y long, n long, tag int"


def _batch(kind, x, y, n, tag) -> pa.RecordBatch:
    m = len(x)
    kind = np.full(m, kind, np.int32) if np.isscalar(kind) else kind.astype(np.int32)
    zero = np.zeros(m, np.int64)
    n, tag = (zero if v is None else v for v in (n, tag))
    return pa.RecordBatch.from_arrays(
        [pa.array(kind), pa.array(x), pa.array(y), pa.array(n.astype(np.int64)), pa.array(tag.astype(np.int32))],
        names=["kind", "x", "y", "n", "tag"],
    )


def _near_sizes(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, k) >= PERCENT * np.maximum(n, k)


def _pairs(a, na, b, nb) -> pa.RecordBatch:
    ok = _near_sizes(na, nb)
    a, b = a[ok], b[ok]
    return _batch(_PAIR, np.minimum(a, b), np.maximum(a, b), None, None)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return head, np.diff(np.concatenate((head, [len(x)])))


def _before_shuffle(batches):
    """Keys of chosen classes.  Where a key has a large bucket in this task
    alone, only its hub goes on; its members are settled here."""

    def settle(parts):
        rid, n, key, tag = (np.concatenate(v) for v in zip(*parts))
        order = np.lexsort((rid, key))
        rid, n, key, tag = rid[order], n[order], key[order], tag[order]
        head, size = _runs(key)
        large = size > SMALL
        inside = np.repeat(large, size)
        kind = np.zeros(len(key), np.int32)
        kind[head[large]] = _HUB
        goes = ~inside
        goes[head[large]] = True
        yield _batch(kind[goes], key[goes], rid[goes], n[goes], tag[goes])
        member = ~goes
        if member.any():
            hub = np.repeat(head, size)[member]
            yield _batch(_LARGE, key[member], rid[member], None, tag[member])
            yield _pairs(rid[hub], n[hub], rid[member], n[member])

    held, total = [], 0
    for batch in batches:
        lists = batch.column("keys")
        length = np.diff(lists.offsets.to_numpy())
        key = lists.flatten().to_numpy()
        tag = batch.column("tags").flatten().to_numpy()
        rid, n = (np.repeat(batch.column(c).to_numpy(), length) for c in ("rid", "n"))
        held.append((rid, n, key, tag))
        total += len(key)
        if total >= BLOCK:
            yield from settle(held)
            held, total = [], 0
    if total:
        yield from settle(held)


def _after_shuffle(batches):
    """Buckets: all pairs of small ones, the hub's of large ones."""
    hub = None  # key, rid and size of a large bucket that goes on in the next block
    held = None

    def settle(x, last):
        """The complete buckets of the block, and what is left of it."""
        nonlocal hub
        out = []
        if hub is not None:
            go = int(np.searchsorted(x["x"] != hub[0], True))
            part = {c: v[:go] for c, v in x.items()}
            out.append(_batch(_LARGE, part["x"], part["y"], None, part["tag"]))
            out.append(_pairs(np.full(go, hub[1]), np.full(go, hub[2]), part["y"], part["n"]))
            x = {c: v[go:] for c, v in x.items()}
            if len(x["x"]):
                hub = None
        if not len(x["x"]):
            return out, None
        head, size = _runs(x["x"])
        large = (size > SMALL) | (x["kind"][head] == _HUB)
        rest = None
        if not last:
            if large[-1]:
                hub = tuple(int(x[c][head[-1]]) for c in ("x", "y", "n"))
            else:
                rest = {c: v[head[-1] :] for c, v in x.items()}
                head, size, large = head[:-1], size[:-1], large[:-1]
        for length in range(2, SMALL + 1):
            at = head[(size == length) & ~large]
            if len(at):
                i, j = np.triu_indices(length, 1)
                i, j = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                out.append(_pairs(x["y"][i], x["n"][i], x["y"][j], x["n"][j]))
        if large.any():
            top, wide = head[large], size[large]
            m = np.arange(wide.sum()) + np.repeat(top - (np.cumsum(wide) - wide), wide)
            h = np.repeat(top, wide)
            out.append(_batch(_LARGE, x["x"][m], x["y"][m], None, x["tag"][m]))
            out.append(_pairs(x["y"][h[m != h]], x["n"][h[m != h]], x["y"][m[m != h]], x["n"][m[m != h]]))
        return out, rest

    for batch in batches:
        x = {c: batch.column(c).to_numpy() for c in ("kind", "x", "y", "n", "tag")}
        settled = x["kind"] >= _LARGE
        if settled.any():
            yield batch.filter(pa.array(settled))
            x = {c: v[~settled] for c, v in x.items()}
        if held is not None:
            x = {c: np.concatenate((held[c], x[c])) for c in x}
        out, held = settle(x, False)
        yield from out
    if held is not None:
        yield from settle(held, True)[0]


def _find(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of kind _PAIR (classes x, y) and _LARGE (key x, class y, tag)."""
    reach_package(signed.sparkSession)
    emitted = (
        signed.filter(F.size("keys") > 0)
        .select("rid", "n", "keys", "tags")
        .join(classes.select("rid"), "rid", "left_semi")
        .mapInArrow(_before_shuffle, _FOUND)
    )
    dealt = emitted.repartition("x").sortWithinPartitions(F.col("kind") >= _LARGE, "x", F.col("kind").desc(), "y")
    return dealt.mapInArrow(_after_shuffle, _FOUND).select("kind", "x", "y", "tag")


def _near_parity(mark: str = "2"):
    """Column: the turned bits allow a link (n and n2 tokens)."""
    both = F.col("n") + F.col(f"n{mark}")
    turned = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}{mark}"))) for c in PARITY)
    return turned <= both - 2 * F.ceil(PERCENT * both / (100 + PERCENT))


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose parities and histograms allow a link."""
    reach_package(pairs.sparkSession)

    def run(batches):
        for batch in batches:
            x = [batch.column(c).to_pylist() for c in ("cells", "cells2", "n", "n2")]
            keep = np.array([may_link(*row) for row in zip(*x)], bool)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = classes.select(F.col("rid").alias("a"), "n", "cells", *PARITY)
    right = classes.select(F.col("rid").alias("b"), *[F.col(c).alias(f"{c}2") for c in ("n", "cells", *PARITY)])
    both = pairs.distinct().join(left, "a").join(right, "b").filter(_near_parity())
    return both.select("a", "b", "cells", "cells2", "n", "n2").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that link, by their full sets."""
    reach_package(pairs.sparkSession)

    def run(batches):
        for batch in batches:
            ta, tb = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            good = np.zeros(len(ta), bool)
            for i, j in cuts([max(len(x), len(y)) for x, y in zip(ta, tb)]):
                for k, (p, q) in enumerate(zip(token_sets(ta[i:j]), token_sets(tb[i:j])), i):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    good[k] = 100 * both >= PERCENT * (len(p) + len(q) - both)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    side = lambda s: texts.select(F.col("rid").alias(s), F.col("text").alias(f"t{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(
        run, "a long, b long"
    )


def _left_short(large: DataFrame, classes: DataFrame, *by: str) -> DataFrame:
    """The classes (``by``, lower) that have too few segments besides these."""
    left_out = large.groupBy(*by, (F.col("tag") % 2 == 1).alias("lower")).agg(
        F.count_if(F.col("tag") >= 2).alias("enough"), F.count_if(F.col("tag") < 2).alias("earlier")
    )
    spare = F.when(F.col("lower"), F.col("spare1")).otherwise(F.col("spare0"))
    return (
        left_out.join(classes.select("rid", "spare0", "spare1"), "rid")
        .filter((F.col("enough") > spare) | (F.col("earlier") > 0))
        .select(*by, "lower")
    )


def _open(large: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """rid, comp, lower: the classes that are left with too few segments
    without the large buckets that hold several components."""
    named = large.join(labels.withColumnRenamed("node", "rid"), "rid", "left").withColumn(
        "comp", F.coalesce("comp", "rid")
    )
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    return _left_short(named.join(mixed.select("key"), "key", "left_semi"), classes, "rid", "comp")


def _neighbour_pairs(still: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of different components among the open classes, by segment
    subsets and one-deletion neighbourhoods; each class spends its scheme's
    units where they are cheapest.  Of two classes the one that spent less
    looks for the other, and pairs that share a key but have too many odd
    cells apart are dropped where they meet."""
    reach_package(still.sparkSession)
    schema = "rid long, comp long, n long, scheme long, need long, seg long, deleted boolean, key long"

    def run(batches):
        bands = Bands()
        for batch in batches:
            raw = batch.column("text").to_pylist()
            rid, comp, lower = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "comp", "lower"))
            for a, b in slices(raw):
                sets = token_sets(raw[a:b])
                n = np.array([len(s) for s in sets], np.int64)
                bands.reach(int(n.max()))
                scheme = np.searchsorted(np.array(bands.low), n, side="right") - 1 - lower[a:b]
                count, need = np.array(bands.segments)[scheme], np.array(bands.need)[scheme]
                s = Segments(np.concatenate(sets), np.cumsum(n) - n, n, scheme, count, 0)
                of = np.repeat(np.arange(b - a), count)
                seg = np.arange(s.base[-1])
                for at, key, deleted in ((seg, s.keys(), False), (s.at, s.deletions(), True)):
                    i = of[at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array(v[i].astype(np.int64)) for v in (rid[a:b], comp[a:b], n, scheme, need)),
                            pa.array(at - s.base[i]), pa.array(np.full(len(i), deleted)), pa.array(key.view(np.int64)),
                        ],
                        names=[c.split()[0] for c in schema.split(", ")],
                    )

    rows = materialize(
        still.join(texts, "rid").select("rid", "comp", "lower", "text").mapInArrow(run, schema), "join-neighbours"
    )
    count = rows.groupBy("key").agg(
        F.count_if(~F.col("deleted")).alias("equal"),
        F.count_if("deleted").alias("less"),
        F.min("comp").alias("lo"),
        F.max("comp").alias("hi"),
    )
    # a bucket of one component asks for no pairs
    count = count.filter("lo < hi").select("key", "equal", "less")
    segment = ["rid", "scheme", "seg"]
    full = ~F.col("deleted")
    cost = rows.join(count, "key", "left").groupBy(*segment).agg(
        F.first("need").alias("need"),
        F.coalesce(F.sum(F.when(full, F.col("equal"))), F.lit(0)).alias("one"),
        F.coalesce(F.sum(F.when(full, F.col("less")).otherwise(F.col("equal"))), F.lit(0)).alias("more"),
    )
    units = cost.select(
        *segment, "need",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("unit"), F.col("one").alias("cost")),
                F.struct(F.lit(2).alias("unit"), F.greatest("one", "more").alias("cost")),
            )
        ).alias("u"),
    ).select(*segment, "need", "u.unit", "u.cost")
    cheapest = Window.partitionBy("rid", "scheme").orderBy("cost", "unit", "seg")
    chosen = units.withColumn("nth", F.row_number().over(cheapest)).filter("nth <= need")
    chosen = materialize(chosen.groupBy(*segment).agg(F.max("unit").alias("units"), F.sum("cost").alias("cost")), "join-units")
    spent = chosen.groupBy("rid", "scheme").agg(F.sum("cost").alias("spent"))
    sides = spent.join(classes.select("rid", *PARITY), "rid")
    asked = rows.join(count.select("key"), "key", "left_semi")
    met = asked.join(sides, ["rid", "scheme"]).select("key", "rid", "comp", "n", "deleted", "spent", *PARITY)
    probes = asked.join(chosen.drop("cost"), segment).filter("NOT deleted OR units = 2").join(sides, ["rid", "scheme"])
    probes = probes.select("key", "rid", "comp", "n", "deleted", "units", "spent", *PARITY)
    other = met.select("key", *[F.col(c).alias(f"{c}2") for c in met.columns if c != "key"])
    fits = (
        (F.col("comp") != F.col("comp2"))
        & (F.struct("spent", "rid") < F.struct(F.col("spent2").alias("spent"), F.col("rid2").alias("rid")))
        & (100 * F.least("n", "n2") >= PERCENT * F.greatest("n", "n2"))
        & ~(F.col("deleted") & F.col("deleted2"))
        & ((F.col("units") == 2) | ~F.col("deleted2"))
        & _near_parity()
    )
    return probes.join(other, (probes["key"] == other["key"]) & fits).select(
        F.least("rid", "rid2").alias("a"), F.greatest("rid", "rid2").alias("b")
    )


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, one row by document."""
    signed = materialize(_sign(docs), "join-signed")
    of_class = materialize(signed.select("doc_id", "n", "c1", "c2"), "join-documents")
    keyed = F.col("cells").isNotNull()
    chosen = signed.filter("c1 IS NOT NULL").groupBy("c1", "c2").agg(
        F.min("doc_id").alias("low"), F.min(F.when(keyed, F.col("rid"))).alias("rid")
    )
    chosen = materialize(chosen, "join-chosen")
    columns = ["rid", "n", "k1", "k2", "spare0", "spare1", "cells", *PARITY]
    classes = materialize(signed.select(*columns).join(chosen.select("rid"), "rid", "left_semi"), "join-classes")
    found = materialize(_find(signed, classes), "join-found")
    release(docs.sparkSession, signed)

    pairs = found.filter(F.col("kind") == _PAIR).select(F.col("x").alias("a"), F.col("y").alias("b"))
    likely = materialize(_likely(pairs, classes), "join-likely")
    large = found.filter(F.col("kind") == _LARGE).select(F.col("x").alias("key"), F.col("y").alias("rid"), "tag")
    # texts of all that may yet be compared, in one pass over the documents
    wanted = _left_short(large, classes, "rid").select("rid")
    for side in ("a", "b"):
        wanted = wanted.unionByName(likely.select(F.col(side).alias("rid")))
    texts = materialize(_texts(docs, wanted, classes), "join-texts")
    release(docs.sparkSession)
    links = materialize(_verify(likely, texts), "join-links")
    release(docs.sparkSession, likely)
    labels = components(links)
    still = materialize(_open(large, labels, classes), "join-open")
    if not still.isEmpty():
        more = materialize(_likely(_neighbour_pairs(still, texts, classes), classes), "join-likely")
        links = materialize(links.unionByName(_verify(more, texts)).distinct(), "join-links")
        labels = components(links)
    release(docs.sparkSession, found, texts)

    named = chosen.join(labels.withColumnRenamed("node", "rid"), "rid", "left")
    named = named.withColumn("comp", F.coalesce("comp", "rid"))
    lowest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    by_class = named.join(lowest, "comp").select("c1", "c2", "component_id")
    return of_class.join(by_class, ["c1", "c2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def _texts(docs: DataFrame, rids: DataFrame, classes: DataFrame) -> DataFrame:
    """rid, text of one document of each class asked for."""
    at = rids.distinct().join(classes.select("rid", "k1", "k2"), "rid")
    rows = with_bytes(with_row_key(docs.select("doc_id", "text")), "k1", "k2")
    return at.join(rows, ["k1", "k2"]).select("rid", "text").dropDuplicates(["rid"])
