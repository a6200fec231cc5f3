"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The merges are replayed over the distinct pieces of a corpus slice instead of
over each document: an inverted index from the rank of a pair to its positions
gives all places of the lowest open rank, they are merged at once, and only
the two neighbours of each merged place get new index entries.  Documents are
then sequences of pieces whose ids are looked up.

A task keeps the pieces it has solved (up to ``cache_units``, then it starts
anew; 100,000 hold about 60 MB with slices of 2 MB), so a piece is replayed once per task and not once per occurrence; no
row is shuffled.

Defined cases: a null or empty text gives no ids (and the digest of no bytes);
texts of any length are worked off whole; repeated rows give repeated rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .docs import give_back, map_slices, mix64, with_bytes

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_UNITS = 400_000
SLICE_BYTES = 6 << 20
_NONE = np.iinfo(np.int32).max


class Ranks:
    """A rank file and the pairs of tokens that its tokens split into."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.token = [b""] * self.size
        for t, r in self.ranks.items():
            self.token[r] = t
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        key, rank = [], []
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    key.append((a << 32) | b)
                    rank.append(r)
        self._fill(np.array(key, dtype=np.uint64), np.array(rank, dtype=np.int32))
        lengths = np.array([len(t) for t in self.token], dtype=np.int64)
        self.lengths = lengths
        self.starts = np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(self.token), dtype=np.uint8)

    def _fill(self, key: np.ndarray, rank: np.ndarray) -> None:
        """Open addressing: a pair lies at its hash or a few slots behind."""
        bits = int(4 * len(key)).bit_length()
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, _NONE, dtype=np.int32)
        slot = mix64(key) & self.mask
        self.probes = 0
        left = np.arange(len(key))
        while len(left):
            self.probes += 1
            free = left[self.values[slot[left]] == _NONE]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]] = key[put]
            self.values[slot[put]] = rank[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = mix64(key) & self.mask
        out = np.where(self.keys[slot] == key, self.values[slot], _NONE)
        todo = np.flatnonzero((out == _NONE) & (self.values[slot] != _NONE))
        for _ in range(self.probes):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
            s = slot[todo]
            out[todo] = np.where(self.keys[s] == key[todo], self.values[s], _NONE)
            todo = todo[(out[todo] == _NONE) & (self.values[s] != _NONE)]
        return out

    def one(self, piece: bytes) -> list[int]:
        """A piece by itself: the lowest rank first, the leftmost of equals."""
        ids = [self.ranks[bytes([b])] for b in piece]
        while True:
            best, at = _NONE, -1
            for i in range(len(ids) - 1):
                r = self.ranks.get(self.token[ids[i]] + self.token[ids[i + 1]], _NONE)
                if r < best:
                    best, at = r, i
            if at < 0:
                return ids
            ids[at : at + 2] = [best]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        total = int(n.sum())
        shift = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n)
        return self.bytes[np.arange(total) + shift].tobytes()


@lru_cache(maxsize=2)
def load_ranks(path: str) -> Ranks:
    return Ranks(path)


def replay(pieces: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the distinct pieces: (flat ids, offsets by piece)."""
    n_bytes = np.array([len(p) for p in pieces], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(n_bytes)))
    whole = np.array([ranks.ranks.get(p, -1) for p in pieces], dtype=np.int64)
    tok = ranks.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    size = len(tok)
    of_piece = np.repeat(np.arange(len(pieces)), n_bytes)
    nxt = np.arange(1, size + 1)
    nxt[first[1:][n_bytes > 0] - 1] = -1
    prv = np.arange(-1, size - 1)
    prv[first[:-1][n_bytes > 0]] = -1
    alive = np.ones(size, dtype=bool)
    open_rank = np.full(size, _NONE, dtype=np.int32)  # rank of the pair that begins here
    # a piece that is itself a token needs no merges
    known = whole >= 0
    ready = known[of_piece]
    alive[ready] = False
    alive[first[:-1][known]] = True
    tok[first[:-1][known]] = whole[known]

    index: dict[int, list[np.ndarray]] = defaultdict(list)
    heap: list[int] = []
    odd: set[int] = set()  # pieces in which a merge opened a lower rank

    def enter(at: np.ndarray, rank: np.ndarray) -> None:
        open_rank[at] = rank
        use = rank != _NONE
        at, rank = at[use], rank[use]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(np.diff(rank)) + 1
        begin = [0, *cut.tolist(), len(at)]
        for i, r in enumerate(rank[begin[:-1]].tolist()):
            if r not in index:
                heapq.heappush(heap, r)
            index[r].append(at[begin[i] : begin[i + 1]])

    at = np.flatnonzero((nxt >= 0) & ~ready)
    enter(at, ranks.pair_rank(tok[at], tok[nxt[at]]))
    while heap:
        rank = heapq.heappop(heap)
        chunks = index.pop(rank)
        at = np.concatenate(chunks) if len(chunks) > 1 else chunks[0]
        at = at[alive[at] & (open_rank[at] == rank)]
        if not len(at):
            continue
        at = np.unique(at)
        # runs of places that share a token: every second place, from the left
        linked = np.zeros(len(at), dtype=bool)
        linked[1:] = nxt[at[:-1]] == at[1:]
        if linked.any():
            head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
        right = nxt[at]
        after = nxt[right]
        alive[right] = False
        open_rank[right] = _NONE
        tok[at] = rank
        nxt[at] = after
        more = after >= 0
        prv[after[more]] = at[more]
        before = prv[at]
        touched = np.unique(np.concatenate((before[before >= 0], at)))
        follower = nxt[touched]
        new = np.full(len(touched), _NONE, dtype=np.int32)
        has = follower >= 0
        new[has] = ranks.pair_rank(tok[touched[has]], tok[follower[has]])
        lower = new < rank
        if lower.any():
            odd.update(of_piece[touched[lower]].tolist())
        enter(touched, new)

    left = np.flatnonzero(alive)
    ids = tok[left]
    count = np.bincount(of_piece[left], minlength=len(pieces))
    if odd:  # their order of merges differs from the common one
        parts = np.split(ids, np.cumsum(count)[:-1])
        for p in odd:
            parts[p] = np.array(ranks.one(pieces[p]), dtype=ids.dtype)
        count = np.array([len(x) for x in parts])
        ids = np.concatenate(parts)
    return ids, np.concatenate(([0], np.cumsum(count)))


class Encoder:
    """Encodes slices of texts; solved units are kept between slices.

    A unit is what stands between single blanks, with its blank.  The pattern
    cannot match across such a border, so a unit's ids do not depend on what
    stands around it.  A text with a blank beside other white space is cut by
    the pattern as a whole."""

    def __init__(self, ranks: Ranks, pattern: str = public_tokenizers.PATTERN, cache_units: int = CACHE_UNITS):
        import regex

        self.ranks = ranks
        self.cache_units = cache_units
        self.find = regex.compile(pattern).findall
        self.uneven = regex.compile(r"\s |^ | \s| $").search
        self.reset()

    def reset(self) -> None:
        self.unit_at = Numbered()
        self.piece_at = Numbered()
        self.pieces = Runs()  # the pieces of each unit
        self.ids = Runs()  # the ids of each piece

    def _units(self, text: str) -> list:
        if not text:
            return []
        if self.uneven(text):
            return [p.encode() for p in self.find(text)]  # bytes: pieces already
        first, *rest = text.split(" ")
        return [first, *[" " + u for u in rest]]

    def _solve(self, units: list) -> None:
        known, size = self.piece_at, len(self.piece_at)
        cut = [[u.decode()] if isinstance(u, bytes) else self.find(u) for u in units]
        flat = np.array([known[p] for c in cut for p in c], dtype=np.int64)
        self.pieces.add(flat, np.array([len(c) for c in cut], dtype=np.int64))
        new = list(islice(known, size, None))
        if new:
            ids, offset = replay([p.encode() for p in new], self.ranks)
            self.ids.add(ids, np.diff(offset))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and the offsets by text."""
        if len(self.unit_at) > self.cache_units:
            self.reset()
        known, size, counts = self.unit_at, len(self.unit_at), [0]
        seq: list[int] = []
        for text in texts:
            seq += map(known.__getitem__, self._units(text))
            counts.append(len(seq))
        if len(known) > size:
            self._solve(list(islice(known, size, None)))
        pieces, n_pieces = self.pieces.take(np.array(seq, dtype=np.int64))
        ids, n_ids = self.ids.take(pieces)
        by_piece = np.concatenate(([0], np.cumsum(n_ids)))
        by_unit = np.concatenate(([0], np.cumsum(n_pieces)))
        return ids, by_piece[by_unit[np.array(counts)]]


class Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Runs:
    """Integer runs of different lengths, kept one after the other."""

    def __init__(self):
        self.flat = np.zeros(0, dtype=np.int32)
        self.begin = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)

    def add(self, flat: np.ndarray, count: np.ndarray) -> None:
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.flat = np.concatenate((self.flat, flat.astype(np.int32)))

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs asked for, one after the other, and their lengths."""
        return gather(self.flat, self.begin[which], self.count[which])


def gather(flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[begin:begin + count] one after the other."""
    total = int(count.sum())
    shift = np.repeat(begin - (np.cumsum(count) - count), count)
    return flat[np.arange(total) + shift], count


def encode(
    docs: DataFrame,
    vocabulary: str | None = None,
    with_ids: bool = False,
    cache_units: int = CACHE_UNITS,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the bytes decoded from them,
    and the ids themselves if asked for.  A smaller cache and smaller slices
    take less memory and more time."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    # each task gets a copy of this: solved pieces are dropped when it ends,
    # and an idle Python worker holds no more than the rank file
    kept: dict[str, Encoder] = {}

    def run(cols, texts):
        if not kept:
            give_back()
            kept["encoder"] = Encoder(load_ranks(path), cache_units=cache_units)
        enc = kept["encoder"]
        ids, ends = enc.encode([t.decode() for t in texts])
        out = {"doc_id": cols["doc_id"], "n_tokens": np.diff(ends), "ids_sha256": [], "decoded_sha256": []}
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            own = ids[a:b]
            out["ids_sha256"].append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(enc.ranks.decode(own)).hexdigest())
        if with_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_slices(
        with_bytes(docs, "doc_id"), run, schema + (", ids array<int>" if with_ids else ""), limit=slice_bytes
    )
