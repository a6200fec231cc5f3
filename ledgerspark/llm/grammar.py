"""Re-Pair grammar compression of id sequences.

Rounds replace the most frequent pairs of neighbouring ids by new symbols
(nonterminals), until no pair is frequent.  A round takes the ``PAIRS`` most
frequent pairs at once; where two replacements would share an id, the left one
is made.  No pair spans two documents, so a document is a run of symbols, and
the expansion lengths of the symbols tell where in it any id lies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FIRST_SYMBOL = 1 << 16  # ids are below it
PAIRS = 3072  # a round; by 5 rounds 15,360 rules a block at most
ROUNDS = 5
LEAST = 6
_SLOT_BITS = 19


@dataclass
class Grammar:
    """symbols of all documents, their number by document, and the rules:
    symbol FIRST_SYMBOL + k stands for left[k], right[k]; length[k] ids."""

    symbols: np.ndarray
    count: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        out = np.ones(len(symbols), dtype=np.int64)
        rule = symbols >= FIRST_SYMBOL
        out[rule] = self.length[symbols[rule] - FIRST_SYMBOL]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols.  For many symbols the ids of every rule are laid
        out once, and each symbol takes its own."""
        if len(symbols) <= len(self.left) or not len(self.left):
            return self._undo(symbols)
        rules = self._undo(FIRST_SYMBOL + np.arange(len(self.left), dtype=symbols.dtype))
        flat = np.concatenate((np.arange(FIRST_SYMBOL, dtype=symbols.dtype), rules))
        count = np.concatenate((np.ones(FIRST_SYMBOL, dtype=np.int64), self.length))
        size = count[symbols]
        at = np.repeat((np.cumsum(count) - count)[symbols] - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        return flat[at]

    def _undo(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols: rules made last are undone first."""
        while True:
            rule = symbols >= FIRST_SYMBOL
            if not rule.any():
                return symbols
            k = symbols[rule] - FIRST_SYMBOL
            at = np.arange(len(symbols)) + np.cumsum(rule) - rule
            out = np.empty(len(symbols) + int(rule.sum()), dtype=symbols.dtype)
            out[at] = symbols
            out[at[rule]] = self.left[k]
            out[at[rule] + 1] = self.right[k]
            symbols = out

    def ids(self, document: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids begin..end of a document, expanding only the symbols that
        cover them."""
        first = int(self.count[:document].sum())
        symbols = self.symbols[first : first + int(self.count[document])]
        upto = np.cumsum(self.lengths(symbols))
        end = int(upto[-1]) if end is None and len(upto) else (end or 0)
        a, b = np.searchsorted(upto, begin, side="right"), np.searchsorted(upto, end, side="left") + 1
        skip = begin - (int(upto[a - 1]) if a else 0)
        return self.expand(symbols[a:b])[skip : skip + end - begin]


def compress(ids: np.ndarray, count: np.ndarray) -> Grammar:
    """The grammar of documents of ``count`` ids each, one after the other."""
    s = ids.astype(np.int32)
    ends = np.cumsum(count)[count > 0] - 1  # the last symbol of each document
    left, right, length = [], [], []
    made = 0
    number = np.zeros(1 << _SLOT_BITS, dtype=np.intp)  # of a chosen slot
    for _ in range(ROUNDS):
        if len(s) < 2:
            break
        code = s[:-1].view(np.uint32) * np.uint32(0x9E3779B1)
        code += s[1:].view(np.uint32) * np.uint32(0x85EBCA6B)
        slot = (code >> np.uint32(32 - _SLOT_BITS)).astype(np.intp)
        slot[ends[:-1]] = 1 << _SLOT_BITS  # spans two documents: a slot of its own
        size = np.bincount(slot, minlength=(1 << _SLOT_BITS) + 1)[:-1]
        least = max(LEAST, int(np.partition(size, -PAIRS)[-PAIRS]))
        good = np.flatnonzero(size >= least)[:PAIRS]
        chosen = np.zeros((1 << _SLOT_BITS) + 1, dtype=bool)
        chosen[good] = True
        number[good] = np.arange(len(good))
        hit = np.flatnonzero(chosen[slot])
        rank = number[slot[hit]]
        # one pair a slot, the last seen; its own count decides
        seen = np.zeros(len(good), dtype=np.intp)
        seen[rank] = hit
        a, b = s[seen], s[np.minimum(seen + 1, len(s) - 1)]
        same = (s[hit] == a[rank]) & (s[hit + 1] == b[rank])
        hit, rank = hit[same], rank[same]
        keep = np.bincount(rank, minlength=len(good)) >= LEAST
        if not keep.any():
            break
        a, b = a[keep], b[keep]
        symbol = np.where(keep, FIRST_SYMBOL + made - 1 + np.cumsum(keep), -1).astype(np.int32)
        to = symbol[rank]
        hit, to = hit[to >= 0], to[to >= 0]
        # of hits in a row every second one, from the left
        joined = np.zeros(len(hit), dtype=bool)
        joined[1:] = hit[1:] == hit[:-1] + 1
        head = np.maximum.accumulate(np.where(joined, 0, np.arange(len(hit))))
        first = (np.arange(len(hit)) - head) & 1 == 0
        hit, to = hit[first], to[first]
        size_of = np.array(length, dtype=np.int64)
        one = lambda x: np.where(x >= FIRST_SYMBOL, size_of[np.maximum(x - FIRST_SYMBOL, 0)] if made else 1, 1)  # noqa: E731, B023
        length += (one(a) + one(b)).tolist()
        left.append(a)
        right.append(b)
        made += len(a)
        s[hit] = to
        stay = np.ones(len(s), dtype=bool)
        stay[hit + 1] = False
        s = s[stay]
        ends -= np.searchsorted(hit, ends)  # hits before an end: symbols gone up to it
    none = np.zeros(0, dtype=np.int32)
    out = np.zeros(len(count), dtype=np.int64)
    out[count > 0] = np.diff(np.concatenate(([-1], ends)))
    return Grammar(
        s,
        out,
        np.concatenate(left) if left else none,
        np.concatenate(right) if right else none,
        np.array(length, dtype=np.int64),
    )
