"""Fill-in-the-middle transformation with an indexable skip list.

A text is a sequence of units (lines).  Two ranks drawn from the document's id
cut it into prefix, middle and suffix, which are written in one of two orders
behind markers.  The places of the cuts come from a skip list over the units:
every link of every lane carries its width in units, code points and bytes.
A descent from the top lane takes each link that does not pass the rank and
adds up its widths, so it ends at the rank with the exact code point (and
byte) at which the cut falls.

The skip lists of a slice of documents are built and searched together, as
arrays by lane.  No shuffle; a task holds one slice (or one longer text).

Defined cases: a null text is empty; an empty text, and one that contains a
marker, stays as it is (form ``plain``); a null doc_id is drawn as the empty
number; equal rows give equal results; an empty table gives no rows; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .docs import map_slices, mix64

SEED = 7
FIM_PERCENT = 100  # share of documents that are transformed
SPM_PERCENT = 50  # share of those with the suffix first
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LANE_BITS = 2  # a node of a lane is also in the next one with a chance of 1/4

_NEVER = np.iinfo(np.int64).max // 2


@dataclass
class Lane:
    """The nodes of one lane, all documents in a row: a document's first node
    stands before its first unit, its last one behind its last unit."""

    units: np.ndarray  # widths of the link to the next node
    points: np.ndarray
    size: np.ndarray  # bytes
    down: np.ndarray  # the same node's place in the lane below
    head: np.ndarray  # each document's first node


class SkipLists:
    """One indexable skip list for each document of a slice."""

    def __init__(self, n_units: np.ndarray, points: np.ndarray, size: np.ndarray):
        """n_units by document; code points and bytes by unit."""
        nodes = n_units + 1
        head = np.concatenate(([0], np.cumsum(nodes)[:-1])).astype(np.int64)
        total = int(nodes.sum())
        tail = head + n_units
        is_link = np.ones(total, dtype=bool)
        is_link[tail] = False
        lane = Lane(np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64), None, head)
        lane.units[is_link], lane.points[is_link], lane.size[is_link] = 1, points, size
        lane.units[tail] = _NEVER
        # heights from the node's rank; ends of a document are in every lane
        rank = np.arange(total, dtype=np.int64) - np.repeat(head, nodes)
        draw = mix64(rank.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        ends = ~is_link
        ends[head] = True
        self.lanes = [lane]
        while True:
            level = len(self.lanes)
            bits = np.uint64((1 << (LANE_BITS * level)) - 1)
            up = np.flatnonzero(((draw & bits) == 0) | ends)
            if len(up) == len(draw):
                break
            below = self.lanes[-1]
            at = np.zeros(len(draw), np.int64)
            at[up] = np.arange(len(up))
            # a link's width is the sum of the links it passes over; the
            # sums that start at a document's end hold nothing but its mark
            self.lanes.append(
                Lane(*(np.add.reduceat(w, up) for w in (below.units, below.points, below.size)), up, at[below.head])
            )
            draw, ends = draw[up], ends[up]

    def locate(self, doc: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code points, bytes) before the unit of each rank in each document."""
        top = self.lanes[-1]
        at = top.head[doc]
        units, points, size = (np.zeros(len(doc), np.int64) for _ in range(3))
        for level in range(len(self.lanes) - 1, -1, -1):
            lane = self.lanes[level]
            moving = np.arange(len(doc))
            while len(moving):
                here = at[moving]
                moving = moving[units[moving] + lane.units[here] <= rank[moving]]
                here = at[moving]
                units[moving] += lane.units[here]
                points[moving] += lane.points[here]
                size[moving] += lane.size[here]
                at[moving] += 1
            if lane.down is not None:
                at = lane.down[at]
        return points, size


def line_lists(texts: list[bytes]) -> tuple[np.ndarray, SkipLists]:
    """Lines by document, and their skip lists.  A line ends with its line
    break; the last one may lack it."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    end = np.cumsum(sizes)
    last = np.zeros(len(data) + 1, dtype=bool)  # the last byte of a line
    last[: len(data)] = data == 0x0A
    last[end[sizes > 0] - 1] = True
    stop = np.flatnonzero(last[: len(data)]) + 1
    start = np.concatenate(([0], stop[:-1]))[: len(stop)]
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    n_units = np.diff(np.searchsorted(stop, np.concatenate(([0], end)), side="right"))
    return n_units, SkipLists(n_units, before[stop] - before[start], stop - start)


def _draw(group: int) -> Column:
    """The n-th group of eight hexadecimal digits of the id's digest."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars
    (null if plain) and output, one row by document."""
    text = F.coalesce("text", F.lit(""))
    plain = (text == "") | (_draw(3) % 100 >= fim_percent)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | text.contains(marker)
    form = F.when(plain, "plain").when(_draw(4) % 100 < spm_percent, "spm").otherwise("psm")
    drawn = docs.select(
        "doc_id", form.alias("form"), _draw(1).alias("h1"), _draw(2).alias("h2"), text.cast("binary").alias("text")
    )
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(cols, texts):
        n, lists = line_lists(texts)
        form = cols["form"].to_pylist()
        cut = np.flatnonzero(np.array([f != "plain" for f in form], dtype=bool))
        h1, h2 = (cols[h].to_numpy()[cut] % (n[cut] + 1) for h in ("h1", "h2"))
        low, low_at = lists.locate(cut, np.minimum(h1, h2))
        high, high_at = lists.locate(cut, np.maximum(h1, h2))
        out, prefix, middle = list(texts), [None] * len(texts), [None] * len(texts)
        for i, a, b, ca, cb in zip(*(x.tolist() for x in (cut, low_at, high_at, low, high))):
            t = texts[i]
            parts = (p, t[:a], s, t[b:], m, t[a:b]) if form[i] == "psm" else (s, t[b:], p, t[:a], m, t[a:b])
            out[i], prefix[i], middle[i] = b"".join(parts), ca, cb - ca
        return {
            "doc_id": cols["doc_id"], "n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle, "output": out
        }

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
    return map_slices(drawn, run, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The exact text, from what ``transform`` wrote alone.  A marker's only
    ``<`` is its first character, so no marker begins inside another one or
    across a border, and the first one found of a kind is the one written."""
    body = F.col(output).substr(F.lit(len(PREFIX) + 1), F.length(output))
    head = F.substring_index(body, MIDDLE, 1)
    middle = body.substr(F.length(head) + len(MIDDLE) + 1, F.length(body))
    at = F.when(F.col(form) == "psm", F.locate(SUFFIX, head)).otherwise(F.locate(PREFIX, head))
    left, right = head.substr(F.lit(1), at - 1), head.substr(at + len(SUFFIX), F.length(head))
    return (
        F.when(F.col(form) == "plain", F.col(output))
        .when(F.col(form) == "psm", F.concat(left, middle, right))
        .otherwise(F.concat(right, middle, left))
    )
