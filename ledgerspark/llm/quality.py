"""Quality classifier: support vectors over Naive Bayes features.

A document is the set of its n-grams: one and two words, and one to three word
shapes (case, digits, symbols, length, last sign, repeat of the word before),
hashed to ``BUCKETS``.  Each indicator is scaled by the log ratio of its class
counts, rows are brought to unit length, and a linear hinge-loss model is fit
by dual coordinate descent.

The model is fit on a sample of the labels, chosen by hash: class counts are
taken over ``LABEL_ROWS`` labelled documents, so the labels that are joined
with the documents have a fixed bound and no text is shuffled, and the dual
coordinate descent runs in one task over ``FIT_ROWS`` of them, which bounds its
time and memory.  One row in ``CALIBRATE_ONE_IN`` of those is set aside to turn
margins into probabilities.  With fewer labels all are used.

Defined cases: null and empty texts have no n-grams and get the score of the
bias alone; documents without a label, with several different ones or with a
null one are not learned from; without labels of both classes every score is
the share of the class that there is, or 0.5; repeated rows get equal scores;
other columns, whatever their names, are no inputs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reach_package
from .docs import map_slices, materialize, mix64, slices, with_bytes, words_of

BUCKETS = 1 << 17
LABEL_ROWS = 16_000
FIT_ROWS = 8_000
CALIBRATE_ONE_IN = 5
EPOCHS = 12
PENALTY = 4.0
SMOOTHING = 1.0

_IS = np.zeros((5, 256), dtype=np.int64)  # upper, lower or non-ASCII, digit, symbol, other sign
_IS[0, 65:91] = 1
_IS[1, 97:123] = 1
_IS[1, 128:] = 1
_IS[2, 48:58] = 1
_IS[3, list(b"#*$%&|<>~^\\{}[]=_@+")] = 1
_IS[4] = 1 - _IS[:4].sum(axis=0)
_LAST = np.full(256, 5, dtype=np.int64)
for _i in range(4):
    _LAST[_IS[_i] > 0] = _i
_LAST[[0x2E, 0x2C]] = 4


@dataclass
class Model:
    """Weight by bucket (ratio times hinge weight), squared ratio by bucket,
    bias, and the slope and offset that make a margin a log-odds."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float


def held_out(doc_id: str | Column = "doc_id", parts: int = 3, rest: int = 1) -> Column:
    """Whether crc32(doc_id as text) has remainder ``rest``; never null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts == rest, F.lit(False))


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, one after the other, and the offsets."""
    w = words_of(texts, lower=True)
    raw = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    n = len(w.start)
    doc = w.doc()
    length = w.end - w.start
    has = []
    for kind in _IS:
        total = np.concatenate(([0], np.cumsum(kind[raw])))
        has.append(total[w.end] - total[w.start])
    again = np.zeros(n, dtype=np.int64)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    level = lambda c: (c > 0).astype(np.int64) + (c == length)  # noqa: E731  none, some, all
    shape = level(has[0])
    for part, size in (
        (level(has[2]), 3),
        (level(has[3]), 3),
        (np.minimum(has[4], 2), 3),
        (_LAST[raw[w.end - 1]] if n else length, 6),
        (np.searchsorted([2, 4, 8, 14], length), 5),
        (again, 2),
    ):
        shape = shape * size + part
    shape = mix64(shape.astype(np.uint64) + np.uint64(1 << 40))
    grams = [w.hash, _chain(w.hash, 2), shape, _chain(shape, 2), _chain(shape, 3)]
    flags = np.zeros(BUCKETS, dtype=bool)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        for k, g in enumerate(grams):
            size = (0, 1, 0, 1, 2)[k]
            flags[g[a : max(a, b - size)] & np.uint64(BUCKETS - 1)] = True
        own = np.flatnonzero(flags).astype(np.int32)
        flags[own] = False
        out.append(own)
    where = np.cumsum([0] + [len(x) for x in out])
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.int32)), where


def _chain(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` neighbours; the last places hold no whole n-gram."""
    out = h.copy()
    for k in range(1, size):
        out[: len(h) - k] = mix64(out[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:] + np.uint64(size))
    return out


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model of labelled documents: text and label (0 or 1)."""
    rows = labelled.filter("label IN (0, 1)")
    counts = rows.groupBy("label").count().collect()  # two rows at most
    n = {r["label"]: r["count"] for r in counts}
    if len(n) < 2:
        share = 0.5 if not n else float(next(iter(n)))
        odds = {0.0: -20.0, 0.5: 0.0, 1.0: 20.0}[share]
        none = np.zeros(BUCKETS, dtype=np.float32)
        return Model(none, none, 0.0, 0.0, odds)
    ratio = _log_ratios(rows)
    part = min(1.0, fit_rows / sum(n.values()))
    chosen = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(part * (1 << 20)))
    reach_package(labelled.sparkSession)

    def descend(batches):
        idx, y = [], []
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                flat, where = ngrams(texts[a:b])
                idx += np.split(flat, where[1:-1])
            y += batch.column("label").to_pylist()
        w, bias, slope, offset = _train(idx, np.array(y), ratio)
        yield pa.RecordBatch.from_pydict(
            {"w": [w.astype("<f4").tobytes()], "bias": [bias], "slope": [slope], "offset": [offset]}
        )

    # one task on purpose: the sample is bounded by fit_rows
    row = (
        with_bytes(chosen, "label")
        .withColumn("label", F.col("label").cast("int"))
        .coalesce(1)
        .mapInArrow(descend, "w binary, bias double, slope double, offset double")
        .first()
    )
    w = np.frombuffer(bytes(row["w"]), dtype="<f4")
    return Model(
        (w * ratio).astype(np.float32), np.square(ratio).astype(np.float32), row["bias"], row["slope"], row["offset"]
    )


def _log_ratios(rows: DataFrame) -> np.ndarray:
    """log((p/|p|)/(q/|q|)) of the class counts; each task sums its own rows
    first, and the result has ``BUCKETS`` entries whatever the input."""
    reach_package(rows.sparkSession)

    def count(batches):
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            label = batch.column("label").to_numpy()
            for a, b in slices(texts):
                flat, where = ngrams(texts[a:b])
                y = np.repeat(label[a:b], np.diff(where))
                for k in (0, 1):
                    total[k] += np.bincount(flat[y == k], minlength=BUCKETS)
        used = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_pydict(
            {"bucket": pa.array(used, pa.int32()), "q": pa.array(total[0][used]), "p": pa.array(total[1][used])}
        )

    parts = with_bytes(rows, F.col("label").cast("int").alias("label")).mapInArrow(
        count, "bucket int, q long, p long"
    )
    sums = parts.groupBy("bucket").agg(F.sum("q").alias("q"), F.sum("p").alias("p")).toPandas()
    p, q = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    p[sums["bucket"]] += sums["p"]
    q[sums["bucket"]] += sums["q"]
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    seen = np.zeros(BUCKETS, dtype=bool)
    seen[sums["bucket"]] = True
    return np.where(seen, ratio, 0.0)


def _train(idx: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """Dual coordinate descent on the hinge loss; margins of the rows set
    aside give the slope and offset of the log-odds."""
    rng = np.random.default_rng(7)
    # an order that does not depend on how the rows were read
    order = sorted(range(len(idx)), key=lambda i: (len(idx[i]), int(idx[i].sum()), int(y[i])))
    order = [order[i] for i in rng.permutation(len(order))]
    rows = [idx[i] for i in order]
    sign = np.where(y[order] == 1, 1.0, -1.0)
    values = []
    for x in rows:
        v = ratio[x]
        values.append(v / max(math.sqrt(float(v @ v)), 1e-12))
    aside = np.arange(len(rows)) % CALIBRATE_ONE_IN == 0
    learn = np.flatnonzero(~aside)
    # both classes weigh the same in all
    cost = PENALTY * np.where(sign > 0, 0.5 / max((sign > 0).mean(), 1e-9), 0.5 / max((sign < 0).mean(), 1e-9))
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            x, v, s = rows[i], values[i], sign[i]
            gradient = s * (float(w[x] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / (float(v @ v) + 1.0), 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * s
                w[x] += step * v
                bias += step
                alpha[i] = new
    check = np.flatnonzero(aside)
    margin = np.array([float(w[rows[i]] @ values[i]) + bias for i in check])
    slope, offset = _log_odds(margin, sign[check] > 0)
    return w, float(bias), slope, offset


def _log_odds(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the class on the margin, by Newton steps, with
    a weak pull to slope 2 and offset 0 that keeps it finite."""
    slope, offset, pull = 2.0, 0.0, 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        r = p * (1 - p)
        g = np.array([np.sum((p - good) * margin) + pull * (slope - 2), np.sum(p - good) + pull * offset])
        h = np.array([[np.sum(r * margin**2) + pull, np.sum(r * margin)], [np.sum(r * margin), np.sum(r) + pull]])
        d = np.linalg.solve(h, g)
        slope, offset = slope - d[0], offset - d[1]
        if np.abs(d).max() < 1e-9:
            break
    return float(slope), float(offset)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """row (a struct of all columns of docs) and score."""

    def run(cols, texts):
        flat, where = ngrams(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(where))
        dot = np.bincount(doc, weights=model.weight[flat], minlength=len(texts))
        norm = np.sqrt(np.bincount(doc, weights=model.square[flat], minlength=len(texts)))
        odds = model.slope * (dot / np.maximum(norm, 1e-12) + model.bias) + model.offset
        return {"row": cols["row"], "score": 1 / (1 + np.exp(-np.clip(odds, -700, 700)))}

    rows = docs.select(F.struct("*").alias("row"), "text")
    kind = docs.schema.simpleString()
    return map_slices(with_bytes(rows, "row"), run, f"row {kind}, score double")


def labelled_rows(docs: DataFrame, labels: DataFrame, column: str = "quality", bound: int = LABEL_ROWS) -> DataFrame:
    """text and label of the documents to learn from, about ``bound`` at most."""
    sure = (
        labels.filter(~held_out())
        .groupBy("doc_id")
        .agg(F.min(column).alias("label"), F.max(column).alias("other"))
        .filter("label = other")
        .select("doc_id", "label")
    )
    part = int(min(1.0, bound / max(sure.count(), 1)) * (1 << 20))
    chosen = sure.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part)
    # the hint is safe: chosen has about ``bound`` rows of two numbers
    learn = docs.filter(~held_out()).select("doc_id", "text")
    return materialize(learn.join(F.broadcast(chosen), "doc_id").select("text", "label"), "quality-labelled")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(labelled_rows(docs, labels))
    return score(docs.select("doc_id", "text"), model).select(
        "row.doc_id",
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, all columns."""
    model = fit(labelled_rows(docs, labels))
    return score(docs, model).filter("score >= 0.5").select("row.*")
