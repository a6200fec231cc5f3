"""Quality rules: fixed counts, and robust multivariate outliers.

Each document gets a vector of transformed statistics.  A minimum-covariance-
determinant estimate of centre and scatter is made for each language and
source, over all its documents that pass the base rules.  Concentration steps
on the three quarters with the smallest distances run from three robust starts
at once (medians and quartiles with no correlation, with that of hyperbolic
tangents, with that of spatial signs); the one that ends with the smallest
determinant is kept, then comes one reweighting step.  A document is rejected
if its Mahalanobis distance to its group's estimate exceeds a chi-square
quantile.

Every step is an aggregation over the statistics (a few numbers a document)
joined with a few rows by group, salted, so a hot group is spread over
``SALTS`` tasks; the subset of a step is cut at a bin of the distances, so no
group is sorted or gathered.  Groups under ``MIN_GROUP``
documents use their language's estimate, then that of all documents; with
fewer in all, nothing is rejected by distance.

Defined cases: null and empty texts have no words, fail the base rules and
take no part in the estimates; a null language or source is a value of its
own; repeated rows count as often as they occur; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reach_package
from .docs import map_slices, materialize, mix64, with_bytes, words_of

FEATURES = ("length", "word_length", "symbols", "dup_lines", "repeats", "capitals", "digits")
# A coordinate's spread is taken as this at least: most clean texts have no
# symbol or repeated line at all, which would make the scatter singular.
LEAST_SPREAD = (0.5, 0.05, 0.35, 0.08, 0.08, 0.03, 0.03)
SHARE = 0.75
STEPS = 4
STARTS = 3
SALTS = 16
MIN_GROUP = 100
REJECT_P = 1e-6
WINDOW = 8
_P = len(FEATURES)
_X = [f"x{j}" for j in range(_P)]
_PAIRS = [(j, k) for j in range(_P) for k in range(j, _P)]
_BINS = 32  # of the distance, by octave

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_HEAD = np.ones(256, dtype=np.int64)  # first bytes of code points that are not blank
_HEAD[0x80:0xC0] = 0
_HEAD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_LETTER = _UPPER.copy()
_LETTER[97:123] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and the transformed vector."""

    def run(cols, texts):
        w = words_of(texts, lower=False)
        n_words = np.diff(w.first)
        at = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        count = lambda table: np.add.reduceat(table[w.data], at)
        chars, symbols = count(_HEAD), count(_SYMBOL)
        lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
        n_lines = np.array([len(x) for x in lines])
        dup_lines = n_lines - np.array([len(set(x)) for x in lines])
        repeats = repeated_words(w, WINDOW)
        n = np.maximum(n_words, 1)
        x = (
            np.log1p(n_words),
            np.log(np.maximum(chars, 1) / n),
            np.log1p(20 * symbols / n),
            dup_lines / np.maximum(n_lines, 1),
            repeats / n,
            count(_UPPER) / np.maximum(count(_LETTER), 1),
            count(_DIGIT) / np.maximum(chars, 1),
        )
        return {
            **cols,
            "n_words": n_words,
            "word_chars": chars,
            "n_symbols": symbols,
            "n_dup_lines": dup_lines,
            "n_repeat_words": repeats,
            "base_failed": (n_words < 20) | (100 * repeats > 30 * n_words),
            **dict(zip(_X, x)),
        }

    schema = (
        "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, "
        "n_dup_lines long, n_repeat_words long, base_failed boolean, " + ", ".join(f"{x} double" for x in _X)
    )
    return map_slices(with_bytes(docs, "doc_id", "lang", "source"), run, schema)


def repeated_words(w, size: int) -> np.ndarray:
    """By document, the words in windows of ``size`` that its text has twice."""
    doc = w.doc()
    out = np.zeros(len(w.first) - 1, dtype=np.int64)
    n = len(doc) - size + 1
    if n <= 0:
        return out
    key = w.hash[:n].copy()
    for k in range(1, size):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + w.hash[k : k + n])
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    key = mix64(key[at] + mix64(doc[at].astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(len(doc) + 1, dtype=np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + size, -1)
    np.add.at(out, doc[np.cumsum(edge[:-1]) > 0], 1)
    return out


def _group(*names: str) -> Column:
    """A group's number; a null differs from every value."""
    parts = [F.coalesce(F.col(n), F.lit("")) for n in names] + [F.col(n).isNull() for n in names]
    return F.xxhash64(F.lit(len(names)), *parts)


def with_groups(stats: DataFrame) -> DataFrame:
    """stats plus grp: the finest of (language, source), language, all that
    has enough documents; null if none has."""
    sound = stats.filter(~F.col("base_failed"))
    by_source = sound.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = by_source.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    everything = by_lang.agg(F.sum("n_lang").alias("n_all"))
    level = (
        by_source.join(by_lang.withColumnRenamed("lang", "l"), F.expr("lang <=> l"))
        .join(F.broadcast(everything))  # one row
        .select(
            F.col("lang").alias("l"),
            F.col("source").alias("s"),
            F.when(F.col("n") >= MIN_GROUP, _group("lang", "source"))
            .when(F.col("n_lang") >= MIN_GROUP, _group("lang"))
            .when(F.col("n_all") >= MIN_GROUP, F.lit(0))
            .alias("grp"),
        )
    )
    return stats.join(level, F.expr("lang <=> l AND source <=> s"), "left").drop("l", "s")


def in_pools(rows: DataFrame) -> DataFrame:
    """Each sound document once by group that it helps to estimate: its own
    source's, its language's, all."""
    pools = F.array(_group("lang", "source"), _group("lang"), F.lit(0).cast("long"))
    used = rows.select("grp").filter("grp IS NOT NULL").distinct()
    sound = rows.filter(~F.col("base_failed")).withColumn("grp", F.explode(pools)).select("grp", *_X)
    return meet(_salted(sound), used)


def distance(model: str = "prec") -> Column:
    """Squared Mahalanobis distance of x to mean under the precision matrix."""
    d = [F.col(x) - F.get("mean", F.lit(j)) for j, x in enumerate(_X)]
    total = F.lit(0.0)
    for j, k in _PAIRS:
        term = d[j] * d[k] * F.get(model, F.lit(j * _P + k))
        total = total + (term if j == k else term * 2)
    return total


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(*[c for c in _X if c in rows.columns]), F.lit(SALTS)))


def meet(rows: DataFrame, model: DataFrame, how: str = "inner") -> DataFrame:
    """Salted rows with the model rows of their group."""
    each = model.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    return rows.join(each, ["grp", "salt"], how)


def estimate(pooled: DataFrame) -> DataFrame:
    """grp, mean, prec by minimum covariance determinant."""
    pooled = _salted(pooled)
    model = materialize(_starts(pooled), "mcd-start")
    inner = chi2_quantile(SHARE, _P)
    scale = SHARE / chi2_cdf(inner, _P + 2)
    for step in range(STEPS):
        placed = meet(pooled, model).withColumn("bin", _bin(distance()))
        bins = placed.groupBy("grp", "start", "bin").count()
        run = Window.partitionBy("grp", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy("grp", "start")
        cut = (
            bins.withColumn("upto", F.sum("count").over(run))
            .withColumn("n", F.sum("count").over(whole))
            .filter(F.col("upto") >= F.col("n") * SHARE)
            .groupBy("grp", "start")
            .agg(F.min("bin").alias("cut"))
        )
        # the cut goes to the rows with the model, of which it is part
        near = meet(pooled, model.join(cut, ["grp", "start"])).filter(_bin(distance()) <= F.col("cut"))
        model = materialize(_moments(near, scale), f"mcd-step-{step}")
    least = F.min(F.struct("logdet", "start", "mean", "prec")).alias("m")
    model = model.groupBy("grp").agg(least).select("grp", "m.start", "m.mean", "m.prec")
    # reweighting: all documents within the 97.5 % quantile
    rim = chi2_quantile(0.975, _P)
    near = meet(pooled, model).filter(distance() <= rim)
    final = _moments(near, 0.975 / chi2_cdf(rim, _P + 2)).select("grp", "mean", "prec")
    return materialize(final, "mcd-final")


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(F.greatest(d2, F.lit(2.0**-10))) * _BINS).cast("int")


def _start(pooled: DataFrame) -> DataFrame:
    """Medians, and spreads from quartiles, of binned coordinates."""
    step = [s / 16 for s in LEAST_SPREAD]
    cells = F.array(
        *[F.struct(F.lit(j).alias("j"), F.round(F.col(x) / step[j]).cast("long").alias("v")) for j, x in enumerate(_X)]
    )
    counts = pooled.select("grp", F.explode(cells).alias("c")).groupBy("grp", "c.j", "c.v").count()
    run = Window.partitionBy("grp", "j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("grp", "j")
    ranked = counts.withColumn("upto", F.sum("count").over(run)).withColumn("n", F.sum("count").over(whole))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("n") * q, F.col("v")))
    quart = ranked.groupBy("grp", "j").agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"))
    size = F.element_at(F.array(*[F.lit(s) for s in step]), F.col("j") + 1)
    least = F.element_at(F.array(*[F.lit(s) for s in LEAST_SPREAD]), F.col("j") + 1)
    one = quart.select(
        "grp",
        F.struct(
            "j",
            (F.col("mid") * size).alias("mid"),
            F.greatest((F.col("hi") - F.col("lo")) * size / 1.349, least).alias("sd"),
        ).alias("q"),
    )
    return one.groupBy("grp").agg(F.sort_array(F.collect_list("q")).alias("q")).select(  # one entry by coordinate
        "grp", F.col("q.mid").alias("mean"), F.col("q.sd").alias("sd")
    )


def _starts(pooled: DataFrame) -> DataFrame:
    """grp, start, mean, prec: the medians, with the spreads under no
    correlation and under two robust ones."""
    centre = materialize(_start(pooled), "mcd-centre")
    z = [(F.col(x) - F.get("mean", F.lit(j))) / F.get("sd", F.lit(j)) for j, x in enumerate(_X)]
    placed = meet(pooled, centre).select("grp", "mean", "sd", *[c.alias(f"z{j}") for j, c in enumerate(z)])
    norm = F.sqrt(sum(F.col(f"z{j}") * F.col(f"z{j}") for j in range(_P)))
    sign = [F.when(norm > 0, F.col(f"z{j}") / norm).otherwise(0.0) for j in range(_P)]
    bent = [F.tanh(f"z{j}") for j in range(_P)]
    product = lambda v: F.array(*[F.sum(v[j] * v[k]) for j, k in _PAIRS])
    sums = placed.groupBy("grp").agg(
        F.first("mean").alias("mean"), F.first("sd").alias("sd"), product(bent).alias("bent"), product(sign).alias("sign")
    )
    reach_package(pooled.sparkSession)

    def invert(frames):
        for f in frames:
            out = []
            for grp, mean, sd, *both in zip(f["grp"], f["mean"], f["sd"], f["bent"], f["sign"]):
                for start, s2 in enumerate((None, *both)):
                    r = np.eye(_P)
                    if s2 is not None:
                        for (j, k), v in zip(_PAIRS, s2):
                            r[j, k] = r[k, j] = v
                        spread = np.sqrt(np.diag(r))
                        spread[spread == 0] = 1.0  # a coordinate without any spread is uncorrelated
                        r = 0.95 * r / np.outer(spread, spread)
                        r[np.diag_indices(_P)] = 1.0
                    prec = np.linalg.inv(np.outer(sd, sd) * r)
                    out.append((grp, start, list(mean), prec.ravel().tolist()))
            yield type(f)(out, columns=["grp", "start", "mean", "prec"])

    return sums.mapInPandas(invert, "grp long, start int, mean array<double>, prec array<double>")


def _moments(near: DataFrame, scale: float) -> DataFrame:
    """Centre, inverse scatter and log determinant of the scatter, by group
    and start.  Moments are taken about the step's own centre, so that no
    digits are lost."""
    d = [F.col(x) - F.get("mean", F.lit(j)) for j, x in enumerate(_X)]
    sums = near.groupBy("grp", "start").agg(
        F.count("*").alias("n"),
        F.first("mean").alias("mean"),
        F.array(*[F.sum(c) for c in d]).alias("s1"),
        F.array(*[F.sum(d[j] * d[k]) for j, k in _PAIRS]).alias("s2"),
    )
    reach_package(near.sparkSession)
    least = np.square(LEAST_SPREAD)

    def invert(frames):
        for f in frames:
            means, precs, dets = [], [], []
            for n, mean, s1, s2 in zip(f["n"], f["mean"], f["s1"], f["s2"]):
                shift = np.asarray(s1) / n
                cov = np.zeros((_P, _P))
                for (j, k), v in zip(_PAIRS, s2):
                    cov[j, k] = cov[k, j] = v / n
                cov = (cov - np.outer(shift, shift)) * scale
                cov[np.diag_indices(_P)] += np.maximum(0, least - np.diag(cov))
                means.append((np.asarray(mean) + shift).tolist())
                precs.append(np.linalg.inv(cov).ravel().tolist())
                dets.append(float(np.linalg.slogdet(cov)[1]))
            yield f[["grp", "start"]].assign(mean=means, prec=precs, logdet=dets)

    return sums.mapInPandas(
        invert, "grp long, start int, mean array<double>, prec array<double>, logdet double"
    )


def chi2_cdf(x: float, p: int) -> float:
    a, z = p / 2, x / 2
    term = total = math.exp(-z + a * math.log(z) - math.lgamma(a + 1))
    for i in range(1, 1000):
        term *= z / (a + i)
        total += term
        if term < 1e-18 * total:
            break
    return total


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 1e-9, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, p) < q else (lo, mid)
    return (lo + hi) / 2


def judge(docs: DataFrame, reject_p: float = REJECT_P) -> DataFrame:
    """One row per document: the base counts, base_failed, kept, distance2."""
    rows = materialize(statistics(docs), "rules-stats")
    rows = materialize(with_groups(rows), "rules-groups")
    model = estimate(in_pools(rows))
    limit = chi2_quantile(1 - reject_p, _P)
    return (
        meet(_salted(rows), model, "left")
        .withColumn("distance2", distance())
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= limit))
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            "kept",
            "distance2",
        )
    )
