import random
import zlib
from collections import Counter

import numpy as np

from ledgerspark.llm import quality, rules

from .helpers import WORD, documents, odd_texts, prose


def sample_texts(n, seed=1):
    """Clean prose, and junk: symbols or capitals; label 0 for junk."""
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        t = prose(rng, rng.randrange(30, 200), 3000).capitalize() + "."
        bad = rng.random() < 0.2
        if bad:
            t = " ".join(w + rng.choice(["###", "%%%", "!!"]) for w in t.split()) if rng.random() < 0.5 else t.upper()
        texts.append(t)
        labels.append(0 if bad else 1)
    return texts, labels


def test_held_out_accuracy_and_inputs(spark):
    texts, labels = sample_texts(700)
    df = documents(spark, texts, sources=[f"s{x}" for x in labels])
    lab = spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int").withColumnRenamed("q", "q")
    rows = quality.classify(df, lab).collect()
    out = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"]]
    assert sum(p == y for p, y in out) >= 0.97 * len(out)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    # labels of held-out rows, and other columns, change nothing
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in enumerate(labels)]
    flipped = quality.classify(
        documents(spark, texts), spark.createDataFrame(other, "doc_id long, quality int")
    ).collect()
    assert {r["doc_id"]: round(r["score"], 9) for r in flipped} == {r["doc_id"]: round(r["score"], 9) for r in rows}


def test_odd_rows_and_labels(spark):
    texts, labels = sample_texts(200, 2)
    texts += odd_texts()
    ids = list(range(len(texts)))
    ids[-1] = ids[-2] = None
    df = documents(spark, texts, ids=ids)
    lab = [(i, y) for i, y in enumerate(labels)] + [(0, 1 - labels[0]), (5, labels[5]), (7, None), (None, 1), (10**9, 0)]
    lab = spark.createDataFrame(lab, "doc_id long, quality int")
    rows = quality.classify(df, lab).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
    good = quality.keep_good(df, lab)
    assert good.columns == df.columns and good.count() == sum(r["predicted"] for r in rows)
    one = quality.classify(df, lab.filter("quality = 1"))
    assert {r["predicted"] for r in one.collect()} == {1}
    none = quality.classify(df, lab.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.classify(df.limit(0), lab).count() == 0


def test_dual_descent_reaches_the_margin():
    rng = np.random.default_rng(0)
    idx = [np.unique(rng.integers(0, 50, 12)) + (0 if i % 2 else 40) for i in range(200)]
    y = np.arange(200) % 2
    ratio = np.where(np.arange(quality.BUCKETS) < 45, 1.0, -1.0)
    w, bias, slope, offset = quality._train([x.astype(np.int32) for x in idx], y, ratio)
    margin = np.array([w[x] @ ratio[x] / np.sqrt(len(x)) + bias for x in idx])
    assert ((margin > 0) == (y == 1)).mean() > 0.97 and slope > 0


def base_counts(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(w)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed


def test_base_counts_equal_brute_force(spark):
    texts = odd_texts() + ["a\na\n \n a\na", "q " * 8 + "r " * 9, "#*$%&|<> é", " ".join("abcdefgh" * 2)]
    got = {r["doc_id"]: tuple(r)[1:7] for r in rules.judge(documents(spark, texts)).collect()}
    assert got == {i: base_counts(t) for i, t in enumerate(texts)}


def test_outliers_go_and_clean_stay(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(40, 300), 3000) for _ in range(600)]
    bad = [" ".join(w + "###" for w in prose(rng, 80, 3000).split()) for _ in range(40)]
    sources = [rng.choice(["a", "a", "b", None]) for _ in texts + bad]
    langs = [rng.choice(["en", None]) for _ in texts + bad]
    rows = rules.judge(documents(spark, texts + bad, sources=sources, langs=langs)).collect()
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert sum(kept[i] for i in range(600)) >= 594 and not any(kept[i] for i in range(600, 640))


def test_estimate_is_close_to_the_clean_scatter(spark):
    """Contaminated normal data: centre and scatter of the clean part."""
    rng = np.random.default_rng(4)
    p = len(rules.FEATURES)
    a = rng.normal(size=(p, p)) + 2 * np.eye(p)
    clean = rng.normal(size=(4000, p)) @ a.T
    x = np.vstack([clean, rng.normal(60, 1, size=(800, p))])
    rows = spark.createDataFrame([(0, *map(float, r)) for r in x], "grp long, " + ", ".join(f"{c} double" for c in rules._X))
    row = rules.estimate(rows).first()
    cov = np.linalg.inv(np.array(row["prec"]).reshape(p, p))
    want = np.cov(clean.T)
    assert np.abs(np.array(row["mean"]) - clean.mean(axis=0)).max() < 0.3
    assert np.abs(cov - want).max() < 0.12 * np.abs(want).max()


def test_few_or_no_rows(spark):
    few = rules.judge(documents(spark, [prose(random.Random(1), 40)] * 3)).collect()
    assert all(r["kept"] for r in few)
    assert rules.judge(documents(spark, ["x"]).limit(0)).count() == 0


def test_chi_square():
    assert abs(rules.chi2_quantile(0.95, 7) - 14.067) < 1e-3 and abs(rules.chi2_cdf(2.0, 2) - 0.6321205588) < 1e-9


def concentrate(x, mean, prec, steps=60):
    """Exact concentration steps to the end: the log determinant reached."""
    h = -(-len(x) * 3 // 4)
    for _ in range(steps):
        d = x - mean
        near = x[np.argsort(np.einsum("ij,jk,ik->i", d, prec, d), kind="stable")[:h]]
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True)
        prec = np.linalg.inv(cov)
    return np.linalg.slogdet(cov)[1]


def test_the_start_with_the_smallest_determinant_wins(spark):
    """Correlated data with outliers that look normal in every coordinate: the
    estimate's determinant is that of exact steps from the best of many starts."""
    rng = np.random.default_rng(8)
    p = len(rules.FEATURES)
    base = rng.normal(size=(3000, 1)) * 5
    clean = base + rng.normal(0, 0.6, size=(3000, p))
    bad = rng.normal(0, 5, size=(500, p))
    x = np.vstack([clean, bad])
    rows = spark.createDataFrame([(0, *map(float, r)) for r in x], "grp long, " + ", ".join(f"{c} double" for c in rules._X))
    starts = {r["start"]: r for r in rules._starts(rules._salted(rows)).collect()}
    assert sorted(starts) == list(range(rules.STARTS))
    best = min(concentrate(x, np.array(r["mean"]), np.array(r["prec"]).reshape(p, p)) for r in starts.values())
    for _ in range(20):
        some = x[rng.choice(len(x), 3 * p, replace=False)]
        best = min(best, concentrate(x, some.mean(axis=0), np.linalg.inv(np.cov(some.T))))
    row = rules.estimate(rows).first()
    mean, prec = np.array(row["mean"]), np.array(row["prec"]).reshape(p, p)
    assert abs(concentrate(x, mean, prec) - best) < 0.05
    d = x - mean
    far = np.einsum("ij,jk,ik->i", d, prec, d) > rules.chi2_quantile(1 - rules.REJECT_P, p)
    assert far[:3000].sum() <= 3 and far[3000:].mean() > 0.95


def test_groups_have_estimates_of_their_own(spark):
    rng = np.random.default_rng(9)
    p = len(rules.FEATURES)
    rows = [(g, *map(float, r)) for g in (1, 2, 3) for r in rng.normal(10 * g, g, size=(400, p))]
    df = spark.createDataFrame(rows, "grp long, " + ", ".join(f"{c} double" for c in rules._X)).repartition(5)
    got = {r["grp"]: r for r in rules.estimate(df).collect()}
    assert sorted(got) == [1, 2, 3]
    for g, r in got.items():
        assert np.abs(np.array(r["mean"]) - 10 * g).max() < 0.4 * g
