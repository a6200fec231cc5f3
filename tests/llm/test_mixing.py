import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import mixing

from .helpers import WORD, documents, odd_texts, prose


def water_fill(sizes, weights=(5, 2, 1), cap=3.0):
    """sizes by source, in order: targets by resharing until none is above."""
    total, names = sum(sizes.values()), list(sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed = {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left, weight = total - sum(fixed.values()), sum(w[s] for s in open_)
        target = {s: left * w[s] / weight for s in open_}
        above = [s for s in open_ if target[s] > cap * sizes[s]]
        if not above:
            return fixed | target
        fixed |= {s: cap * sizes[s] for s in above}


def check(spark, texts, sources, ids=None, slack=None):
    df = documents(spark, texts, sources=sources, ids=ids)
    rows = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    sizes = {}
    for t, s in zip(texts, sources):
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    sizes = {s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, (s or "").encode()))}
    want, taken = water_fill(sizes), {s: 0 for s in sizes}
    assert len(rows) == len(texts)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] % max(r["size"], 1) == 0 and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    units = {}  # equal rows are taken or left together
    for i, t, s in zip(range(len(texts)) if ids is None else ids, texts, sources):
        units[s, i, t] = units.get((s, i, t), 0) + len(WORD.findall(t or ""))
    for s in sizes:
        largest = max(n for (x, _, _), n in units.items() if x == s)
        assert abs(taken[s] - want[s]) <= (largest if slack is None else max(2, slack * want[s])), (s, taken, want)
    return rows


def test_many_sources(spark):
    rng = random.Random(1)
    sources = [rng.choice(["a", "b", "hot", "hot", "hot", None, "Z", "é", "😀", ""]) for _ in range(900)]
    texts = [prose(rng, 1 + int(rng.expovariate(0.02))) for _ in sources]
    check(spark, texts, sources, slack=0.02)


def test_capped_sources_and_empty_ones(spark):
    rng = random.Random(2)
    texts = [prose(rng, 10) for _ in range(40)] + ["", None, "one"]
    check(spark, texts, ["big"] * 40 + ["none", "none", "small"])


def test_odd_texts_repeated_rows_and_null_ids(spark):
    texts = odd_texts()
    check(spark, texts + texts, ["s", None] * len(texts), ids=[None, 3] * len(texts))


def test_no_words_and_no_rows(spark):
    df = documents(spark, ["", None, " "], sources=["a", "b", None])
    assert [(r["target"], r["taken"]) for r in mixing.mix(df).collect()] == [(0.0, 0)] * 3
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.repeat(df.limit(0)).count() == 0


def test_bands_of_a_larger_budget_hold_the_smaller(spark):
    """The first band's threshold grows with the budget."""
    rng = random.Random(3)
    df = documents(spark, [prose(rng, 20) for _ in range(200)], sources=["a"] * 100 + ["b"] * 100)
    sizes = mixing.sized(df)
    below = []
    for part in (0.2, 0.5, 0.9):
        targets = sizes.groupBy("source").sum("size").toDF("source", "source_size")
        plan = mixing.thresholds(sizes, targets.selectExpr("source", "source_size", f"source_size * {part} target"))
        below.append([r["bands"][0]["below"] for r in plan.orderBy("source").collect()])
    assert below == sorted(below) and below[0] < below[1] < below[2]


def test_repeat_returns_rows_as_often_as_taken(spark):
    rng = random.Random(4)
    df = documents(spark, [prose(rng, 15) for _ in range(60)], sources=[f"s{i % 4}" for i in range(60)])
    taken = {r["doc_id"]: r["n_passes"] for r in mixing.mix(df).collect()}
    rows = mixing.repeat(df)
    assert rows.columns == df.columns
    got = {}
    for r in rows.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in taken.items() if v}


def test_capped_source_of_many_documents(spark):
    """Three whole passes over each document, and no fourth over any."""
    rng = random.Random(5)
    texts = [prose(rng, 10) for _ in range(2000)] + [prose(rng, 30_000) for _ in range(20)]
    rows = check(spark, texts, ["small"] * 2000 + ["big"] * 20)
    assert {r["n_passes"] for r in rows if r["source"] == "small"} == {3}


def taken_of(spark, sizes_of, target):
    """Words taken of one source for a target given in words."""
    rng = random.Random(6)
    sizes = mixing.materialize(mixing.sized(documents(spark, [prose(rng, n) for n in sizes_of])), "test-sizes")
    targets = sizes.groupBy("source").sum("size").toDF("source", "source_size").withColumn("target", F.lit(float(target)))
    rows = mixing.passes(sizes, mixing.thresholds(sizes, targets)).collect()
    return sum(r["size"] * r["n_passes"] for r in rows)


def test_a_straddling_document_is_taken_where_that_is_nearer(spark):
    assert taken_of(spark, [50, 50], 90) == 100
    assert taken_of(spark, [50, 50], 60) == 50
    assert taken_of(spark, [50, 50], 190) == 200  # a whole pass, then both
    # one long text: over by at most 500 words if it straddles, else under by a short one
    for short in (7, 10, 16, 25):
        assert abs(taken_of(spark, [short] * (8000 // short) + [2000], 9500) - 9500) <= 550
