import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import topk


def brute(rows, every=50, k=5):
    v = []
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            v.append((i, [math.floor(256 * float(np.float32(x))) for x in e]))
    out = []
    for i, q in v:
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in v if j != i and len(c) == len(q))
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return sorted(out)


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, e, 0, "x") for i, e in rows], "vec_id long, embedding array<float>, page int, dist string")
    got = topk.top_k(df.repartition(3), F.col("vec_id") % 50 == 0, **kw)
    assert sorted(map(tuple, got.collect())) == brute(rows, **kw)


def clustered(n, dim, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, size=(8, dim))
    return [(i, (centres[rng.integers(8)] + rng.normal(0, spread, dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("page", [16, 100, 4096])
def test_equal_to_brute_force(spark, monkeypatch, page):
    monkeypatch.setattr(topk, "PAGE", page)
    check(spark, clustered(600, 6, 1))


def test_ties_copies_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "PAGE", 8)
    rng = random.Random(1)
    rows = [(i, [0.5, -0.25]) for i in range(0, 120)]  # all ties
    rows += [(200 + i, [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(80)]
    rows += [(500, None), (550, [1.0, None]), (600, [math.inf, 1.0]), (650, [math.nan, 0.0]), (None, [1.0, 1.0])]
    rows += [(700, [0.1, 0.2, 0.3]), (701, [0.3, 0.1, -0.2]), (750, [0.0, 0.0]), (800, [])]
    check(spark, rows)


def test_few_candidates_and_large_numbers(spark):
    check(spark, [(0, [1e6, -2e6]), (50, [3e6, 1.5]), (51, [-1e6, 7e6])])
    check(spark, [(0, [1.0])])


def test_no_rows(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_skip_pages(spark, monkeypatch):
    """On clustered vectors most pages are never read by a query."""
    monkeypatch.setattr(topk, "PAGE", 16)
    seen = []
    real = topk._visits

    def spy(*a, **kw):
        out = real(*a, **kw)
        seen.append(sum(len(r["q_ids"]) // 8 for r in out.select("q_ids").collect()))
        return out

    monkeypatch.setattr(topk, "_visits", spy)
    rows = clustered(1500, 3, 2, spread=0.01)
    check(spark, rows)
    assert sum(seen) < 0.8 * 30 * math.ceil(1500 / 16)


def test_small_tables_have_a_tree(spark, monkeypatch):
    """As shipped, on the vectors of sf0.1: floors from the first wave keep
    queries from most pages, which meet whole blocks of queries."""
    seen = []
    real = topk._visits

    def spy(*a, **kw):
        rows = real(*a, **kw).select("page", "q_ids").collect()
        seen.append((len(a[4]), len(rows), sum(len(r["q_ids"]) // 8 for r in rows)))
        return real(*a, **kw)

    monkeypatch.setattr(topk, "_visits", spy)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    n_queries = df.filter("vec_id % 50 = 0").count()
    topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    pages = seen[0][0]
    assert pages > 20 and len(seen) >= 2 and seen[0][2] == 2 * n_queries
    assert all(rows <= pages * 8 for _, rows, _ in seen)  # a row by page and task, not by four queries
    print("pages", pages, "queries", n_queries, "visits", seen)


def test_clustered_vectors_skip_pages_as_shipped(spark, monkeypatch):
    visits = []
    real = topk._visits

    def spy(*a, **kw):
        visits.append(sum(len(r["q_ids"]) // 8 for r in real(*a, **kw).select("q_ids").collect()))
        return real(*a, **kw)

    monkeypatch.setattr(topk, "_visits", spy)
    check(spark, clustered(2000, 4, 3, spread=0.01))
    assert sum(visits) < 0.5 * 40 * 44


def test_no_row_holds_more_than_one_vector(spark, monkeypatch):
    """A batch of rows stays small however large pages and blocks get."""
    widest = {}
    real = topk.materialize

    def spy(df, name):
        out = real(df, name)
        for c, kind in out.dtypes:
            if kind == "binary":
                widest[name, c] = out.agg(F.max(F.octet_length(c))).first()[0] or 0
        return out

    monkeypatch.setattr(topk, "materialize", spy)
    check(spark, clustered(2000, 64, 5))
    assert widest and max(widest.values()) <= 8 * 64


@pytest.mark.parametrize("chunk", [1, 60])
def test_queries_meet_chunks_in_groups(spark, monkeypatch, chunk):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 2)
    monkeypatch.setattr(topk, "CELLS", 64)
    check(spark, clustered(700, 5, 6) + [(50 * i, [0.25] * 5) for i in range(20, 24)])
