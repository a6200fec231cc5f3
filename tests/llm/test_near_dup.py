import random

import numpy as np
import pytest

from ledgerspark.llm import components, near_dup

from .helpers import WORD, documents, odd_texts, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    """component by row number, from all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[root(i)] = min(low.get(root(i), doc_id), doc_id)
    return sets, [low.get(root(i)) for i in range(len(rows))]


def check(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    df = documents(spark, texts, ids=ids)
    got = sorted(
        [tuple(r) for r in near_dup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()],
        key=str,
    )
    sets, comp = brute(list(zip(ids, texts)))
    want = sorted(
        [
            (i, len(s), c if c is not None else i, (c if c is not None else i) == i)
            for i, s, c in zip(ids, sets, comp)
        ],
        key=str,
    )
    assert got == want


def near_copies(rng, base, n, most):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def test_odd_texts_and_copies(spark):
    rng = random.Random(1)
    texts = odd_texts() + near_copies(rng, prose(rng, 150), 25, 9)
    check(spark, texts)


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(2)
    a, b = prose(rng, 80), prose(rng, 60)
    check(spark, [a, a, a + " more", b, b, "", None], ids=[4, 4, None, None, None, 9, 9])


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 3)
    rng = random.Random(3)
    passage = prose(rng, 60)
    texts = near_copies(rng, prose(rng, 150), 70, 12) + [passage + " " + prose(rng, rng.randrange(5, 60)) for _ in range(40)]
    check(spark, texts)


def test_chain_of_links_is_one_group(spark):
    words = [f"c{i}" for i in range(300)]
    check(spark, [" ".join(words[i : i + 100]) for i in range(0, 200, 8)])


def test_empty_table(spark):
    df = documents(spark, ["x"]).limit(0)
    assert near_dup.near_duplicates(df).count() == 0
    assert near_dup.keep_one(df).count() == 0


def test_keep_one_keeps_columns_and_one_of_each(spark):
    rng = random.Random(4)
    a, b = prose(rng, 80), prose(rng, 60)
    df = documents(spark, [a, a, a, b, None, "", ""], ids=[3, 3, 1, None, 5, 6, 6])
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [
        (False, 1), (False, 5), (False, 6), (False, 6), (True, 0)
    ]


def test_posterior_bound():
    least = near_dup.least_matches(75, 1e-5)
    assert sorted(least) == [32, 64, 96, 128] and all(0 < least[n] < 0.75 * n for n in least)
    # at a similarity of 0.75 the cut drops next to nothing
    rng = np.random.default_rng(0)
    m = rng.binomial(32, 0.75, size=200_000)
    assert (m < least[32]).mean() < 1e-4


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6])
def test_short_texts_have_one_shingle(n):
    own = near_dup.shingles([" ".join("abcdefgh"[:n]).encode()])[0]
    assert len(own) == (0 if n == 0 else max(1, n - 4))


def test_components_round_is_one_join(spark, monkeypatch):
    """Random links, a long path, a star and a self-link; a round that joins
    more often deals its rows out more often."""
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    links += [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 1900 + i) for i in range(60)] + [(5, 5), (5, 5)]
    plans, own = [], components.materialize

    def seen(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return own(df, name)

    monkeypatch.setattr(components, "materialize", seen)
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    assert sorted(map(tuple, got.collect())) == sorted((x, root(x)) for x in parent)
    assert max(plans) == 1 and len(plans) <= 14


def components_of(links):
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    return sorted((x, root(x)) for x in parent)


def test_components_rounds_follow_nodes_not_links(spark, monkeypatch):
    """Rounds join few links of a dense group, and a path whose nodes come in
    any order takes few rounds."""
    rng = random.Random(11)
    path = list(range(10_000, 10_400))
    rng.shuffle(path)
    dense = [(i, j) for i in range(70) for j in range(i) if rng.random() < 0.8]
    links = dense + list(zip(path, path[1:])) + [(7, 7), (9_000, 9_000), (3, 200)]
    written, own = [], components.materialize

    def seen(df, name):
        assert len(written) < 20
        written.append((name, own(df, name)))
        return written[-1][1]

    monkeypatch.setattr(components, "materialize", seen)
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    want = components_of(links)
    assert sorted(map(tuple, got.collect())) == want
    edges = [df.count() for name, df in written if name == "cc-edges"]
    assert sum(edges) <= 2 * len(want) < len(dense)


def test_further_links_are_merged(spark):
    rng = random.Random(12)
    links = [(rng.randrange(90), rng.randrange(90)) for _ in range(80)]
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(links)], "i int, a long, b long")
    first, more = df.filter("i < 50").drop("i"), df.filter("i >= 50").drop("i")
    got = components.merged(components.components(first), more)
    assert sorted(map(tuple, got.collect())) == components_of(links)
