import random
from collections import defaultdict

import numpy as np
import pytest

from ledgerspark.llm import set_join
from ledgerspark.llm.docs import SLICE_BYTES

from .helpers import WORD, documents, odd_texts, prose

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 4:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}


def brute(ids, texts):
    sets = [shingles(t) for t in texts]
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            at[g].append(i)
    shared = defaultdict(int)
    for rows in at.values():
        for x in range(len(rows)):
            for y in rows[x + 1 :]:
                shared[rows[x], y] += 1
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (x, y), c in shared.items():
        if 100 * c >= 85 * (len(sets[x]) + len(sets[y]) - c):
            root[max(find(x), find(y))] = min(find(x), find(y))
    low = defaultdict(list)
    for i in range(len(texts)):
        low[find(i)].append(ids[i])
    least = {r: min((x for x in v if x is not None), default=None) for r, v in low.items()}
    key = lambda r: tuple(-1 if x is None else x for x in r)
    return sorted(((ids[i], len(sets[i]), least[find(i)] if sets[i] else ids[i]) for i in range(len(texts))), key=key)


def check(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    got = set_join.jaccard_join(documents(spark, texts, ids=ids))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == brute(ids, texts)


def edited(rng, words, n):
    """n places changed, dropped or added to."""
    w = list(words)
    for _ in range(n):
        i = rng.randrange(len(w) + 1)
        w[i : i + rng.choice([0, 1])] = [f"n{rng.random()}"] * rng.choice([0, 1, 1])
    return " ".join(w)


def families(seed, n_families, n_members):
    """Texts about the threshold: from 5 to 400 words, up to a tenth changed."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n_families):
        size = rng.choice([3, 4, 8, 9, 10, 12, 15, 20, 30, 45, 80, 150, 400])
        words = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(n_members):
            texts.append(edited(rng, words, rng.randrange(0, 2 + size // 20)))
    return texts


def test_equals_brute_force(spark):
    check(spark, odd_texts() + families(1, 60, 6))
    texts = families(2, 30, 4) + [None, "", "a b"]
    check(spark, texts, ids=[None if i % 7 == 0 else 1000 - i for i in range(len(texts))])


@pytest.mark.parametrize("small", [1, 3])
def test_large_buckets(spark, monkeypatch, small):
    """Nearly all buckets are large, so open classes are joined by one-deletion
    neighbourhoods; blocks and tasks break the buckets."""
    monkeypatch.setattr(set_join, "SMALL", small)
    monkeypatch.setattr(set_join, "BLOCK", 500)
    rng = random.Random(3)
    common = prose(rng, 60)
    texts = families(4, 25, 9) + [f"{common} {prose(rng, k)}" for k in (2, 3, 5, 8, 11, 12, 13, 20, 60) for _ in range(12)]
    texts += [common] * 5
    check(spark, texts)


def test_template_family_and_common_passage(spark):
    """A family of many texts on one template, some of them near copies."""
    rng = random.Random(6)
    template = prose(rng, 200, 3000).split()
    texts = [edited(rng, template, 12) for _ in range(120)]
    texts += [edited(rng, t.split(), 2) for t in texts[:30]]
    passage = prose(rng, 60, 3000)
    texts += [f"{prose(rng, 10, 3000)} {passage} {prose(rng, 10, 3000)}" for _ in range(80)]
    check(spark, texts)


def test_longer_than_a_slice_and_empty(spark):
    rng = random.Random(7)
    words = [f"word{rng.randrange(1 << 30)}" for _ in range(SLICE_BYTES // 12)]
    check(spark, [" ".join(words), edited(rng, words, 50), " ".join(words[: len(words) // 2]), "x"])
    assert set_join.jaccard_join(documents(spark, ["a"]).filter("false")).collect() == []


def test_bound_of_differing_tokens():
    for low, high in ((6, 9), (9, 14), (50, 75), (400, 600)):
        most = 0
        for a in range(low, high + 1):
            for b in range(a, 100 * a // 85 + 1):
                both = -(-85 * (a + b) // 185)
                if both <= a:
                    most = max(most, a + b - 2 * both)
        assert most <= set_join.most_differing(low, high) <= most + 1


def test_histogram_never_drops_a_link():
    rng = np.random.default_rng(1)
    for n in (6, 20, 100, 900, 5000):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for cut in range(1, max(2, n // 12)):
            y = np.concatenate((x[cut:], rng.integers(0, 1 << 63, cut // 2).astype(np.uint64)))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 85 * (len(x) + len(y) - both):
                turned = np.bitwise_count(set_join.parity(x).view(np.uint64) ^ set_join.parity(y).view(np.uint64)).sum()
                assert turned <= len(x) + len(y) - 2 * both
                assert set_join.may_link(set_join.histogram(x), set_join.histogram(y), len(x), len(y))
