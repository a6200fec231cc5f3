import hashlib
import random

import numpy as np

from ledgerspark.llm import repeats

from .helpers import documents, odd_texts, prose


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    count = {}
    for b in raw:
        for i in range(len(b) - 399):
            s = b[i : i + 400]
            count[s] = count.get(s, 0) + 1
    out = []
    for b in raw:
        edge = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                edge[i] += 1
                edge[i + 400] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, ids=None):
    df = documents(spark, texts, ids=ids)
    got = sorted(tuple(r)[1:5] for r in repeats.remove_repeats(df).collect())
    assert got == sorted(brute(texts))


def test_odd_texts(spark):
    check(spark, [t if t is None or len(t) < 20_000 else t[:3000] for t in odd_texts()])


def test_shared_passages_edges_and_periods(spark):
    rng = random.Random(1)
    p = prose(rng, 200)
    texts = [prose(rng, 50) + p[a:b] + prose(rng, 40) for a, b in ((0, 500), (100, 700), (50, 449), (50, 450), (0, 399))]
    texts += ["ab" * 210, "abc" * 130, "abcdefg" * 80 + prose(rng, 30), "x" * 400, "x" * 401]
    texts += [p + " " + prose(rng, 3) + " " + p, prose(rng, 100), "é" * 210]
    check(spark, texts)


def test_every_period_up_to_a_string(spark):
    """145 is WINDOW: equal anchors stand exactly a window apart."""
    rng = random.Random(4)
    texts = []
    for period in range(1, 401):
        unit = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(period))
        texts.append((unit * (400 // period + 3))[: 400 + period + 5])
    check(spark, texts)


def test_many_contexts_of_one_passage(spark):
    rng = random.Random(2)
    p = prose(rng, 90)
    check(spark, [prose(rng, rng.randrange(1, 90)) + " " + p + " " + prose(rng, rng.randrange(1, 90)) for _ in range(30)])


def test_repeated_rows_null_ids_and_no_rows(spark):
    rng = random.Random(3)
    p = prose(rng, 100)
    check(spark, [p, p, p, "short", None, None], ids=[1, 1, None, None, None, 2])
    assert repeats.remove_repeats(documents(spark, ["x"]).limit(0)).count() == 0


def test_smallest_of_a_window():
    x = np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64)
    for size in (1, 7, 145):
        assert (repeats.smallest(x, size) == [x[i : i + size].min() for i in range(1001 - size)]).all()
