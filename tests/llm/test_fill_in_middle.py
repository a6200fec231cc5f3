import hashlib
import random
import re

import numpy as np

from ledgerspark.llm import fill_in_middle
from ledgerspark.llm.docs import SLICE_BYTES

from .helpers import documents, odd_texts, prose

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def brute(doc_id, text, fim=100, spm=50):
    t = text or ""
    u = LINE.findall(t)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return len(u), "plain", None, None, t
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(spark, texts, ids=None, **kw):
    df = fill_in_middle.transform(documents(spark, texts, ids=ids), **kw)
    rows = df.withColumn("back", fill_in_middle.restored()).collect()
    key = lambda r: tuple(("" if x is None else str(x)) for x in r)
    got = sorted((tuple(r) for r in rows), key=key)
    ids = range(len(texts)) if ids is None else ids
    want = sorted(((i, *brute(i, t, **kw), t or "") for i, t in zip(ids, texts)), key=key)
    assert got == want


def lined(rng, n):
    return "".join(prose(rng, rng.randrange(0, 6)) + rng.choice(["é", "🎉", "", "日本"]) + "\n" for _ in range(n))


def test_equals_brute_force(spark):
    rng = random.Random(3)
    texts = odd_texts() + [lined(rng, n) for n in (1, 2, 3, 17, 300, 4000)] + ["\n", "\n\n\n", "a\nb", "a\r\nb\r\n"]
    texts += [lined(rng, 40) + x for x in ("<P>", "<S", "<", "<M", ">P>", "<<", "<M>")]
    check(spark, texts)
    ids = [None if i % 5 == 0 else -i for i in range(len(texts))]
    check(spark, texts, ids=ids)


def test_shares(spark):
    rng = random.Random(4)
    texts = [lined(rng, 5) for _ in range(200)]
    rows = fill_in_middle.transform(documents(spark, texts), fim_percent=40, spm_percent=10).collect()
    assert {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows} == {
        i: brute(i, t, 40, 10) for i, t in enumerate(texts)
    }


def test_text_longer_than_a_slice(spark):
    rng = random.Random(5)
    block = lined(rng, 2000)
    check(spark, [block * (SLICE_BYTES // len(block) + 2), "x", block])


def test_every_rank_is_reached():
    rng = np.random.default_rng(0)
    n = np.array([0, 1, 5, 1000, 0, 64])
    points, size = rng.integers(0, 9, n.sum()), rng.integers(0, 9, n.sum())
    lists = fill_in_middle.SkipLists(n, points, size)
    assert len(lists.lanes) > 3
    doc = np.repeat(np.arange(len(n)), n + 1)
    first = np.cumsum(n) - n
    rank = np.concatenate([np.arange(k + 1) for k in n])
    got = lists.locate(doc, rank)
    for have, width in zip(got, (points, size)):
        total = np.concatenate(([0], np.cumsum(width)))
        assert (have == total[first[doc] + rank] - total[first[doc]]).all()


def test_empty_table(spark):
    assert fill_in_middle.transform(documents(spark, ["a"]).filter("false")).collect() == []
