import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from ledgerspark.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, i string, p string, depth int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", None, 7) for r in rows], SCHEMA).repartition(3)


def brute(rows, every=20, most=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn), (role or "", text or "")))
    own = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(c / abs(c) * (abs(c) % every)) if c else 0
        built[c] = tuple(own.get(base, [])[:h] + ts[h:])
    nodes = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes[ts[:d]].append(c)
    kids = defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        w = len(WORD.findall(path[-1][1])) if path else 0
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = (len(nodes[path]) - 1) * w + sum(saved[k] for k in kids[path])
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out.append(
            (min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids[path]),
             leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def built(spark, rows):
    turns = prefix_trie.ordered_turns(table(spark, rows))
    got = prefix_trie.prefix_trie(*prefix_trie.share_heads(turns))
    assert got.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ]
    return sorted((tuple(r) for r in got.collect()), key=str)


def sample(seed, n, depth=7, texts=3):
    rng = random.Random(seed)
    rows = []
    for c in range(-n // 4, n):
        if c % 20 == 0 and rng.random() < 0.3:
            continue  # absent heads
        for t in range(rng.randrange(1, depth)):
            text = None if rng.random() < 0.05 else "say " * rng.randrange(texts) + rng.choice(["", " \t", "a", "日本 é"])
            rows.append((c, t if t else None, rng.choice(["user", None, ""]), text))
    return rows + [(None, 1, "user", "nobody's")]


@pytest.mark.parametrize("group_rows", [4096, 40])
def test_equals_brute_force(spark, monkeypatch, group_rows):
    """With the small bound most of the trie is peeled level by level."""
    monkeypatch.setattr(prefix_trie, "GROUP_ROWS", group_rows)
    rows = sample(1, 300)
    assert built(spark, rows) == brute(rows)


def test_copies_long_conversations_and_small_passes(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "GROUP_ROWS", 64)
    monkeypatch.setattr(prefix_trie, "PASS_ROWS", 50)
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = [(c, t, "user", f"same {t}") for c in range(1000, 1150) for t in range(4)]  # a hot conversation
    rows += [(c, t, "user", f"long {t if t < 25 else (t, c)}") for c in (2001, 2002, 2003) for t in range(90)]
    rows += [(c, 0, "user", "same 0") for c in range(3000, 3100)]  # a hot first turn
    assert built(spark, rows) == brute(rows)


def test_turnless_only_and_empty(spark):
    rows = [(c, 0, "user", "x") for c in range(21, 40)]  # heads absent: some lose their only turn
    got = built(spark, rows)
    assert got == brute(rows) and any(r[1] == 0 and r[4] < r[3] for r in got)
    empty = table(spark, rows).filter("false")
    turns = prefix_trie.ordered_turns(empty)
    assert prefix_trie.prefix_trie(*prefix_trie.share_heads(turns)).collect() == []
