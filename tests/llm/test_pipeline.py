"""The pipeline's stages against what each must do to its own input, and the
registration of the queries."""

import hashlib
from collections import Counter

import corpus_pipeline as pipeline
import public_tokenizers

import __spark_entry__ as entry
from ledgerspark.llm import mixing, quality, secret_scan
from ledgerspark.llm.docs import materialize, read_table

from .test_near_dup import brute

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_in_turn(spark):
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    frames = [docs]
    for name, stage in pipeline.STAGES:
        frames.append(materialize(stage(spark, frames[-1], SF), f"test-{name}"))
    assert all(f.columns == columns for f in frames[:-1])
    start, good, single, masked, mixed, encoded = frames

    judged = quality.classify(start, read_table(spark, SF, "labels")).collect()
    assert set(texts(good)) == {r["doc_id"] for r in judged if r["predicted"]}

    rows = sorted(texts(good).items())
    sets, comp = brute(rows)
    first = {}
    for (i, _), s, c in zip(rows, sets, comp):
        first.setdefault(c if s else ("alone", i), i)
    assert set(texts(single)) == set(first.values())

    path = public_tokenizers.path(secret_scan.VOCABULARY)
    before, after = texts(single), texts(masked)
    assert set(before) == set(after)
    for i, t in before.items():
        assert (after[i] == t) == (not secret_scan.find_spans(t.encode(), path))
        assert not secret_scan.find_spans(after[i].encode(), path)

    passes = {r["doc_id"]: r["n_passes"] for r in mixing.mix(masked).collect()}
    got = Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert got == Counter({k: v for k, v in passes.items() if v})

    want = Counter((i, hashlib.sha256(after[i].encode()).hexdigest()) for i, n in got.items() for _ in range(n))
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in encoded.collect()) == want

    whole = pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256").collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, encoded.select("doc_id", "n_tokens", "ids_sha256").collect()))


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is pipeline.run and "pipeline" not in entry.oracle_sql()
