import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import bpe, grammar, token_files
from ledgerspark.session import scratch_path

from .helpers import documents, odd_texts, prose

ALPHABET = [" ", "  ", "\n", "\t", "\r\n", "'s", "'t", "'", "é", "ß", "日本", "🎉", "a", "ab", "the", "ing", "23", "!", "--",
            "\x1c", "\x85", "́", "aaaa", "lll", "\x00"]


def reference():
    import tiktoken

    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ref", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_library_on_random_texts():
    enc, ref, rng = bpe.Encoder(bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))), reference(), random.Random(1)
    for _ in range(60):
        texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(25))) for _ in range(20)]
        ids, ends = enc.encode(texts)
        for t, a, b in zip(texts, ends[:-1], ends[1:]):
            assert ids[a:b].tolist() == ref.encode_ordinary(t)
            assert enc.ranks.decode(ids[a:b]) == t.encode()


def test_lower_rank_opened_by_a_merge(tmp_path):
    """A rank file in which a merge opens a pair of lower rank."""
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {b"bab": 256, b"ab": 257, b"ba": 258, b"abab": 259}
    path = tmp_path / "r.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    r = bpe.Ranks(str(path))
    pieces = [b"ab", b"bab", b"babab", b"abab", b"bbaabab", b"a", b"ababbabab"]
    ids, offset = bpe.replay(pieces, r)
    for p, a, b in zip(pieces, offset[:-1], offset[1:]):
        assert ids[a:b].tolist() == ([r.ranks[p]] if p in r.ranks else r.one(p))


def test_encode_whole_table(spark):
    texts, ref = odd_texts(), reference()
    got = {r["doc_id"]: r for r in bpe.encode(documents(spark, texts), with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = ref.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(documents(spark, ["x"]).limit(0)).count() == 0


def word_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_files_hold_the_library_ids(spark):
    rng = random.Random(2)
    texts = odd_texts() + [prose(rng, rng.randrange(300)) for _ in range(60)]
    texts += ["a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "ΣΑΣ Σ", "Á á"]
    ids = rng.sample(range(-50, 1000), len(texts))
    ids[3] = ids[4] = None
    ids[5] = ids[6]
    df = documents(spark, texts, ids=ids)
    path = token_files.write(df, scratch_path(spark, "test-tokens"), block_ids=3000)
    got = token_files.read(spark, path, with_ids=True).orderBy("start").collect()
    order = sorted(zip(ids, texts), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = word_ids([t for _, t in order]), 0
    assert len(got) == len(want)
    for (i, _), w, g in zip(order, want, got):
        raw = np.array(w, dtype="<u4").tobytes()
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (i, start, len(w), zlib.crc32(raw))
        assert g["ids"] == w
        start += len(w)
    assert spark.read.parquet(path).count() > 3  # several blocks
    assert token_files.encode_and_read(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    count = rng.integers(0, 60, 40)
    base = rng.integers(0, [3, 50, 49408, 49408][seed], 30)
    ids = np.concatenate([np.tile(base, 40)[: count.sum()]]).astype(np.int32)
    g = grammar.compress(ids, count)
    assert (g.expand(g.symbols) == ids).all() and g.lengths(g.symbols).sum() == len(ids)
    at = np.concatenate(([0], np.cumsum(count)))
    for d in range(len(count)):
        own = ids[at[d] : at[d + 1]]
        assert (g.ids(d) == own).all()
        for a in range(0, len(own), 7):
            assert (g.ids(d, a, min(a + 5, len(own))) == own[a : a + 5]).all()
    if seed < 3:
        assert len(g.symbols) < len(ids) / 2


def test_block_survives_the_file(spark):
    df = documents(spark, ["one two two two " * 50, "", None])
    path = token_files.write(df, scratch_path(spark, "test-block"))
    rows = [r.asDict() for r in spark.read.parquet(path).orderBy("shard", "start_in_shard").collect()]
    ids = [token_files.grammar_of(r).expand(token_files.grammar_of(r).symbols).tolist() for r in rows]
    assert sum(ids, []) == sum(word_ids(["one two two two " * 50, "", None]), [])
    assert spark.read.parquet(path).agg(F.sum("n_tokens")).first()[0] == 203


def test_words_of_one_core_reach_the_library_once(monkeypatch):
    encoder = token_files.WordEncoder(public_tokenizers.path(token_files.VOCABULARY))
    asked, own = [], encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda words: asked.extend(words) or own(words))
    texts = ["Gepfung gepfung. GEPFUNG, gepfung??", "Überein überein! Gepfung.", "gepfung"]
    ids, count = encoder.encode([t.encode() for t in texts])
    assert ids.tolist() == sum(word_ids(texts), []) and count.tolist() == [len(w) for w in word_ids(texts)]
    assert asked.count("gepfung") == 1 and len(asked) == len(set(asked)) == 7


def test_units_give_the_library_ids_of_odd_words():
    rng = random.Random(7)
    parts = ["a", "B", "Ör", "ß", "ÿ", "×", "÷", "é", "e\u0301", "\u0301", "J\u030c", "İ", "Σ", "ª", "º", "日", "7", "²", ".", ",", "'", "'s",
             "'T", "''", "<|", "|>", "<|endoftext|>", "`~", "^$+", "\x1c", "\x85", "\x00", "\x7f", "\u00a0", "🎉", "-"]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(12)) for _ in range(400)]
    encoder = token_files.WordEncoder(public_tokenizers.path(token_files.VOCABULARY))
    want = word_ids(texts)
    for a in range(0, len(texts), 40):
        ids, count = encoder.encode([t.encode() for t in texts[a : a + 40]])
        assert count.tolist() == [len(w) for w in want[a : a + 40]]
        assert ids.tolist() == sum(want[a : a + 40], [])


def test_expand_lays_each_rule_out_once(monkeypatch):
    """Many symbols are not undone one round after the other."""
    ids = np.tile(np.arange(40, dtype=np.int32), 500)
    g = grammar.compress(ids, np.full(100, 200))
    undone, own = [], grammar.Grammar._undo
    monkeypatch.setattr(grammar.Grammar, "_undo", lambda self, s: undone.append(len(s)) or own(self, s))
    assert (g.expand(g.symbols) == ids).all() and (g.ids(3) == ids[600:800]).all()
    assert max(undone) <= max(len(g.left), 200) < len(g.symbols)
