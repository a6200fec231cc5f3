"""Token-id files: encoded documents as Re-Pair grammars.

Documents are dealt out by ranges of doc_id and sorted within a range, encoded,
and cut into blocks of about ``BLOCK_IDS`` ids, always whole documents.  A
block is one row of a Parquet file: the grammar of its ids (``grammar``), the
documents' ids and lengths, so any document is read by expanding its own
symbols only.  Files are written by Spark's committer, so a lost executor's
attempt leaves nothing behind.

The tokenizer encodes white-space-separated words independently of each other,
and lower-cases them and splits letters from signs, so ids are kept by word and
by unit (``units_of``), and a unit is encoded once a task.  The words and units
that are most frequent in a sample of ``SAMPLE_DOCS`` documents are encoded
beforehand and broadcast (``COMMON_WORDS`` at most); the sample sets the speed
and never the ids.

Defined cases: a null or empty text is the end id alone; null doc_ids come
first; rows with equal doc_id stand in the order of their texts; texts of any
length are one run of ids; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reach_package, scratch_path
from .bpe import Runs, gather
from .docs import _LOWER, SLICE_BYTES, Words, hash_spans, slices, with_bytes, word_bytes, words_of
from .grammar import Grammar, compress

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
WORD_END = "</w>"  # ends the name of a token that closes a word
BLOCK_IDS = 1 << 21
JOINED = 64
SAMPLE_DOCS = 20_000
COMMON_WORDS = 1_000_000
CACHE_WORDS = 400_000
# bytes of ASCII letters and of U+00C0 to U+00FF without the two signs there
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = True
_LETTER[[0x97, 0xB7]] = False
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

BLOCK_SCHEMA = (
    "shard int, start_in_shard long, n_tokens long, doc_ids array<long>, doc_tokens binary, doc_symbols binary, "
    "symbols binary, rule_left binary, rule_right binary, rule_length binary"
)


def _closes(word: str) -> int:
    """How many tokens close a word in a lower-cased word's encoding: one for
    letters, two with a sign behind them; 0 if that is not known."""
    if word.isalpha():
        return 1
    return 2 if word[-1] in ".," and word[:-1].isalpha() else 0


@lru_cache(maxsize=1)
def _library(path: str):
    """The tokenizer and which of its ids close a word; kept by a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    closes[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
    return tokenizer, closes


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, a place of each, and the number of each place's
    hash among them; np.unique with its indexes would sort stably, which takes
    longer."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    back = np.empty(len(ranked), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return ranked[new], order[new], back


def units_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The units of the words at these places of ``data``: the lower-cased
    letters of each word of letters (ASCII and U+00C0 to U+00FF), any other word
    as it stands; then the signs behind letters.  Returns bytes, first and last
    place of each unit, and the numbers of the words with signs.  The tokenizer
    lower-cases and splits letters from signs itself, so a word's ids are those
    of its units one after the other."""
    size = end - start
    upto = np.cumsum(size)
    begin = upto - size
    out = data[np.arange(int(size.sum())) + np.repeat(start - begin, size)]
    letters = np.concatenate(([0], np.cumsum(_LETTER[out])))
    signs = np.concatenate(([0], np.cumsum(_SIGN[out])))
    n = letters[upto] - letters[begin]
    plain = (n > 0) & (letters[begin + n] - letters[begin] == n) & (signs[upto] - signs[begin] == size - n)
    out = np.where(np.repeat(plain, size), _LOWER[out], out)
    inner = np.where(plain, begin + n, upto)
    signed = np.flatnonzero(inner < upto)
    return out, np.concatenate((begin, inner[signed])), np.concatenate((inner, upto[signed])), signed


class Common:
    """Words and their ids, found by hash."""

    def __init__(self, hashes: np.ndarray, lists: pa.ListArray):
        order = np.argsort(hashes)
        lists = lists.take(pa.array(order))
        self.hashes, self.runs = hashes[order], Runs()
        self.runs.add(lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        place = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        return place, self.hashes[place] == keys


def _nothing_common() -> Common:
    return Common(np.zeros(0, dtype=np.uint64), pa.array([], pa.list_(pa.int32())))


class WordEncoder:
    """Ids of texts by their words: those of frequent words are known, those
    of others are put together from the ids of their units."""

    def __init__(self, path: str, words: Common | None = None, units: Common | None = None):
        self.tokenizer, self.closes = _library(path)
        self.common, self.units = words or _nothing_common(), units or _nothing_common()
        self.reset()

    def reset(self) -> None:
        self.at: dict[int, int] = {}
        self.own = Runs()

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words at these places, and their numbers."""
        n = len(start)
        data, start, end, signed = units_of(data, start, end)
        key, first, back = distinct(hash_spans(data, start, end))
        place, hit = self.units.find(key)
        miss = np.flatnonzero(~hit)
        keys = key[miss].tolist()
        new = [i for i, k in enumerate(keys) if k not in self.at]
        if new:
            which, raw = first[miss[new]], data.tobytes()
            self.own.add(*self._encode([raw[a:b].decode() for a, b in zip(start[which].tolist(), end[which].tolist())]))
            size = len(self.at)
            self.at.update((keys[i], size + j) for j, i in enumerate(new))
        own = np.array([self.at[k] for k in keys], dtype=np.int64)
        flat, begin, count = _merge(hit, self.units.runs.take(place[hit]), self.own.take(own))
        # a word's signs follow its letters
        order = back[np.insert(np.arange(n), signed + 1, np.arange(n, len(back)))]
        total = count[back[:n]]
        total[signed] += count[back[n:]]
        return gather(flat, begin[order], count[order])[0], total

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and their numbers, by the tokenizer.

        Words of letters, alone or with one point or comma, are encoded many at
        a time: how many tokens close a word in each is known, so the ids fall
        apart again. All others, and a batch in which that number does not
        come out, are encoded one by one."""
        closed = np.array([_closes(w.lower()) for w in words], dtype=np.int64)
        plain = np.flatnonzero(closed)
        texts = [words[i] for i in plain.tolist()]
        joined = [" ".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)]
        ids = self._ids(joined)
        flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
        last = np.flatnonzero(self.closes[flat])
        if len(last) != closed.sum():
            plain, flat, last = plain[:0], flat[:0], last[:0]
        ends = np.concatenate(([0], last[np.cumsum(closed[plain]) - 1] + 1)) if len(plain) else np.zeros(1, dtype=np.int64)
        alone = np.setdiff1d(np.arange(len(words)), plain)
        single = self._ids([words[i] for i in alone.tolist()])
        count = np.zeros(len(words), dtype=np.int64)
        count[plain] = np.diff(ends)
        count[alone] = [len(x) for x in single]
        begin = np.zeros(len(words), dtype=np.int64)
        begin[plain] = ends[:-1]
        begin[alone] = len(flat) + np.cumsum(count[alone]) - count[alone]
        return gather(np.concatenate((flat, *single)), begin, count)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.int32) for e in found]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, each text closed by the end id, and their numbers."""
        if len(self.at) > CACHE_WORDS:
            self.reset()
        w = words_of(texts, lower=False)
        key, first, back = distinct(w.hash)
        place, hit = self.common.find(key)
        miss = first[~hit]
        made = self.words(w.data, w.start[miss], w.end[miss])
        flat, begin, count = _merge(hit, self.common.runs.take(place[hit]), made)
        # the end id is a word of its own behind each text
        ends = w.first[1:]
        word = np.insert(back, ends, len(key))
        flat = np.append(flat, np.int32(END_ID))
        begin, count = np.append(begin, len(flat) - 1), np.append(count, 1)
        size = count[word]
        upto = np.concatenate(([0], np.cumsum(size)))
        edge = np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))
        return gather(flat, begin[word], size)[0], np.diff(upto[edge])


def _merge(hit: np.ndarray, found: tuple, made: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat ids, begins and numbers from those of the hits and of the rest."""
    count = np.empty(len(hit), dtype=np.int64)
    begin = np.empty(len(hit), dtype=np.int64)
    count[hit], count[~hit] = found[1], made[1]
    begin[hit] = np.cumsum(found[1]) - found[1]
    begin[~hit] = len(found[0]) + np.cumsum(made[1]) - made[1]
    return np.concatenate((found[0], made[0])).astype(np.int32, copy=False), begin, count


def common_words(docs: DataFrame, path: str) -> tuple[Common, Common]:
    """Encodings of the most frequent words and units of a sample, bounded by
    COMMON_WORDS together: a cache for the tasks."""
    n = docs.count()
    part = int(min(1.0, SAMPLE_DOCS / max(n, 1)) * (1 << 20))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part)
    reach_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                w = words_of(texts[a:b], lower=False)
                key, first, c = np.unique(w.hash, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), word_bytes(w, first), pa.array(c)], names=["hash", "word", "c"]
                )

    counts = with_bytes(sample).mapInArrow(run, "hash long, word binary, c long")
    words = counts.groupBy("hash", "word").agg(F.sum("c").alias("c")).filter("length(word) < 200")

    def split(batches):
        for batch in batches:
            w = words_of(batch.column("word").to_pylist(), lower=False)
            data, start, end, signed = units_of(w.data, w.start, w.end)
            unit = Words(data, start, end, hash_spans(data, start, end), start)
            c = batch.column("c").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(len(c) + len(start)) >= len(c)),
                    pa.array(np.concatenate((batch.column("hash").to_numpy(), unit.hash.view(np.int64)))),
                    pa.concat_arrays([batch.column("word"), word_bytes(unit, np.arange(len(start)))]),
                    pa.array(np.concatenate((c, c, c[signed]))),
                ],
                names=["unit", "hash", "word", "c"],
            )

    top = (
        words.mapInArrow(split, "unit boolean, hash long, word binary, c long")
        .groupBy("unit", "hash", "word")
        .agg(F.sum("c").alias("c"))
        .orderBy(F.desc("c"), F.desc("unit"), "hash")
        .limit(COMMON_WORDS)
    )

    def encode(batches):
        encoder = WordEncoder(path)
        for batch in batches:
            w = words_of(batch.column("word").to_pylist(), lower=False)
            ids, count = encoder.words(w.data, w.start, w.end)
            offset = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offset), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("hash"), lists], names=["unit", "hash", "ids"])

    table = top.select("unit", "hash", "word").mapInArrow(encode, "unit boolean, hash long, ids array<int>").toArrow()

    def common(of_units: bool) -> Common:
        part = table.filter(pc.equal(table.column("unit"), of_units))
        return Common(part.column("hash").to_numpy().view(np.uint64), part.column("ids").combine_chunks())

    return common(False), common(True)


def write(docs: DataFrame, path: str, vocabulary: str | None = None, block_ids: int = BLOCK_IDS) -> str:
    """Writes the documents' ids in ascending doc_id order under ``path``."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(common_words(docs.select("doc_id", "text"), vocabulary))
    reach_package(spark)

    def run(batches):
        from pyspark import TaskContext

        shard, start = TaskContext.get().partitionId(), 0
        encoder = WordEncoder(vocabulary, *shared.value)
        ids, counts, names, n = [], [], [], 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            doc_ids = batch.column("doc_id").to_pylist()
            for a, b in slices(texts, min(SLICE_BYTES, 3 * block_ids)):
                flat, count = encoder.encode(texts[a:b])
                ids.append(flat)
                counts.append(count)
                names += doc_ids[a:b]
                n += len(flat)
                if n >= block_ids:
                    yield _block(shard, start, ids, counts, names)
                    ids, counts, names, n, start = [], [], [], 0, start + n
        if names:
            yield _block(shard, start, ids, counts, names)

    ordered = with_bytes(docs, "doc_id").repartitionByRange(F.asc_nulls_first("doc_id"))
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.parquet(path)
    return path


def _block(shard, start, ids, counts, names) -> pa.RecordBatch:
    count = np.concatenate(counts)
    g = compress(np.concatenate(ids), count)
    row = {
        "shard": pa.array([shard], pa.int32()),
        "start_in_shard": pa.array([start], pa.int64()),
        "n_tokens": pa.array([int(count.sum())]),
        "doc_ids": pa.array([names], pa.list_(pa.int64())),
        "doc_tokens": pa.array([count.astype("<i8").tobytes()]),
        "doc_symbols": pa.array([g.count.astype("<i8").tobytes()]),
        "symbols": pa.array([_pack(g.symbols)]),
        "rule_left": pa.array([g.left.astype("<i4").tobytes()]),
        "rule_right": pa.array([g.right.astype("<i4").tobytes()]),
        "rule_length": pa.array([g.length.astype("<i8").tobytes()]),
    }
    return pa.RecordBatch.from_pydict(row)


def _pack(symbols: np.ndarray) -> bytes:
    """Three bytes a symbol, low byte first."""
    return symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 3, 4), dtype=np.uint8)
    out[:, :3] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel().astype(np.int32)


def grammar_of(row: dict) -> Grammar:
    """The grammar of a block's row."""
    return Grammar(
        _unpack(row["symbols"]),
        np.frombuffer(row["doc_symbols"], dtype="<i8"),
        np.frombuffer(row["rule_left"], dtype="<i4"),
        np.frombuffer(row["rule_right"], dtype="<i4"),
        np.frombuffer(row["rule_length"], dtype="<i8"),
    )


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files, and
    its ids if asked for."""
    blocks = spark.read.parquet(path)
    # ids before each shard: one number by shard, of which there are as many
    # as write tasks, reaches the driver and is broadcast
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    before, offsets = 0, []
    for row in totals:
        offsets.append((row["shard"], before))
        before += row["n"]
    starts = F.broadcast(spark.createDataFrame(offsets, "shard int, shard_start long"))
    reach_package(spark)
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                g = grammar_of(row)
                count = np.frombuffer(row["doc_tokens"], dtype="<i8")
                upto = np.concatenate(([0], np.cumsum(count)))
                ids = g.expand(g.symbols).astype("<u4")
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["start"] + upto[:-1]),
                    pa.array(count),
                    pa.array(crc, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ddl.split(", ")])

    wanted = blocks.join(starts, "shard").withColumn("start", F.col("shard_start") + F.col("start_in_shard"))
    return wanted.select(
        "start", "doc_ids", "doc_tokens", "doc_symbols", "symbols", "rule_left", "rule_right", "rule_length"
    ).mapInArrow(run, ddl)


def encode_and_read(docs: DataFrame) -> DataFrame:
    """Writes the files to a fresh shared folder and reads them back."""
    spark = docs.sparkSession
    return read(spark, write(docs, scratch_path(spark, "token-files")))
