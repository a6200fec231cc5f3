"""Registered queries of this subpackage: op<N>_<name>, and the pipeline.

Each applies its operator with production parameters to the whole table; where
SQL can express the result, ORACLE has it for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    fill_in_middle,
    language_model,
    mixing,
    near_dup,
    prefix_trie,
    quality,
    repeats,
    rules,
    secret_scan,
    set_join,
    token_files,
    topk,
)
from .docs import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


@register("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register("op2_mixing")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@register("op4_secrets")
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


@register("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read_table(spark, sf_dir, "documents"))


# Words, distinct shingles, pairs that share one, links, and the smallest
# doc_id reachable; small tables only need a few rounds.
NEAR_DUP_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
         ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT a AS doc_id, a AS other FROM edge
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other),
comp AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id,
       coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN comp c ON c.doc_id = d.doc_id
"""


@register("op7_minhash", NEAR_DUP_SQL)
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@register("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read_table(spark, sf_dir, "documents"))


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@register("op9_exact_topk", TOPK_SQL)
def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@register("op10_pitman_yor")
def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read_table(spark, sf_dir, "documents"))


@register("op3_repeats")
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept", "spans")


@register("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_read(read_table(spark, sf_dir, "documents"))


FILL_IN_MIDDLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
  FROM documents),
k AS (
  SELECT doc_id, t, u, len(u) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS r1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS r2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (
  SELECT *, array_to_string(u[1:least(r1, r2)], '') AS p,
         array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS m,
         array_to_string(u[greatest(r1, r2) + 1:], '') AS s
  FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""


@register("op11_fill_in_middle", FILL_IN_MIDDLE_SQL)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.transform(read_table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"),
    )


# Rebuilt conversations, their prefixes, and for each node the sums over the
# nodes beneath it; CRC-32 is folded over the bits of the decimal id.
PREFIX_TRIE_SQL = r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
         sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id AS c, conv_id - conv_id % 20 AS base, max(i) AS own_len,
         xor(list_reduce(list_concat([4294967295],
             flatten([[256 + ascii(x), 0, 0, 0, 0, 0, 0, 0, 0] FOR x IN string_split(CAST(conv_id AS VARCHAR), '')])),
           lambda a, e: CASE WHEN e >= 256 THEN xor(a, e - 256)
                             WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4 AS h
  FROM own GROUP BY conv_id),
given AS (SELECT ids.*, least(h, coalesce((SELECT max(i) FROM own WHERE own.conv_id = base), 0)) AS g FROM ids),
turn AS (
  SELECT c, i, t, w FROM given JOIN own ON own.conv_id = base AND i <= g
  UNION ALL SELECT c, i - h + g, t, w FROM given JOIN own ON own.conv_id = c AND i > h),
whole AS (
  SELECT given.c, coalesce(list(t ORDER BY i) FILTER (t IS NOT NULL), []) AS p,
         coalesce(list(w ORDER BY i) FILTER (t IS NOT NULL), []) AS w
  FROM given LEFT JOIN turn ON turn.c = given.c GROUP BY given.c),
member AS (
  SELECT c, d, len(p) AS n, array_to_string(p[1:d], ' ') AS k, array_to_string(p[1:d - 1], ' ') AS up,
         CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w
  FROM (SELECT c, p, w, unnest(range(0, len(p) + 1)) AS d FROM whole)),
node AS (
  SELECT d, k, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends
  FROM member GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
sums AS (
  SELECT m.d, m.k, sum((v.n_convs - 1) * v.w) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
  FROM node v LEFT JOIN kids ON kids.d = v.d AND kids.k = v.k JOIN member m ON m.c = v.conv_id AND m.d <= v.d
  GROUP BY m.d, m.k)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs,
       coalesce(kids.n, 0) AS n_children, sums.leaves AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens,
       v.ends AS ends_sha256
FROM node v JOIN sums ON sums.d = v.d AND sums.k = v.k
LEFT JOIN kids ON kids.d = v.d AND kids.k = v.k LEFT JOIN node u ON u.d = v.d - 1 AND u.k = v.up
"""


@register("op12_prefix_trie", PREFIX_TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(read_table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.share_heads(turns))


SET_JOIN_SQL = (
    NEAR_DUP_SQL.replace("len(w) < 5", "len(w) < 4")
    .replace("w[i:i + 4]", "w[i:i + 3]")
    .replace("len(w) - 3, 2", "len(w) - 2, 2")
    .replace("100 * c >= 75", "100 * c >= 85")
    .replace(",\n       coalesce(c.c, d.doc_id) = d.doc_id AS kept", "")
)


@register("op13_set_join", SET_JOIN_SQL)
def op13_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_join(read_table(spark, sf_dir, "documents"))
