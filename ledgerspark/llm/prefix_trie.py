"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns; conversations that start with it
are its members.  The trie is peeled from its greatest depth upwards: at each
depth the conversations that end there join the nodes that survived, equal
prefixes are merged, and each node's last turn is stripped, which regroups it
under its parent.  A merge adds up members, children, leaves and savings, so
a node is complete in the step that discovers it.

1. Turns become two 64-bit numbers that also hold their place; the prefix of d
   turns is the running xor of the first d (a window; no conversation is ever
   collected).  Prefixes are compared by 128 bits and depth.
2. Conversations with equal sequences become one class, peeled as one; the
   digest of its members' ids is streamed over sorted runs of ids.
3. Prefixes with over ``GROUP_ROWS`` rows beneath them are heavy.  The light
   subtrees that hang below them are dealt out by their top prefix and peeled
   in tasks, many in one pass over the levels, as arrays.
4. The heavy part is peeled by Spark, one aggregation a level: hot parents are
   summed up before the shuffle.  It has as many levels as the longest prefix
   that so many rows share, whatever the longest conversation.

Defined cases: rows without conv_id belong to no conversation; turns are
ordered by turn (null first), equal ones by their digest; null role or text is
empty; a conversation without turns is a member of the root only; a table
without conversations has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reach_package, scratch_path
from .docs import materialize

GROUP_ROWS = 4096  # a task's group holds at most so many rows, or one conversation
PASS_ROWS = 200_000  # rows peeled in one pass over the levels
RUN = 256  # ids joined in one row on the way to their digest
EMPTY = hashlib.sha256(b"").hexdigest()

_LIGHT = (
    "i long, p long, q long, pp long, pq long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, top boolean"
)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (place from 1), a and b (the identity of role and text), w
    (words of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(text, F.lit(1), role).alias("b"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "a", "b"))
    return turns.select("conv_id", place.cast("long").alias("i"), "a", "b", "w")


def share_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to share beginnings: the first h turns of
    conversation c - c % every (all if fewer, none if absent), then c's own
    after its first h; h = crc32(decimal c) % most.  Returns the turns and the
    ids, since a rebuilt conversation may have no turn."""
    turns = materialize(turns, "trie-own")
    h = F.crc32(F.col("conv_id").cast("string")) % most
    heads = (
        turns.filter((F.col("conv_id") % every == 0) & (F.col("i") < most))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("i", "a", "b", "w"))).alias("head"))  # under ``most`` turns
    )
    ids = turns.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    ids = ids.join(heads, "base", "left").select("conv_id", F.filter("head", lambda t: t["i"] <= h).alias("head"))
    given = F.when(F.col("head").isNull(), 0).otherwise(F.size("head"))
    ids = materialize(ids.withColumn("given", given), "trie-ids")
    given = ids.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.i", "t.a", "t.b", "t.w")
    own = (
        turns.filter(F.col("i") > h)
        .join(ids.select("conv_id", "given"), "conv_id")
        .select("conv_id", (F.col("i") - h + F.col("given")).alias("i"), "a", "b", "w")
    )
    return given.unionByName(own), ids.select("conv_id")


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row by node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.  turns: conv_id, i, a, b, w; ids: the
    conv_id of every conversation."""
    paths = materialize(_paths(turns), "trie-paths")
    last = paths.groupBy("conv_id").agg(F.max(F.struct("i", "p", "q")).alias("t"))
    whole = ids.join(last, "conv_id", "left").select(
        "conv_id", *[F.coalesce(f"t.{c}", F.lit(0).cast("long")).alias(c) for c in ("i", "p", "q")]
    )
    whole = materialize(whole, "trie-whole")
    classes = materialize(
        whole.groupBy("i", "p", "q").agg(F.min("conv_id").alias("low"), F.count("*").alias("n")), "trie-classes"
    )
    # one conversation a class from here on
    chosen = classes.select(F.col("low").alias("conv_id"), "n", F.col("i").alias("length"))
    paths = materialize(paths.join(chosen, "conv_id"), "trie-chosen")
    heavy = materialize(_heavy(paths), "trie-heavy")
    light = materialize(_peel_light(paths, heavy), "trie-light")
    upper = _peel_heavy(light.filter("top"), classes, heavy)

    parents = upper.select(
        (F.col("i") + 1).alias("i"), F.col("p").alias("pp"), F.col("q").alias("pq"), F.col("conv_id").alias("parent")
    )
    columns = ["i", "p", "q", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    below = light.filter("top").drop("parent_conv_id", "top").unionByName(upper)
    below = below.join(parents, ["i", "pp", "pq"], "left").withColumnRenamed("parent", "parent_conv_id")
    nodes = light.filter("NOT top").select(*columns).unionByName(below.select(*columns))
    return nodes.join(_ends(whole), ["i", "p", "q"], "left").select(
        "conv_id",
        F.col("i").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def _paths(turns: DataFrame) -> DataFrame:
    """conv_id, i, the prefix (p, q) that ends here, its parent (pp, pq), w."""
    x, y = F.xxhash64("i", "a", "b"), F.xxhash64("b", "i", "a")
    so_far = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = turns.select("conv_id", "i", "w", x.alias("x"), y.alias("y"))
    at = at.withColumns({"p": F.bit_xor("x").over(so_far), "q": F.bit_xor("y").over(so_far)})
    back = {"pp": F.col("p").bitwiseXOR(F.col("x")), "pq": F.col("q").bitwiseXOR(F.col("y"))}
    return at.withColumns(back).select("conv_id", "i", "p", "q", "pp", "pq", "w")


def _heavy(paths: DataFrame) -> DataFrame:
    """i, p, q, pp, pq, w of the prefixes with several classes and too many
    rows beneath them for one task, and of the root."""
    root = paths.sparkSession.sql("SELECT 0L AS i, 0L AS p, 0L AS q, 0L AS pp, 0L AS pq, 0L AS w")
    return (
        paths.groupBy("i", "p", "q")
        .agg(
            F.sum(F.col("length") - F.col("i") + 1).alias("rows"),
            F.count("*").alias("classes"),
            *[F.max(c).alias(c) for c in ("pp", "pq", "w")],
        )
        .filter((F.col("rows") > GROUP_ROWS) & (F.col("classes") > 1))
        .select("i", "p", "q", "pp", "pq", "w")
        .unionByName(root)
    )


def _peel_light(paths: DataFrame, heavy: DataFrame) -> DataFrame:
    """The nodes below the heavy prefixes; ``top`` ones hang on them."""
    light = paths.join(heavy.select("i", "p", "q"), ["i", "p", "q"], "left_anti")
    top = F.min(F.struct("i", "p", "q")).over(Window.partitionBy("conv_id"))
    light = light.withColumn("g", top).withColumn("gp", F.col("g.p")).withColumn("gq", F.col("g.q"))
    group = ["gp", "gq"]
    light = light.select(*group, "conv_id", "i", "p", "q", "pp", "pq", "w", "n")
    light = light.repartition(*group).sortWithinPartitions(*group, "conv_id", "i")
    reach_package(paths.sparkSession)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            x = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            if n >= PASS_ROWS:
                # up to the first row of another group
                ends = held[-1]
                same = (x["gp"] == ends["gp"][-1]) & (x["gq"] == ends["gq"][-1])
                cut = len(same) if same.all() else int(np.argmin(same))
                if cut < len(same):
                    held.append({c: v[:cut] for c, v in x.items()})
                    yield from peel(held)
                    x, held, n = {c: v[cut:] for c, v in x.items()}, [], 0
            if len(x["i"]):
                held.append(x)
                n += len(x["i"])
        if held:
            yield from peel(held)

    return light.mapInArrow(run, _LIGHT)


def peel(parts: list[dict[str, np.ndarray]]):
    """Peels whole groups: rows by class (conv_id) and depth."""
    x = {c: np.concatenate([part[c] for part in parts]) for c in parts[0]}
    gp, gq, conv, depth, p, q, w = (x[c] for c in ("gp", "gq", "conv_id", "i", "p", "q", "w"))
    new = np.concatenate(([True], (conv[1:] != conv[:-1]) | (gp[1:] != gp[:-1]) | (gq[1:] != gq[:-1])))
    start = np.flatnonzero(new)
    end = np.concatenate((start[1:], [len(conv)]))
    first, length = depth[start], depth[end - 1]  # depths of the group's top and of the last turn
    by_length = np.argsort(length, kind="stable")
    bounds = np.searchsorted(length[by_length], np.arange(length.max() + 2))
    none = np.zeros(0, np.int64)
    alive = {c: none for c in ("cls", "n", "low", "leaves", "saved")}
    done = []  # levels whose parents are still unknown, and the one before
    for d in range(int(length.max()), int(first.min()) - 1, -1):
        ended = by_length[bounds[d] : bounds[d + 1]]
        zero = np.zeros(len(ended), np.int64)
        cls = np.concatenate((alive["cls"], ended))
        if not len(cls):
            continue
        n = np.concatenate((alive["n"], x["n"][start[ended]]))
        low = np.concatenate((alive["low"], conv[start[ended]]))
        child = np.concatenate((np.ones(len(alive["cls"]), np.int64), zero))
        leaves = np.concatenate((alive["leaves"], zero))
        saved = np.concatenate((alive["saved"], zero))
        row = start[cls] + d - first[cls]  # the prefix of d turns
        order = np.lexsort((q[row], p[row]))
        sp, sq = p[row[order]], q[row[order]]
        head = np.flatnonzero(np.concatenate(([True], (sp[1:] != sp[:-1]) | (sq[1:] != sq[:-1]))))
        total = lambda v: np.add.reduceat(v[order], head)
        n, child, leaves, saved = total(n), total(child), total(leaves), total(saved)
        low = np.minimum.reduceat(low[order], head)
        of = np.empty(len(cls), np.int64)  # the node that each merged row became
        of[order] = np.repeat(np.arange(len(head)), np.diff(np.concatenate((head, [len(order)]))))
        if done:  # the survivors are the level below without its tops
            done[-1]["parent"][~done[-1]["top"]] = low[of[: len(alive["cls"])]]
        row, cls = row[order][head], cls[order][head]
        leaves[child == 0] = 1
        saved = saved + (n - 1) * w[row]
        top = first[cls] == d
        done.append(
            {"row": row, "low": low, "parent": np.zeros(len(low), np.int64), "n": n, "child": child,
             "leaves": leaves, "saved": saved, "top": top}
        )
        go = ~top
        alive = {"cls": cls[go], "n": n[go], "low": low[go], "leaves": leaves[go], "saved": saved[go]}
    level = {c: np.concatenate([part[c] for part in done]) for c in done[0]}
    row = level["row"]
    yield pa.RecordBatch.from_arrays(
        [
            *(pa.array(x[c][row]) for c in ("i", "p", "q", "pp", "pq")),
            pa.array(level["low"]),
            pa.array(level["parent"], mask=level["top"]),
            *(pa.array(level[c]) for c in ("n", "child", "leaves", "saved", "top")),
        ],
        names=[c.split()[0] for c in _LIGHT.split(", ")],
    )


def _peel_heavy(tops: DataFrame, classes: DataFrame, heavy: DataFrame) -> DataFrame:
    """The heavy nodes: i, p, q, pp, pq, conv_id, n_convs, n_children,
    n_leaves, saved_tokens.  One aggregation a level, from the deepest."""
    spark = tops.sparkSession
    zero = F.lit(0).cast("long")
    ended = materialize(
        classes.join(heavy.select("i", "p", "q"), ["i", "p", "q"], "left_semi").select(
            "i", "p", "q", F.col("low").alias("conv_id"), F.col("n").alias("n_convs"),
            zero.alias("child"), zero.alias("n_leaves"), zero.alias("saved_tokens"),
        ),
        "trie-ended",
    )

    def stripped(nodes: DataFrame) -> DataFrame:
        return nodes.select(
            (F.col("i") - 1).alias("i"), F.col("pp").alias("p"), F.col("pq").alias("q"),
            "conv_id", "n_convs", F.lit(1).cast("long").alias("child"), "n_leaves", "saved_tokens",
        )

    hung = materialize(stripped(tops), "trie-tops")
    path, survivors, schema = scratch_path(spark, "trie-upper"), None, None
    for d in range(heavy.agg(F.max("i")).first()[0], -1, -1):
        level = ended.unionByName(hung).filter(F.col("i") == d)
        if survivors is not None:
            level = level.unionByName(stripped(survivors))
        merged = level.groupBy("p", "q").agg(
            F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "child", "n_leaves", "saved_tokens")],
        )
        nodes = merged.join(heavy.filter(F.col("i") == d), ["p", "q"]).select(
            "i", "p", "q", "pp", "pq", "conv_id", "n_convs",
            F.col("child").alias("n_children"),
            F.when(F.col("child") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("w")).alias("saved_tokens"),
        )
        nodes.write.parquet(f"{path}/level={d}")
        schema = nodes.schema
        survivors = spark.read.schema(schema).parquet(f"{path}/level={d}")
    return spark.read.schema(schema).parquet(path).drop("level")


def _ends(whole: DataFrame) -> DataFrame:
    """i, p, q, ends_sha256: the digest of the ids of each class, ascending and
    joined by commas.  Ids are sorted over all tasks and joined in short runs;
    a class's runs are then read in order, one at a time, so a hot class costs
    one task a stream of few rows and no memory."""
    key = ["i", "p", "q"]
    by_id = whole.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    runs_schema = "i long, p long, q long, lowest long, run string"
    reach_package(whole.sparkSession)

    def join(batches):
        for batch in batches:
            conv = batch.column("conv_id").to_numpy()
            same = np.ones(len(conv), bool)
            for c in key:
                v = batch.column(c).to_numpy()
                same[1:] &= v[1:] == v[:-1]
            same[0] = False
            head = np.flatnonzero(~same)
            ends = np.concatenate((head[1:], [len(conv)]))
            long = np.flatnonzero(ends - head > RUN)
            cuts = np.unique(np.concatenate([head, *(np.arange(head[k], ends[k], RUN) for k in long)]))
            text = conv.astype(str).tolist()
            runs = [",".join(text[a:b]) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(conv)])]
            at = pa.array(cuts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in key), pa.array(conv[cuts]), pa.array(runs)],
                names=[*key, "lowest", "run"],
            )

    runs = materialize(by_id.mapInArrow(join, runs_schema), "trie-runs")

    def digest(batches):
        current, state = None, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*key, "run"))):
                if row[:3] != current:
                    if state is not None:
                        out.append((*current, state.hexdigest()))
                    current, state = row[:3], hashlib.sha256(row[3].encode())
                else:
                    state.update(b"," + row[3].encode())
            yield _digests(out)
        if state is not None:
            yield _digests([(*current, state.hexdigest())])

    return (
        runs.repartition(*key)
        .sortWithinPartitions(*key, "lowest")
        .mapInArrow(digest, "i long, p long, q long, ends_sha256 string")
    )


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["i", "p", "q", "ends_sha256"]
    )
