"""Mixing sources to target weights by hash-threshold histograms.

A document's place in its source is a 60-bit hash.  Sizes are summed by source
and hash bucket; the bucket in which the budget falls is the only one whose
documents are summed again by the next bits, until it holds one document.  The
mix is then a comparison of each document's hash with its source's threshold:
no sort, and thresholds of a larger budget contain those of a smaller one, but
for the document that straddles the smaller one.

Defined cases: null or wordless texts have size 0; a null source is a source
of its own, last in order; rows equal in doc_id and text share a hash and are
taken or left together; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .docs import materialize

HASH_BITS = 60
LEVEL_BITS = 10
SLACK = 0.002
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and the place in the source."""
    return docs.select(
        "doc_id",
        "source",
        n_words().alias("size"),
        place().alias("place"),
    )


def n_words():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def place():
    """60 hash bits of a document, the same on every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "text"), 64 - HASH_BITS)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """source, source_size, weight, target: the total size shared by weight,
    targets above ``cap`` times their source's size cut to that and the excess
    reshared by weight until none is above.

    Sources are numbered by a range-partitioned sort; only one total by
    partition reaches the driver, and each sharing round one row."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    ranked = materialize(
        by_source.repartitionByRange(order)
        .sortWithinPartitions(order)
        .withColumn("at", F.monotonically_increasing_id()),
        "mix-sources",
    )
    part = F.shiftright("at", 33)
    counts = ranked.groupBy(part.alias("part")).count().orderBy("part").collect()
    before, offsets = 0, {}
    for row in counts:
        offsets[row["part"]] = before
        before += row["count"]
    if not offsets:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"))
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), part)
    turn = (offset + F.col("at").bitwiseAND((1 << 33) - 1)) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("weight"))

    top = F.col("source_size") * cap
    share = 0.0
    while True:
        above = F.col("weight") * share > top
        row = ranked.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(above, top).otherwise(0.0)).alias("cut"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        again = (row["total"] - row["cut"]) / row["open"] if row["open"] else share
        if again <= share:
            break
        share = again
    return ranked.withColumn("target", F.least(F.col("weight") * share, top))


def thresholds(sizes: DataFrame, targets: DataFrame, fills: int = 3) -> DataFrame:
    """targets plus copies (whole passes over the source) and bands: a document
    within one of its source's bands is taken once more.

    The first band is everything under the budget's threshold.  A document that
    straddles the threshold is left out, if it exceeds the budget by more than
    ``SLACK`` of the source, and what it leaves open is filled, by
    a threshold of its own, from later documents that fit: ``fills`` bands.  When
    the fills end, a straddling document is taken in place of all that follows
    it if that brings the source nearer its target."""
    size = F.col("source_size").cast("double")
    copies = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int")
    plan = materialize(
        targets.withColumn("copies", copies)
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
        .select("source", "source_size", "target", "copies", "rest"),
        "mix-targets",
    )
    # whole passes meet a target without a rest
    state = plan.filter("rest > 0").select(
        "source",
        "rest",
        F.lit(0).cast("long").alias("after"),
        F.lit(1 << 62).cast("long").alias("largest"),
        (F.col("source_size") * SLACK).alias("slack"),
    )
    steps = None
    for fill in range(fills):
        edge = materialize(_edge(sizes, state), f"mix-band-{fill}")
        step = edge.select(
            "source", F.struct(F.lit(fill).alias("fill"), "after", "largest", "below", "left", "excess", "end").alias("step")
        )
        steps = step if steps is None else steps.unionByName(step)
        state = edge.filter("excess IS NOT NULL AND left > 0").select(
            "source",
            F.col("left").alias("rest"),
            F.col("end").alias("after"),
            F.floor("left").cast("long").alias("largest"),
            "slack",
        )
        if state.isEmpty():
            break
    bands = (
        steps.groupBy("source")
        .agg(F.sort_array(F.collect_list("step")).alias("steps"))
        .withColumn("over", F.expr("array_min(transform(filter(steps, s -> s.excess IS NOT NULL), s -> struct(s.excess, s.fill)))"))
        .withColumn("over", F.expr("IF(over.excess < abs(element_at(steps, -1).left), over.fill, NULL)"))
        .selectExpr(
            "source",
            """transform(
                 filter(steps, s -> over IS NULL OR s.fill <= over),
                 s -> struct(s.after, s.largest, IF(s.fill <=> over, s.end, s.below) AS below)) AS bands""",
        )
    )
    return plan.join(bands.withColumnRenamed("source", "s"), F.expr("source <=> s"), "left").select(
        "source", "source_size", "target", "copies", "bands"
    )


def _edge(sizes: DataFrame, state: DataFrame) -> DataFrame:
    """One row by source of ``state`` (source, rest, after, largest, slack): below,
    the place under which documents from ``after`` on, of ``largest`` words at
    most, add up to ``rest``; end, the place behind the one that straddles it;
    left, what is left of rest; excess, by how much the one that straddles it is
    over rest, null if there is none or it is taken.  Only the bucket that straddles the budget is
    summed again, by the next bits of the place."""
    opened = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("low", F.lit(0).cast("long"))
    settled = None
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        o = opened.withColumnRenamed("source", "s")
        inside = (
            sizes.join(o, F.expr("source <=> s AND size > 0"))
            .filter((F.col("place") >= F.col("after")) & (F.col("size") <= F.col("largest")))
            .withColumn("bucket", F.shiftright("place", shift))
            .filter(F.shiftright("bucket", LEVEL_BITS) == F.col("prefix"))
        )
        sums = inside.groupBy("source", "rest", "after", "largest", "slack", "low", "bucket").agg(
            F.sum("size").alias("size"), F.min("place").alias("a"), F.max("place").alias("b")
        )
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        over = F.col("upto") > F.col("rest")
        first = F.min_by(F.struct("bucket", "size", "upto", "a", "b"), F.when(over, F.col("bucket")))
        edge = (
            sums.withColumn("upto", F.sum("size").over(run) + F.col("low"))
            .groupBy("source", "rest", "after", "largest", "slack")
            .agg(F.max(over).alias("over"), F.max("upto").alias("all"), first.alias("e"))
            .select("source", "rest", "after", "largest", "slack", "over", "all", "e.*")
            .withColumn("low", F.col("upto") - F.col("size"))
        )
        edge = materialize(edge, f"mix-edge-{level}")
        done = ~F.col("over") | (F.col("a") == F.col("b")) | F.lit(shift == 0)
        excess = F.col("upto") - F.col("rest")
        take = excess <= F.col("slack")
        found = edge.filter(done).select(
            "source",
            "after",
            "largest",
            F.when(~F.col("over"), 1 << HASH_BITS).when(take, F.col("b") + 1).otherwise(F.col("a")).alias("below"),
            F.when(~F.col("over"), 1 << HASH_BITS).otherwise(F.col("b") + 1).alias("end"),
            (F.col("rest") - F.when(~F.col("over"), F.col("all")).when(take, F.col("upto")).otherwise(F.col("low"))).alias("left"),
            F.when(F.col("over") & ~take, excess).alias("excess"),
            "slack",
        )
        settled = found if settled is None else settled.unionByName(found)
        opened = edge.filter(~done).select(
            "source", "rest", "after", "largest", "slack", F.col("bucket").alias("prefix"), "low"
        )
        if shift == 0 or opened.isEmpty():
            break
    return settled


def passes(frame: DataFrame, plan: DataFrame) -> DataFrame:
    """frame (with source, size and place) plus source_size, target, n_passes.

    The join has no hint: Spark broadcasts a plan under its own size bound and
    otherwise shuffles, where adaptive execution splits a hot source."""
    in_band = F.exists(
        "bands",
        lambda b: (F.col("place") >= b["after"]) & (F.col("size") <= b["largest"]) & (F.col("place") < b["below"]),
    )
    return (
        frame.join(plan.withColumnRenamed("source", "mix_source"), F.expr("source <=> mix_source"), "left")
        .withColumn("n_passes", F.col("copies") + F.coalesce(in_band, F.lit(False)).cast("int"))
        .drop("mix_source", "copies", "bands")
    )


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target, n_passes, taken."""
    sizes = materialize(sized(docs), "mix-sizes")
    plan = thresholds(sizes, source_targets(sizes, weights, cap))
    return passes(sizes, plan).drop("place").withColumn("taken", F.col("size") * F.col("n_passes"))


def repeat(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    sizes = materialize(sized(docs), "mix-sizes")
    plan = thresholds(sizes, source_targets(sizes, weights, cap))
    rows = docs.select(F.struct("*").alias("row"), "source", n_words().alias("size"), place().alias("place"))
    taken = passes(rows, plan).filter("n_passes > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n_passes")))).select("row.*")
