"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .docs import materialize


def _thin(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u, v (both ways) and node, comp: few links that connect the same nodes,
    and a first label, a node reachable that is no larger, of each.

    Of a node's links to smaller ones all but the smallest are moved to it
    (small star), then its links to larger ones are (large star). In a dense
    group most of them fall together, so the links left follow its nodes."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("low")), "cc-least")
    small = materialize(
        down.join(least, "u")
        .filter("v != low")
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
        .unionByName(least.select("u", F.col("low").alias("v")))
        .distinct(),
        "cc-small",
    )
    both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = materialize(
        both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("comp")),
        "cc-labels",
    )
    large = small.join(labels.withColumnRenamed("node", "v"), "v").select("u", F.col("comp").alias("v"))
    both_ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = large.filter("u != v").distinct().select(F.explode(both_ways).alias("e")).select("e.*")
    return materialize(edges, "cc-edges"), labels


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for every node of ``links``
    (a, b); self-links and repeats are harmless, an empty table gives none.

    Each round every node takes the smallest label among its neighbours' and
    its label's own, and hands it to its old label, so paths shrink by a part
    each round whatever the order of their nodes.  Neighbours and label are
    asked for in one join: a label is one more neighbour, which brings the
    node's old label along.  The labels are written to the shared folder each
    round; hot nodes are aggregated before the shuffle and their joins are
    split by adaptive execution.  Rounds work on thinned links."""
    edges, labels = _thin(links)
    while True:
        none = F.lit(None).cast(labels.schema["comp"].dataType).alias("old")
        asked = edges.withColumn("old", none).unionByName(
            labels.select(F.col("node").alias("u"), F.col("comp").alias("v"), F.col("comp").alias("old"))
        )
        told = labels.select(F.col("node").alias("v"), F.col("comp").alias("low"))
        heard = (
            asked.join(told, "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("low").alias("low"), F.max("old").alias("old"))
            .select("node", F.least("old", "low").alias("low"), "old")
        )
        handed = F.struct(F.col("old").alias("node"), "low", none)
        after = materialize(
            heard.select(F.explode(F.array(F.struct("node", "low", "old"), handed)).alias("e"))
            .groupBy("e.node")
            .agg(F.min("e.low").alias("comp"), F.max("e.old").alias("old"))
            .select("node", "comp", (F.col("comp") < F.col("old")).alias("moved")),
            "cc-labels",
        )
        labels = after.select("node", "comp")
        if after.filter("moved").isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links (a, b), of which only those between two
    components count; nodes without a label so far may occur."""
    end = lambda n: labels.select(F.col("node").alias(n), F.col("comp").alias(f"of_{n}"))
    between = materialize(
        links.join(end("a"), "a", "left")
        .join(end("b"), "b", "left")
        .select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")),
        "cc-between",
    )
    top = components(between)
    moved = top.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    new = top.join(labels.select("node"), "node", "left_anti")
    return labels.join(moved, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")).unionByName(new)
