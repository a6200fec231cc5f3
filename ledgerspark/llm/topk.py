"""Exact top-k inner products by best-first search of an M-tree.

Vectors are brought to a metric: with M the largest norm, x becomes
(x, sqrt(M^2 - |x|^2)) and a query (q, 0), so a nearer vector is one with a
larger inner product.  The tree has a root of routing objects (a bounded
sample of rows), under each its pages: entries with their distance to the
routing object, cut into rings by it, and for each page its smallest and
largest such distance (covering radii) in the root.

A query visits pages in order of their lower distance bound, two first, which
set its floor (the k-th score so far), and then ever more, until no page's
bound beats the floor.  Inside a page,
entries whose stored distance to the routing object already rules them out
are skipped.  Scores are exact integer inner products; bounds are slack by a
rounding margin, so ties are always visited and go to the smaller id.

No row holds more than one vector, and a query goes to a task once for all the
pages that it visits there: pages that add up to ``CHUNK`` entries or so meet
the queries of ``GROUP_BLOCKS`` blocks in one task, whatever the table's size.

Pages hold about as many entries as there are pages, so small tables have a
tree too, but from ``LEAST_PAGE`` to ``PAGE``, and more only where there would
be over ``MAX_PAGES`` of them, so the root that every task holds has a fixed
bound.

Defined cases: rows without an id, null vectors and vectors with a null or
non-finite component take no part; vectors are compared with those of their
own length only; rows with the query's id are no candidates; repeated rows
count as often as they occur; with under k candidates all are returned; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reach_package
from .docs import materialize, release

PAGE = 4096
LEAST_PAGE = 32
MAX_PAGES = 200_000
MAX_ROUTES = 512
QUERY_BLOCK = 512
GROUP_BLOCKS = 32  # blocks of queries that meet a chunk at once
CHUNK = 16_384  # entries of a chunk of pages, about
MOST_TASKS = 2000
CELLS = 1 << 20  # of a matrix of distances
FIRST_PAGES = 2
WIDEN = 6
SCALE = 256


def integer_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and vec (floor of SCALE times each component), sound rows only."""
    e = F.col(embedding)
    sound = e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    vec = F.transform(e, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double"))
    return table.filter(sound & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), vec.alias("vec"))


def top_k(table: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each row that ``is_query`` holds for."""
    spark = table.sparkSession
    vectors = materialize(
        integer_vectors(table).withColumn("dim", F.size("vec")).withColumn(
            "norm2", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
        ),
        "topk-vectors",
    )
    lengths = vectors.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm2").alias("top")).collect()
    found = [
        _search(vectors.filter(F.col("dim") == r["dim"]), r["n"], r["top"], is_query, k)
        for r in lengths  # one row by length of vector
    ]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim) if dim else np.zeros((len(column), 0))


def _kind(top: float) -> type:
    """A type that holds the components of vectors of at most this norm."""
    return np.int16 if top < 2.0**30 else np.int32 if top < 2.0**60 else np.float64


def _packed(x: np.ndarray, top: float) -> pa.Array:
    """One binary value by vector."""
    return pa.array([row.tobytes() for row in x.astype(_kind(top))], pa.binary())


def _unpacked(column, dim: int, top: float) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, _kind(top)).reshape(len(column), dim) if data else np.zeros((len(column), dim))


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    rest = np.maximum(top - np.einsum("ij,ij->i", x, x), 0.0)
    return np.hstack([x, np.sqrt(rest)[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _search(vectors: DataFrame, n: int, top: float, is_query: Column, k: int) -> DataFrame:
    spark = vectors.sparkSession
    reach_package(spark)
    page = max(min(PAGE, max(LEAST_PAGE, math.isqrt(n))), math.ceil(n / MAX_PAGES))
    n_routes = min(MAX_ROUTES, max(1, math.ceil(n / page)))
    picked = (
        vectors.select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_routes).collect()
    )  # a bounded sample
    dim = len(picked[0]["vec"])
    routes = _lift(np.array([r["vec"] for r in picked], dtype=np.float64).reshape(len(picked), dim), top)
    # a computed distance is off by this at most: the square loses a few units
    # in the last place of the largest term
    slack = 4 * math.sqrt((abs(top) + 1.0) * (dim + 8) * 2.0**-50)

    entries = _assign(vectors, routes, dim, top, page)
    nodes = entries.groupBy("page").agg(
        F.first("route").alias("route"), F.min("dist").alias("low"), F.max("dist").alias("high"), F.count("*").alias("n")
    )
    nodes = nodes.orderBy("page").toPandas()  # MAX_PAGES rows or so
    nodes["chunk"] = ((nodes["n"].cumsum() - nodes["n"]) // CHUNK).astype("int32")

    queries = vectors.filter(is_query).select("vec_id", "vec")
    n_queries = queries.count()
    blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    # q: which row it is, an id may come with several vectors; written, so it stays
    queries = materialize(
        queries.repartition(blocks).withColumn("q", F.monotonically_increasing_id()), "topk-queries"
    )
    best, first, width = None, 0, FIRST_PAGES
    while first < len(nodes):
        last = len(nodes) <= FIRST_PAGES or (first > 0 and width * WIDEN * WIDEN >= len(nodes))
        visits = _visits(queries, best, k, nodes, routes, top, dim, slack, first, len(nodes) if last else first + width)
        visits = materialize(visits, f"topk-visits-{first}")
        asked = _with_floors(queries, best, k)
        seen = materialize(_scores(visits, entries, asked, nodes, blocks, routes, dim, top, k, slack), f"topk-seen-{first}")
        both = seen if best is None else best.unionByName(seen)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = materialize(
            both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"),
            f"topk-best-{first}",
        )
        release(spark, visits, seen)
        if last:
            break
        first, width = first + width, width * WIDEN
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(order).cast("int").alias("rank"), "vec_id", "score")


def _assign(vectors: DataFrame, routes: np.ndarray, dim: int, top: float, page: int) -> DataFrame:
    """vec_id, vec (packed), route, dist and page of each entry: its nearest
    routing object, cut by rings of the distance and, for a crowded ring, by hash."""
    step = max(1, CELLS // len(routes))

    def nearest(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                vec = _matrix(part.column("vec"), dim)
                d = _distances(_lift(vec, top), routes)
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id"),
                        _packed(vec, top),
                        part.column("mark"),
                        pa.array(at.astype(np.int32)),
                        pa.array(d[np.arange(len(at)), at]),
                    ],
                    names=["vec_id", "vec", "mark", "route", "dist"],
                )

    placed = materialize(
        vectors.select("vec_id", "vec", F.xxhash64("vec_id", "vec").alias("mark")).mapInArrow(
            nearest, "vec_id long, vec binary, mark long, route int, dist double"
        ),
        "topk-placed",
    )
    span = placed.groupBy("route").agg(
        F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")
    )
    span = span.withColumn("rings", F.ceil(F.col("n") / page))  # MAX_ROUTES rows
    ring = F.least(
        F.when(
            F.col("hi") > F.col("lo"), F.floor((F.col("dist") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("rings"))
        ).otherwise(0),
        F.col("rings") - 1,
    )
    ringed = placed.join(F.broadcast(span), "route").withColumn("ring", ring)
    crowd = ringed.groupBy("route", "ring").agg(F.ceil(F.count("*") / page).alias("parts"))
    page_of = F.concat_ws("-", "route", "ring", F.pmod("mark", F.col("parts")))
    placed_in = ringed.join(crowd, ["route", "ring"]).select("vec_id", "vec", "route", "dist", page_of.alias("page"))
    return materialize(placed_in, "topk-entries")


def _with_floors(queries: DataFrame, best: DataFrame | None, k: int) -> DataFrame:
    """queries + floor: the score to reach, minus infinity under k found."""
    if best is None:
        return queries.withColumn("floor", F.lit(-math.inf))
    floors = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    floors = floors.select(
        F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("s").cast("double")).alias("floor")
    )
    return queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-math.inf)))


def _visits(queries, best, k, nodes, routes, top, dim, slack, first, last) -> DataFrame:
    """page, q_ids and where they meet: for each page the queries (by q) of a
    block for which it stands between ``first`` and ``last`` in order of its
    bound and may still hold an entry that counts."""
    route, chunk = nodes["route"].to_numpy(), nodes["chunk"].to_numpy()
    low, high = nodes["low"].to_numpy(), nodes["high"].to_numpy()
    names = nodes["page"].tolist()
    step = max(1, CELLS // len(names))

    def visited(q, floor):
        lifted = np.hstack([q, np.zeros((len(q), 1))])
        d = _distances(lifted, routes)[:, route]
        bound = np.maximum(np.maximum(low - d, d - high), 0.0)
        order = np.argsort(bound, axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(names))[None, :], axis=1)
        return (place >= first) & (place < last) & (bound <= _reach(q, floor, top, slack)[:, None])

    def run(batches):
        for batch in batches:
            rows = batch.column("q").to_numpy()
            group = (rows >> 33) // GROUP_BLOCKS  # the upper bits are the block
            floor = batch.column("floor").to_numpy(zero_copy_only=False)
            vec = _matrix(batch.column("vec"), dim)
            for g in np.unique(group):
                mine = np.flatnonzero(group == g)
                for i in range(0, len(mine), step):
                    w = mine[i : i + step]
                    open_ = visited(vec[w], floor[w])
                    use = np.flatnonzero(open_.any(axis=0))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([names[j] for j in use], pa.string()),
                            pa.array(use.astype(np.int32)),
                            pa.array(chunk[use]),
                            pa.array(np.full(len(use), g, dtype=np.int32)),
                            pa.array([rows[w[open_[:, j]]].tobytes() for j in use], pa.binary()),
                        ],
                        names=["page", "node", "chunk", "grp", "q_ids"],
                    )

    return (
        _with_floors(queries, best, k)
        .select("q", "vec", "floor")
        .mapInArrow(run, "page string, node int, chunk int, grp int, q_ids binary")
    )


def _reach(q: np.ndarray, floor: np.ndarray, top: float, slack: float) -> np.ndarray:
    """The distance within which an entry's score can be ``floor`` or more."""
    with np.errstate(invalid="ignore"):
        d2 = np.einsum("ij,ij->i", q, q) + top - 2 * floor
    return np.sqrt(np.maximum(d2, 0.0)) + slack


def _scores(visits, entries, asked, nodes, blocks, routes, dim, top, k, slack) -> DataFrame:
    """The k best entries that each query meets in a chunk's visited pages."""
    spark = visits.sparkSession
    route = nodes["route"].to_numpy()

    def packed(batches):  # each query once by batch
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("q"), batch.column("vec_id"), batch.column("floor"), _packed(_matrix(batch.column("vec"), dim), top)],
                names=["q", "vec_id", "floor", "vec"],
            )

    def callers(batches):
        for batch in batches:
            where = batch.column("chunk").to_numpy()
            group = batch.column("grp").to_numpy()
            ids = batch.column("q_ids").to_pylist()
            for c, g in np.unique(np.stack([where, group], axis=1), axis=0):
                rows = np.flatnonzero((where == c) & (group == g))
                q = np.unique(np.frombuffer(b"".join(ids[i] for i in rows), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(q), c)), pa.array(np.full(len(q), g)), pa.array(q)], names=["chunk", "grp", "q"]
                )

    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        e, q, v = (table.filter(pa.array(kind == i)) for i in range(3))
        order = np.argsort(e["node"].to_numpy(), kind="stable")
        node, ids, dist = (e[n].to_numpy()[order] for n in ("node", "id", "x"))
        vec = _unpacked(e["data"], dim, top)[order]
        # a query is sent for each batch of visits that names it
        rows, at = np.unique(q["q"].to_numpy(), return_index=True)
        q_id, floor, q_vec = q["id"].to_numpy()[at], q["x"].to_numpy()[at], _unpacked(q["data"], dim, top)[at]
        met = [(np.zeros(0, dtype=np.int64),) * 3]
        for j, names in zip(v["node"].to_numpy(), v["data"].to_pylist()):
            a, b = np.searchsorted(node, (j, j + 1))
            w = np.searchsorted(rows, np.frombuffer(names, np.int64))
            i, found, score = _page(
                ids[a:b], dist[a:b], vec[a:b], q_id[w], q_vec[w].astype(np.float64), floor[w], routes[route[j]], top, k, slack
            )
            met.append((w[i], found, score))
        who, found, score = (np.concatenate(x) for x in zip(*met))
        order = np.lexsort((found, -score, who))
        who, found, score = who[order], found[order], score[order]
        best = np.arange(len(who)) - np.searchsorted(who, who) < k
        return pa.table({"query_id": q_id[who[best]], "vec_id": found[best], "score": score[best]})

    columns = ["chunk", "grp", "kind", "node", "q", "id", "x", "data"]
    none = F.lit(None)
    wanted = visits.select("node", "page", "chunk", "grp").distinct()
    entry = entries.join(wanted, "page").select(
        "chunk", "grp", F.lit(0).alias("kind"), "node", none.cast("long").alias("q"),
        F.col("vec_id").alias("id"), F.col("dist").alias("x"), F.col("vec").alias("data"),
    )
    sent = visits.select("chunk", "grp", "q_ids").mapInArrow(callers, "chunk int, grp int, q long")
    small = asked.select("q", "vec_id", "floor", "vec").mapInArrow(packed, "q long, vec_id long, floor double, vec binary")
    query = sent.join(small, "q").select(
        "chunk", "grp", F.lit(1).alias("kind"), none.cast("int").alias("node"), "q",
        F.col("vec_id").alias("id"), F.col("floor").alias("x"), F.col("vec").alias("data"),
    )
    visit = visits.select(
        "chunk", "grp", F.lit(2).alias("kind"), "node", none.cast("long").alias("q"),
        none.cast("long").alias("id"), none.cast("double").alias("x"), F.col("q_ids").alias("data"),
    )
    meet = entry.select(columns).unionByName(query.select(columns)).unionByName(visit.select(columns))
    places = int(nodes["chunk"].max() + 1) * math.ceil(blocks / GROUP_BLOCKS)
    tasks = min(MOST_TASKS, max(places, spark.sparkContext.defaultParallelism))
    return (
        meet.repartition(tasks, "chunk", "grp")
        .groupBy("chunk", "grp")
        .applyInArrow(run, "query_id long, vec_id long, score long")
    )


def _page(ids, dist, vec, q_ids, q, floor, route, top, k, slack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the query, id and score of a page's entries that may count."""
    to_route = _distances(np.hstack([q, np.zeros((len(q), 1))]), route[None, :])[:, 0]
    reach = _reach(q, floor, top, slack) + slack
    near = np.zeros(len(ids), dtype=bool)
    # entries in order of distance: each query can reach an interval of them
    order = np.argsort(dist)
    a = np.searchsorted(dist[order], to_route - reach, side="left")
    b = np.searchsorted(dist[order], to_route + reach, side="right")
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    near[order] = np.cumsum(edge[:-1]) > 0
    ids, vec = ids[near], vec[near].astype(np.float64)
    limit = (np.abs(q).max(initial=0) * np.abs(vec).max(initial=0)) * max(1, q.shape[1])
    if limit < 2.0**53:
        score = (q @ vec.T).astype(np.int64)
    else:  # beyond exact doubles: 64-bit integers
        score = q.astype(np.int64) @ vec.astype(np.int64).T
    use = (ids[None, :] != q_ids[:, None]) & (score >= floor[:, None])
    if len(ids) > 4 * k:  # drop what is under the k-th score, ties kept
        least = np.partition(np.where(use, score, np.iinfo(np.int64).min), len(ids) - k, axis=1)[:, len(ids) - k]
        use &= score >= least[:, None]
    i, j = np.nonzero(use)
    return i, ids[j], score[i, j]
