"""The k most similar vectors of every vector, by balanced posting lists.

Centroids are fitted on a bounded sample; every vector is indexed. Each vector is stored in
the list of its nearest centroid and, if it lies near a border, in further lists whose
centroids are almost as near. Centroids are found by a best-first walk over a graph of
centroid neighbours that is held in memory. A query searches the lists whose centroids are
within a ratio of its nearest one. Lists that grow beyond a size are scanned in blocks, so no
task holds an unbounded list.

Distances are Euclidean distances of unit vectors, which order as the cosine does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stratamem.session import materialize

#: Most vectors that centroids are fitted on.
SAMPLE = 100_000
#: Most centroids; with the graph they are what is broadcast (DIM * 4 + DEGREE * 4 bytes each).
MOST_CENTROIDS = 8192
DEGREE = 24
#: Vectors per list aimed at, and vectors of a list in one block.
LIST_SIZE = 120
BLOCK = 4096


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part: exactly ``dim`` finite components, not all zero."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).alias("v"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) == dim))
        .where(finite & F.exists(v, lambda x: x != 0))
    )


def _unit(column: pa.ListArray, dim: int) -> np.ndarray:
    """Unit rows in double precision; scaled first, so that no square over- or underflows."""
    offsets = column.offsets.to_numpy()
    a = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].reshape(-1, dim).astype(np.float64)
    a = a / np.abs(a).max(axis=1, keepdims=True)
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def balanced_centroids(x: np.ndarray, count: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means on unit vectors with a penalty on full lists, so that lists come out even."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(count, len(x)), replace=False)].copy()
    penalty = np.zeros(len(c), np.float32)
    even = len(x) / len(c)
    for _ in range(rounds):
        own = np.concatenate([np.argmin(2 - 2 * x[a : a + 4096] @ c.T + penalty, axis=1) for a in range(0, len(x), 4096)])
        sizes = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        some, first = np.unique(own[order], return_index=True)
        c[some] = np.add.reduceat(x[order], first, axis=0)
        empty = np.flatnonzero(sizes == 0)
        if len(empty):  # an empty list splits a full one
            c[empty] = x[rng.choice(len(x), len(empty))]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        penalty = (0.02 * np.log1p(sizes / even)).astype(np.float32)
    return c.astype(np.float32)


def centroid_graph(c: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Each centroid's nearest centroids, some kept far for reach, as a table of places."""
    near = min(degree, len(c) - 1)
    out = np.zeros((len(c), near), np.int32)
    for a in range(0, len(c), 1024):
        sim = c[a : a + 1024] @ c.T
        sim[np.arange(len(sim)), np.arange(a, a + len(sim))] = -9
        out[a : a + 1024] = np.argpartition(-sim, near - 1, axis=1)[:, :near] if near else 0
    if near >= 8:  # a few long links keep the graph connected
        out[:, -3:] = np.random.default_rng(3).integers(0, len(c), (len(c), 3))
    return out


def walk(q: np.ndarray, c: np.ndarray, graph: np.ndarray, width: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest centroids of each row of ``q`` that a walk over the graph finds, and their similarities.

    All rows walk at once: a beam of the best seen, whose neighbours are scored each round,
    until no beam gets better.
    """
    start = q @ c[entries].T
    beam = min(width, len(c))
    top = min(beam, len(entries))
    at = np.argpartition(-start, top - 1, axis=1)[:, :top]
    best = np.full((len(q), beam), -1, np.int32)
    score = np.full((len(q), beam), -9.0, np.float32)
    best[:, :top], score[:, :top] = entries[at], np.take_along_axis(start, at, 1)
    explored = np.zeros((len(q), beam), bool)
    live = np.arange(len(q))
    while len(live):
        open_score = np.where(explored[live] | (best[live] < 0), -9.0, score[live])
        pick = np.argsort(-open_score, axis=1)[:, : min(4, beam)]
        worth = np.take_along_axis(open_score, pick, 1) > -9.0
        on = worth.any(axis=1)
        live, pick, worth = live[on], pick[on], worth[on]
        if not len(live):
            break
        mark = explored[live]
        np.put_along_axis(mark, pick, True, 1)
        explored[live] = mark
        from_ = np.where(worth, np.take_along_axis(best[live], pick, 1), best[live, :1])
        new = graph[from_].reshape(len(live), -1)
        sims = np.einsum("nd,nkd->nk", q[live], c[new])
        nodes = np.concatenate([best[live], new], axis=1)
        allsim = np.concatenate([score[live], sims.astype(np.float32)], axis=1)
        done = np.concatenate([explored[live], np.zeros(new.shape, bool)], axis=1)
        order = np.lexsort((~done, nodes), axis=1)  # a node seen twice keeps its explored copy
        nodes, allsim, done = (np.take_along_axis(z, order, 1) for z in (nodes, allsim, done))
        twice = np.zeros(nodes.shape, bool)
        twice[:, 1:] = nodes[:, 1:] == nodes[:, :-1]
        allsim[twice | (nodes < 0)] = -9.0
        keep = np.argsort(-allsim, axis=1)[:, :beam]
        best[live], score[live], explored[live] = (np.take_along_axis(z, keep, 1) for z in (nodes, allsim, done))
    return best, score


def _lists(known, dim: int, width: int, replicas: int, border: float, probes: int, reach: float):
    """Rows of the index (role 0) and of the queries (role 1), one per list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, graph, entries = known.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                q = _unit(part.column(1), dim).astype(np.float32)
                lists, sim = walk(q, c, graph, width, entries)
                order = np.argsort(-sim, axis=1)
                lists, sim = np.take_along_axis(lists, order, 1), np.take_along_axis(sim, order, 1)
                far = np.sqrt(np.maximum(2 - 2 * sim, 0))
                stored = (lists >= 0) & (far <= (1 + border) * far[:, :1] + 1e-6)
                stored[:, replicas:] = False
                asked = (lists >= 0) & (far <= (1 + reach) * far[:, :1] + 1e-6)
                asked[:, :2] |= lists[:, :2] >= 0
                asked[:, probes:] = False
                # A centroid that a nearer stored one shadows adds nothing new to the index.
                for j in range(1, min(replicas, lists.shape[1])):
                    for i in range(j):
                        between = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nd->n", c[lists[:, i]], c[lists[:, j]]), 0))
                        stored[:, j] &= ~(stored[:, i] & (between < 0.7 * far[:, j]))
                ids = part.column(0).to_numpy()
                for role, mask in ((0, stored), (1, asked)):
                    r, j = np.nonzero(mask)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lists[r, j], pa.int32()), pa.array(np.full(len(r), role), pa.int32()), pa.array(ids[r]), part.column(1).take(pa.array(r))],
                        names=["list", "role", "vec_id", "v"],
                    )

    return run


def _scan(dim: int, k: int):
    """Best ``k`` of each query within one list: index rows come first, queries stream over them."""

    def run(table):
        role, ids = table.column("role").to_numpy(), table.column("vec_id").to_numpy()
        v = _unit(table.column("v").combine_chunks(), dim)
        si, first = np.unique(ids[role == 0], return_index=True)
        s, qi, q = v[role == 0][first], ids[role == 1], v[role == 1]
        out = []
        for a in range(0, len(qi), 2048):
            ids = qi[a : a + 2048]
            if not len(si):
                break
            sim = np.round(q[a : a + 2048] @ s.T, 9)
            sim[ids[:, None] == si[None, :]] = -9
            top = min(k, len(si))
            # ids ascend along the rows, so a stable sort settles ties by the smaller id
            at = np.argsort(-sim, axis=1, kind="stable")[:, :top]
            r = np.repeat(np.arange(len(ids)), top)
            best = np.take_along_axis(sim, at, 1).ravel()
            ok = best > -9
            out.append((ids[r][ok], si[at.ravel()][ok], best[ok]))
        cols = [np.concatenate([x[i] for x in out]) if out else np.zeros(0) for i in range(3)]
        return pa.table({"vec_id": pa.array(cols[0], pa.int64()), "near_id": pa.array(cols[1], pa.int64()), "cosine": pa.array(cols[2], pa.float64())})

    return run


def nearest(vectors: DataFrame, id_col: str, vec_col: str, k: int = 5, dim: int = 64, replicas: int = 4, border: float = 0.15, probes: int = 16, reach: float = 0.35, width: int = 24) -> DataFrame:
    """``(vec_id, near_id, cosine, rank)``: the ``k`` most similar other vectors found for every vector.

    Only vectors of exactly ``dim`` finite components, not all zero, take part. The order is
    by cosine in double precision rounded to 9 decimals, then by the smaller id. Every usable
    vector is stored and asked; the search is approximate because it scans only the lists
    that ``reach`` and ``probes`` admit. A null id takes no part; of vectors with one id, one
    counts per list. Fewer than ``k`` others give fewer rows.
    """
    spark = vectors.sparkSession
    good = materialize(usable(vectors, id_col, vec_col, dim), "vectors")
    n = good.count()
    schema = "vec_id bigint, near_id bigint, cosine double"
    if n == 0:
        return spark.createDataFrame([], schema + ", rank int")
    # A sample by hash, of SAMPLE vectors as expected, for the centroids only.
    drawn = good.where(F.pmod(F.xxhash64("vec_id"), F.lit(2**31)) < int(min(1.0, SAMPLE / n) * 2**31) + 1).select("vec_id", "v").toArrow().sort_by("vec_id")
    x = drawn["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    c = balanced_centroids(x, max(1, min(MOST_CENTROIDS, n // LIST_SIZE, len(x))))
    entries = np.arange(0, len(c), max(1, len(c) // 256))
    known = spark.sparkContext.broadcast((c, centroid_graph(c), entries))
    rows = good.mapInArrow(_lists(known, dim, width, replicas, border, probes, reach), "list int, role int, vec_id bigint, v array<float>")
    # Full lists are cut into blocks of stored vectors, each of which all queries of the list visit;
    # queries are cut too, so neither side of a task is unbounded.
    lists = materialize(rows, "lists")
    sizes = lists.where("role = 0").groupBy("list").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(BLOCK))).cast("int").alias("blocks"))
    asked = lists.where("role = 1").groupBy("list").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(4 * BLOCK))).cast("int").alias("slices"))
    with_size = lists.join(sizes, "list").join(asked, "list")
    h = F.xxhash64("vec_id", F.lit(17))
    block = F.when(F.col("role") == 0, F.array(F.pmod(h, F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    slice_ = F.when(F.col("role") == 1, F.array(F.pmod(h, F.col("slices")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("slices") - 1))
    spread = with_size.withColumn("block", F.explode(block)).withColumn("slice", F.explode(slice_)).select("list", "block", "slice", "role", "vec_id", "v")
    found = spread.groupBy("list", "block", "slice").applyInArrow(_scan(dim, k), schema)
    each = found.groupBy("vec_id", "near_id").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "near_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def near_pairs(near: DataFrame) -> DataFrame:
    """``(vec_a, vec_b)``: pairs of which at least one is among the nearest of the other, smaller id first."""
    return near.select(F.least("vec_id", "near_id").alias("vec_a"), F.greatest("vec_id", "near_id").alias("vec_b")).distinct()
