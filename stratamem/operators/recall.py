"""Hybrid recall: a vector leg and a lexical leg, fused by reciprocal ranks and weighted.

All filters stand before each leg's limit, legs carry only id and score, and the wide rows
are fetched for the few fused ids. Every order ends in the id, so results are determined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratamem.functions import scope, text, vectors
from stratamem.operators.lifecycle import profiles

#: Rank constant, least fan-out of a leg, decay of recency in seconds.
RRF_K, FAN_OUT, DECAY_S = 60, 50, 2_592_000.0


def _ranked(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The top ``limit`` rows and their places; the window sees no more than those."""
    return df.orderBy(*order).limit(limit).withColumn("rnk", F.row_number().over(Window.orderBy(*order)))


def vector_leg(rows: DataFrame, query: Column, limit: int, vec: str = "embedding") -> DataFrame:
    """``(id, dist, rnk)`` of the rows nearest to ``query`` by cosine distance, rounded to 9 digits."""
    scored = rows.where(F.col(vec).isNotNull()).select("id", F.round(vectors.cosine_distance(F.col(vec), query), 9).alias("dist")).where("dist is not null")
    return _ranked(scored, [F.col("dist"), F.col("id")], limit)


def lexical_leg(rows: DataFrame, query: str, limit: int, content: str = "content") -> DataFrame:
    """``(id, lr, rnk)`` of the rows that hold every query token, by summed term frequency."""
    asked = text.query_tokens(query)
    toks = rows.select("id", text.tokens(F.col(content)).alias("toks")).where(text.lexical_match(F.col("toks"), asked))
    return _ranked(toks.select("id", text.lexical_rank(F.col("toks"), asked).alias("lr")), [F.desc("lr"), F.col("id")], limit)


def fuse(*legs: DataFrame) -> DataFrame:
    """``(id, rrf)``: the sum of 1 / (60 + rank) over the legs that have the row."""
    both = legs[0].select("id", "rnk")
    for leg in legs[1:]:
        both = both.unionAll(leg.select("id", "rnk"))
    return both.groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(RRF_K) + F.col("rnk"))).alias("rrf"))


def recency(now: Column, valid_from: str = "valid_from") -> Column:
    """exp(-age / 30 days); what is not yet valid counts as new, and so does no date."""
    age = (F.unix_micros(now) - F.unix_micros(F.col(valid_from))) / 1e6
    return F.coalesce(F.exp(-F.greatest(F.lit(0.0), age) / DECAY_S), F.lit(1.0))


def confidence_weight(confidence: str = "confidence") -> Column:
    return F.lit(0.5) + F.lit(0.5) * F.col(confidence).cast("double")


def recall(
    memory: DataFrame,
    now: Column,
    query_vector: Column | None = None,
    query_text: str | None = None,
    limit: int | None = None,
    actor: str | None = None,
    tags: Sequence[str] = (),
    where: Column | None = None,
    as_of: Column | None = None,
    include_forgotten: bool = False,
    rewriter: Callable[[str], str] | None = None,
    threshold: float | None = None,
) -> DataFrame:
    """The best rows of a tenant's ``memory`` with their ``score``, best first.

    ``as_of`` only moves the instant that recency is measured from. ``rewriter`` replaces the
    text that is searched for; a blank rewrite leaves it. ``threshold`` keeps what scores that
    share of the best one, out of four times as many rows. Needs a vector, a text or both; a
    row in one leg only keeps that leg's term. Rows without content or embedding can still be
    found by the other leg.
    """
    asked = scope.clamp_limit(limit)
    n = asked if threshold is None else over_fetch(asked)
    fan = max(FAN_OUT, n)
    gate = scope.live_or_forgotten(now) if include_forgotten else scope.live(now)
    rows = memory.where(gate & scope.has_all_tags(tags))
    if actor is not None:
        rows = rows.where(F.col("actor_id") == actor)
    if where is not None:
        rows = rows.where(where)
    if rewriter is not None and query_text is not None:
        query_text = rewriter(query_text).strip() or query_text
    legs = []
    if query_vector is not None:
        legs.append(vector_leg(rows, query_vector, fan))
    if query_text is not None:
        legs.append(lexical_leg(rows, query_text, fan))
    if not legs:
        raise ValueError("recall needs a query vector or a query text")
    fused = fuse(*legs)  # at most twice the fan-out
    weighted = rows.join(F.broadcast(fused), "id").withColumn("score", F.round(F.col("rrf") * recency(as_of if as_of is not None else now) * confidence_weight(), 9))
    best = [F.desc("score"), F.desc_nulls_last("recorded_at"), F.col("id")]
    hits = weighted.drop("rrf").orderBy(*best).limit(n)
    return hits if threshold is None else relative_threshold(hits, threshold).orderBy(*best).limit(asked)


def profile_with_query(memory: DataFrame, tenant: str, actor: str, now: Column, query_text: str | None = None, query_vector: Column | None = None, **bounds) -> tuple[DataFrame, DataFrame | None]:
    """The actor's profile row and, unless the query is blank, what is recalled of the actor for it.

    ``bounds`` (limit, tags, where, rewriter) apply to the recall only, never to the profile.
    """
    rows = memory.where((F.col("tenant_id") == tenant) & (F.col("actor_id") == actor))
    asked = bool(query_text and query_text.strip())
    return profiles(rows, now), recall(rows, now, query_vector, query_text, actor=actor, **bounds) if asked else None


def search_chunks(chunks: DataFrame, query_text: str | None = None, query_vector: Column | None = None, limit: int | None = None, tags: Sequence[str] = (), documents: DataFrame | None = None) -> DataFrame:
    """The best chunks with their fused ``score``; a document filter is a semi-join before the legs."""
    n = scope.clamp_limit(limit, most=200)
    fan = max(FAN_OUT, n)
    rows = chunks.where(scope.has_all_tags(tags)) if tags else chunks
    if documents is not None:
        rows = rows.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    legs = []
    if query_vector is not None:
        legs.append(vector_leg(rows, query_vector, fan))
    if query_text is not None:
        legs.append(lexical_leg(rows, query_text, fan))
    if not legs:
        raise ValueError("a search needs a query vector or a query text")
    return rows.join(F.broadcast(fuse(*legs)), "id").withColumn("score", F.round("rrf", 9)).drop("rrf").orderBy(F.desc("score"), "id").limit(n)


def group_by_document(hits: DataFrame, limit: int) -> DataFrame:
    """``(document_id, score, pos, chunks)``: documents in order of their first hit.

    ``hits`` is a bounded search result; ``chunks`` lists the hits' contents in hit order.
    """
    placed = hits.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    parts = F.array_sort(F.collect_list(F.struct("pos", "content")))
    docs = placed.groupBy("document_id").agg(F.max("score").alias("score"), F.min("pos").alias("pos"), F.transform(parts, lambda x: x["content"]).alias("chunks"))
    return docs.orderBy("pos").limit(limit)


def chunk_budget(limit: int) -> int:
    return max(50, min(200, 8 * limit))


def over_fetch(limit: int) -> int:
    return min(4 * limit, 200)


def relative_threshold(hits: DataFrame, share: float) -> DataFrame:
    """The hits whose score is at least ``share`` of the best one; all of them if that is not positive."""
    top = F.max("score").over(Window.partitionBy())  # hits are few
    return hits.withColumn("top", top).where((F.col("top") <= 0) | (F.col("score") / F.col("top") >= share)).drop("top")


def concat_modes(memories: DataFrame, documents: DataFrame) -> DataFrame:
    """Memories first, documents after, each in its order: ``(src_ord, pos, id, content, score)``."""
    parts = []
    for k, hits in enumerate((memories, documents)):
        pos = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
        parts.append(hits.select(F.lit(k).alias("src_ord"), pos.alias("pos"), F.col("id").cast("string").alias("id"), "content", "score"))
    return parts[0].unionAll(parts[1]).orderBy("src_ord", "pos")


def search(mode: str, memories: Callable[[], DataFrame], documents: Callable[[], DataFrame]) -> DataFrame:
    """The hits of a mode: ``memories``, ``documents``, or ``hybrid`` (both, memories first)."""
    if mode not in ("memories", "documents", "hybrid"):
        raise ValueError(f"no search mode {mode!r}")
    if mode == "hybrid":
        return concat_modes(memories(), documents())
    hits = memories() if mode == "memories" else documents()
    return concat_modes(hits, hits.limit(0))


def bm25_leg(rows: DataFrame, query: str, limit: int, content: str = "content", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(id, bm25, rnk)`` of the rows that hold any analysed query token, by Okapi BM25 over ``rows``."""
    asked = sorted(set(query.lower().split()))
    stems_of = rows.sparkSession.createDataFrame([(" ".join(asked),)], "q string").select(F.array_distinct(text.stems(F.col("q"))).alias("asked"))
    docs = rows.where(F.col(content).isNotNull()).select("id", text.stems(F.col(content)).alias("toks"))
    size = docs.agg(F.count("*").alias("n"), F.avg(F.size("toks")).alias("mean"))
    hits = docs.join(F.broadcast(stems_of)).where(F.arrays_overlap("toks", "asked"))
    each = hits.select("id", F.size("toks").alias("len"), F.explode("asked").alias("term"), "toks").select("id", "len", "term", F.size(F.filter("toks", lambda t: t == F.col("term"))).alias("tf")).where("tf > 0")
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    scored = each.join(F.broadcast(df), "term").join(F.broadcast(size))  # as many rows as the query has terms, and one
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return _ranked(scored.groupBy("id").agg(F.round(F.sum(part), 6).alias("bm25")), [F.desc("bm25"), F.col("id")], limit)


def rerank(hits: DataFrame, query: str, reranker: Callable[[str, list[str]], list[tuple[int, float]]], limit: int, pool: int = 50) -> DataFrame:
    """The first ``pool`` hits in the order a callable gives.

    The pool is bounded and goes to the driver. Indices out of range or given twice are
    dropped, hits left out follow in their old order, and an error leaves the order.
    """
    rows = hits.orderBy(F.desc("score"), "id").limit(max(limit, pool)).collect()
    try:
        order = [i for i, _ in reranker(query, [r["content"] for r in rows])]
    except Exception:  # the reranker is a foreign service; retrieval order is the fallback
        order = []
    seen: list[int] = []
    for i in order:
        if 0 <= i < len(rows) and i not in seen:
            seen.append(i)
    seen += [i for i in range(len(rows)) if i not in seen]
    places = [(rows[i]["id"], k + 1) for k, i in enumerate(seen[:limit])]
    ids = hits.schema["id"].dataType.simpleString()
    return hits.join(F.broadcast(hits.sparkSession.createDataFrame(places, f"id {ids}, rerank_pos int")), "id").orderBy("rerank_pos")
