"""The graph beside the memories: relation edges, entity mentions, and what they relate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from stratamem.functions import scope, text
from stratamem.operators.lifecycle import version_chain

RELATIONS = ("extends", "derives")


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` and the new ones; self-edges are skipped, repeats and known edges change nothing."""
    cols = ["tenant_id", "from_id", "to_id", "relation"]
    return edges.select(*cols).union(new.where("from_id <> to_id").select(*cols)).distinct()


def endpoints(edges: DataFrame, memory: DataFrame) -> DataFrame:
    """``(id, other_id, relation, outgoing, content)``: each edge from both its ends, the other end being current.

    A union of two directed views takes the place of a join on either end.
    """
    out = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other_id"), "relation", F.lit(True).alias("outgoing"))
    into = edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("other_id"), "relation", F.lit(False).alias("outgoing"))
    other = memory.where(scope.current()).select(F.col("id").alias("other_id"), "content")
    return out.unionAll(into).join(other, "other_id").select("id", "other_id", "relation", "outgoing", "content")


def recognised(memory: DataFrame, recogniser: Callable[[str], list[str]]) -> DataFrame:
    """As :func:`mentions`, by a callable that lists the surfaces of a text; blank ones are dropped, an error gives none."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for t, a, i, c in zip(pdf["tenant_id"], pdf["actor_id"], pdf["id"], pdf["content"]):
                try:
                    found = {s.strip().lower() for s in recogniser(c)}
                except Exception:  # the recogniser is a foreign service; mentions are best effort
                    found = set()
                out += [(t, a, i, s) for s in sorted(found) if s]
            yield pd.DataFrame(out, columns=["tenant_id", "actor_id", "id", "surface"])

    rows = memory.where("content is not null").select("tenant_id", "actor_id", "id", "content")
    return rows.mapInPandas(run, rows.drop("content").withColumn("surface", F.lit("")).schema)


def mentions(memory: DataFrame, least: int = 4, stop: Sequence[str] = ()) -> DataFrame:
    """``(tenant_id, actor_id, id, surface)``: the distinct tokens of each content that name something.

    A surface is a lower-cased run of ASCII letters and digits of at least ``least``
    characters that is no stop word and has a letter.
    """
    toks = F.array_distinct(F.filter(text.tokens(F.col("content")), lambda t: (F.length(t) >= least) & t.rlike("[a-z]") & (~t.isin(*stop) if stop else F.lit(True))))
    return memory.where("content is not null").select("tenant_id", "actor_id", "id", F.explode(toks).alias("surface"))


def related(seeds: DataFrame, said: DataFrame, limit: int = 10) -> DataFrame:
    """``(id, other_id, shared)``: for each seed ``id`` the rows of its tenant and actor that share most surfaces with it."""
    mine = said.join(seeds.select("id").distinct(), "id", "left_semi").select("tenant_id", "actor_id", F.col("id").alias("seed"), "surface")
    pairs = said.select("tenant_id", "actor_id", "id", "surface").join(mine, ["tenant_id", "actor_id", "surface"]).where("id <> seed")
    counts = pairs.groupBy("seed", "id").agg(F.count("*").alias("shared"))
    order = Window.partitionBy("seed").orderBy(F.desc("shared"), "id")
    return counts.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).select(F.col("seed").alias("id"), F.col("id").alias("other_id"), "shared")


def entities(said: DataFrame, limit: int = 50) -> DataFrame:
    """``(tenant_id, actor_id, surface, mentions)``: each actor's most mentioned surfaces."""
    counts = said.groupBy("tenant_id", "actor_id", "surface").agg(F.count("*").alias("mentions"))
    order = Window.partitionBy("tenant_id", "actor_id").orderBy(F.desc("mentions"), "surface")
    return counts.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).drop("rn")


def actor_documents(documents: DataFrame, tenant: str, actor: str) -> DataFrame:
    """``(document_id, title, received_at)``: all documents of the actor, newest first."""
    mine = documents.where((F.col("tenant_id") == tenant) & (scope.container_actor(F.col("container_tag")) == actor))
    return mine.orderBy(F.desc_nulls_last("received_at"), F.desc("document_id")).select("document_id", "title", "received_at")


def aggregate_context(hits: DataFrame, memory: DataFrame, edges: DataFrame, said: DataFrame, sources: DataFrame, limit: int = 10) -> DataFrame:
    """``(id, lane, via, other_id, value)``: what surrounds each hit of a truncated recall.

    Lanes: ``parent`` (earlier versions and the ends of outgoing edges), ``child`` (later
    versions and the starts of incoming ones), ``related`` (up to ``limit`` rows that share
    surfaces) and ``source``. ``value`` is the version or the number of shared surfaces.
    ``hits`` has an ``id`` a row; every other memory is of the hit's tenant and actor.
    """
    who = ["tenant_id", "actor_id"]
    wanted = F.broadcast(hits.select("id").distinct())  # bounded by the recall's limit
    own = memory.join(wanted, "id", "left_semi")
    root = F.coalesce("root_id", "id")
    roots = own.select(root.alias("_root")).distinct()
    chain = version_chain(memory.join(F.broadcast(roots), root == F.col("_root"), "left_semi")).join(wanted, "id", "left_semi")
    ends = wanted.select(F.col("id").alias("_hit"))
    near = edges.join(ends, (F.col("from_id") == F.col("_hit")) | (F.col("to_id") == F.col("_hit")), "left_semi")
    tied = endpoints(near, memory).join(wanted, "id", "left_semi")
    narrow = said.join(F.broadcast(own.select(*who).distinct()), who, "left_semi")
    alike = related(wanted, narrow, limit)
    none = F.lit(None).cast("bigint")
    lanes = chain.select("id", F.when(F.col("is_parent"), "parent").otherwise("child").alias("lane"), F.lit("version").alias("via"), "other_id", F.col("version").cast("bigint").alias("value"))
    lanes = lanes.unionAll(tied.select("id", F.when(F.col("outgoing"), "parent").otherwise("child"), "relation", "other_id", none))
    lanes = lanes.unionAll(alike.select("id", F.lit("related"), F.lit("entity"), "other_id", "shared"))
    mine = own.select("id", *who)
    other = memory.select(F.col("id").alias("other_id"), *who)
    scoped = lanes.join(F.broadcast(mine), "id").join(other, ["other_id", *who], "left_semi").select("id", "lane", "via", "other_id", "value")
    stems = own.join(sources.select("source_id").distinct(), "source_id", "left_semi")
    return scoped.unionAll(stems.select("id", F.lit("source"), F.lit("source"), F.col("source_id"), none))


def neighbours(memory: DataFrame, limit: int = 10) -> DataFrame:
    """``(id, other_id, rank)``: for each current row the newest others with its tenant, actor and subject.

    The newest ``limit + 1`` rows of a subject are enough for all its rows, so a subject with
    very many rows costs each of them a bounded number of pairs.
    """
    rows = memory.where(scope.current() & F.col("subject").isNotNull() & F.col("content").isNotNull()).select("tenant_id", "actor_id", "subject", "id", "recorded_at")
    key = ["tenant_id", "actor_id", "subject"]
    order = Window.partitionBy(*key).orderBy(F.desc_nulls_last("recorded_at"), F.desc("id"))
    newest = rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit + 1).select(*key, F.col("id").alias("other_id"), "pos")
    pairs = rows.join(newest, key).where("id <> other_id")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where(F.col("rank") <= limit).select("id", "other_id", "rank")


def classify_relations(pairs: DataFrame, memory: DataFrame, classifier: Callable[[str, list[str]], list[tuple[int, str]]]) -> DataFrame:
    """``(from_id, to_id, relation)`` that a callable finds between each row and its neighbours.

    Indices out of range and unknown relations are dropped; an error gives no edge.
    """
    content = memory.select(F.col("id").alias("_i"), F.col("content").alias("_c"))
    near = pairs.join(content, pairs["other_id"] == content["_i"]).select("id", "rank", "other_id", F.col("_c").alias("other"))
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "other_id", "other"))).alias("near"))
    rows = lists.join(content, lists["id"] == content["_i"]).select("id", F.col("_c").alias("content"), "near")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for i, text_, near_ in zip(pdf["id"], pdf["content"], pdf["near"]):
                others = list(near_)
                try:
                    found = classifier(text_, [n["other"] for n in others])
                except Exception:  # the classifier is a foreign service; edges are best effort
                    found = []
                out += [(i, others[k]["other_id"], rel) for k, rel in found if 0 <= k < len(others) and rel in RELATIONS]
            yield pd.DataFrame(out, columns=["from_id", "to_id", "relation"])

    kind = memory.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"from_id {kind}, to_id {kind}, relation string")
