"""What happens to stored facts: new versions, forgetting, erasure, profiles.

State is DataFrames; each transition maps tables to tables and takes the instant as a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratamem.functions import scope
from stratamem.functions.keys import normalize_key
from stratamem.functions.text import profile_text
from stratamem.operators.resolve import BAR

#: Most lines of the two parts of a profile.
STATIC_LINES, DYNAMIC_LINES = 50, 20


def versioned_update(memory: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """``memory`` after ``edits`` (``id, new_id, content, metadata``, one per id).

    Each current row that is edited is superseded and closed in recording time, its period of
    validity left alone. The new version inherits tags, class and confidence, starts now, and
    carries no triple. Edits of rows that are not current change nothing.
    """
    cols = memory.columns
    e = edits.select(F.col("id").alias("_id"), "new_id", F.col("content").alias("_content"), F.col("metadata").alias("_metadata"))
    joined = memory.join(e, (memory["id"] == e["_id"]) & scope.current(), "left")
    hit = F.col("_id").isNotNull()
    old = {"status": F.when(hit, F.lit("superseded")).otherwise(F.col("status")), "is_latest": F.col("is_latest") & ~hit, "recorded_to": F.when(hit, now).otherwise(F.col("recorded_to"))}
    null = {c: F.lit(None).cast(memory.schema[c].dataType) for c in ("subject", "attribute", "value", "source_id") if c in cols}
    new = null | {
        "id": F.col("new_id"),
        "content": F.col("_content"),
        "metadata": F.coalesce("_metadata", F.lit("{}")),
        "version": F.col("version") + 1,
        "root_id": F.coalesce("root_id", "id"),
        "supersedes_id": F.col("id"),
        "single_valued": F.lit(False),
        "valid_from": now,
        "valid_to": F.lit(None).cast("timestamp"),
        "recorded_at": now,
        "recorded_to": F.lit(None).cast("timestamp"),
        "status": F.lit("active"),
        "is_latest": F.lit(True),
    }
    kept = joined.select(*[old.get(c, F.col(c)).alias(c) for c in cols])
    return kept.unionByName(joined.where(hit).select(*[new.get(c, F.col(c)).alias(c) for c in cols]))


def version_chain(memory: DataFrame) -> DataFrame:
    """``(id, other_id, version, is_parent)``: the other versions of every row that has some."""
    root = F.coalesce("root_id", "id")
    a = memory.select(F.col("id"), root.alias("root"), F.col("version").alias("own"))
    b = memory.select(F.col("id").alias("other_id"), root.alias("root"), "version")
    return a.join(b, "root").where("id <> other_id").select("id", "other_id", "version", (F.col("version") < F.col("own")).alias("is_parent"))


def _forgotten(memory: DataFrame, hit: Column, now: Column) -> DataFrame:
    """Rows that ``hit`` become forgotten; validity stays, and what they replaced stays replaced."""
    new = {
        "status": F.when(hit, F.lit("forgotten")).otherwise(F.col("status")),
        "is_latest": F.col("is_latest") & ~hit,
        "recorded_to": F.when(hit & (F.col("recorded_at") < now), now).otherwise(F.col("recorded_to")),
    }
    return memory.select(*[new.get(c, F.col(c)).alias(c) for c in memory.columns])


def forget_by_source(memory: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Active rows that stem from the given sources (``source_id``) are forgotten; again changes nothing."""
    s = sources.where("source_id is not null").select(F.col("source_id").alias("_s")).distinct()
    joined = memory.join(s, memory["source_id"] == s["_s"], "left").withColumn("_hit", F.col("_s").isNotNull() & (F.col("status") == "active"))
    return _forgotten(joined, F.col("_hit"), now).drop("_s", "_hit")


def forget_by_id(memory: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Active rows named by ``(actor_id, id)`` are forgotten; an id under another actor is not."""
    k = ids.select(F.col("actor_id").alias("_a"), F.col("id").alias("_i")).distinct()
    joined = memory.join(k, (memory["id"] == k["_i"]) & (memory["actor_id"] == k["_a"]), "left").withColumn("_hit", F.col("_i").isNotNull() & (F.col("status") == "active"))
    return _forgotten(joined, F.col("_hit"), now).drop("_a", "_i", "_hit")


def forget_by_content(memory: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """Current rows of the asked keys ``(tenant_id, actor_id, subject, attribute, value)`` are forgotten.

    Keys compare in normal form; a null or blank value asks for any, else values compare
    trimmed and without case. A key that is empty asks for nothing.
    """
    want = (
        asked.select("tenant_id", "actor_id", normalize_key(F.col("subject")).alias("s"), normalize_key(F.col("attribute")).alias("a"), F.lower(F.trim(F.coalesce("value", F.lit("")))).alias("v"))
        .where("s <> '' and a <> ''")
        .groupBy("tenant_id", "actor_id", "s", "a")
        .agg(F.collect_set("v").alias("_vs"))
        .select(*[F.col(c).alias(f"_{c}") for c in ("tenant_id", "actor_id", "s", "a")], "_vs")
    )
    m = memory
    cond = (m["tenant_id"] == want["_tenant_id"]) & (m["actor_id"] == want["_actor_id"]) & (normalize_key(m["subject"]) == want["_s"]) & (normalize_key(m["attribute"]) == want["_a"])
    joined = m.join(want, cond, "left")
    same = F.array_contains("_vs", "") | F.array_contains("_vs", F.lower(F.trim(F.coalesce("value", F.lit("")))))
    hit = F.col("_vs").isNotNull() & scope.current() & same
    return _forgotten(joined.withColumn("_hit", F.coalesce(hit, F.lit(False))), F.col("_hit"), now).select(*memory.columns)


def edges_left(edges: DataFrame, memory: DataFrame) -> DataFrame:
    """The edges of which neither end is forgotten: forgetting leaves no dangling edge."""
    gone = memory.where("status = 'forgotten'").select("tenant_id", F.col("id").alias("_gone"))
    for end in ("from_id", "to_id"):
        edges = edges.join(gone, (edges["tenant_id"] == gone["tenant_id"]) & (edges[end] == gone["_gone"]), "left_anti")
    return edges


def without_actor(tables: dict[str, DataFrame], tenant: str, actor: str, memory: str = "memory", edges: str | None = None) -> dict[str, DataFrame]:
    """Every table without one actor's rows; edges that touch their memories go too."""
    mine = (F.col("tenant_id") == tenant) & (F.col("actor_id") == actor)
    out = {name: df.where(~F.coalesce(mine, F.lit(False))) for name, df in tables.items() if name != edges}
    if edges:
        gone = tables[memory].where(mine).select(F.col("id").alias("_gone"))
        e = tables[edges]
        out[edges] = e.join(gone, e["from_id"] == gone["_gone"], "left_anti").join(gone, F.col("to_id") == gone["_gone"], "left_anti")
    if memory in out and "supersedes_id" in out[memory].columns:
        gone = tables[memory].where(mine).select(F.col("id").alias("_gone"))
        kept = out[memory].join(gone, F.col("supersedes_id") == F.col("_gone"), "left")
        out[memory] = kept.withColumn("supersedes_id", F.when(F.col("_gone").isNull(), F.col("supersedes_id"))).drop("_gone")
    return out


def profiles(memory: DataFrame, now: Column) -> DataFrame:
    """``(tenant_id, actor_id, static_facts, dynamic_ctx)``: up to 50 static and 20 dynamic lines of every actor.

    Static: lasting rows that are marked static or reach the confidence bar, surest first.
    Dynamic: all that has not expired, newest first, static rows included. Lines without text go after the cut.
    Actors without a line of either part have no row.
    """
    rows = memory.where(scope.live(now)).withColumn("txt", profile_text())
    static = F.col("forget_after").isNull() & (F.col("is_static") | (F.round(F.col("confidence").cast("double"), 6) >= BAR))
    who = ["tenant_id", "actor_id"]
    order = {
        "static_facts": (static, [F.desc("confidence"), F.desc("recorded_at"), F.desc("id")], STATIC_LINES),
        "dynamic_ctx": (F.lit(True), [F.desc("recorded_at"), F.desc("id")], DYNAMIC_LINES),
    }
    out = None
    for name, (cond, by, n) in order.items():
        top = rows.where(cond).withColumn("rn", F.row_number().over(Window.partitionBy(*who).orderBy(*by))).where(F.col("rn") <= n)
        lines = F.array_sort(F.collect_list(F.when(F.col("txt").isNotNull(), F.struct("rn", "txt"))))
        part = top.groupBy(*who).agg(F.transform(lines, lambda x: x["txt"]).alias(name))
        out = part if out is None else out.join(part, who, "full")
    none = F.array().cast("array<string>")
    return out.select(*who, *[F.coalesce(c, none).alias(c) for c in order])
