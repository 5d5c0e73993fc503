"""Sinks: everything held about one actor, as JSON or as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Derived columns that an export leaves out.
DERIVED = ("embedding", "content_tokens")


def actor_export(table: DataFrame, tenant: str, actor: str, order: str, tie: str = "id") -> DataFrame:
    """One row ``rows``: a JSON array of the actor's rows by ``order``; ``[]`` if there are none.

    One actor's rows form one value by definition of the export; write large actors as files
    with :func:`actor_rows` instead.
    """
    mine = actor_rows(table, tenant, actor)
    item = F.struct(F.col(order).alias("_o"), F.col(tie).alias("_t"), F.to_json(F.struct(*mine.columns)).alias("j"))
    parts = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"])
    return mine.agg(F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")).alias("rows"))


def actor_rows(table: DataFrame, tenant: str, actor: str) -> DataFrame:
    rows = table.where((F.col("tenant_id") == tenant) & (F.col("actor_id") == actor))
    return rows.drop(*DERIVED)


def actor_bundle(tables: dict[str, tuple[DataFrame, str, str]], profile: DataFrame, tenant: str, actor: str, now) -> DataFrame:
    """One row: tenant, actor, time of export, a JSON array per table (``frame, order, tie``), and the profile or null."""
    out = profile.where((F.col("tenant_id") == tenant) & (F.col("actor_id") == actor)).select(F.to_json(F.struct(*profile.columns)).alias("profile")).agg(F.max("profile").alias("profile"))
    for name, (frame, order, tie) in tables.items():
        out = out.crossJoin(actor_export(frame, tenant, actor, order, tie).withColumnRenamed("rows", name))  # one row each
    return out.select(F.lit(tenant).alias("tenant_id"), F.lit(actor).alias("actor_id"), now.alias("exported_at"), *tables, "profile")


def write_actor(tables: dict[str, DataFrame], tenant: str, actor: str, path: str) -> None:
    """Everything held about the actor as JSON lines, a folder a table: the form for an actor of any size."""
    for name, frame in tables.items():
        actor_rows(frame, tenant, actor).write.mode("overwrite").json(f"{path}/{name}")
