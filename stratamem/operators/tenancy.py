"""Tenants and their keys: only a key's digest is kept, and a revoked key admits nobody."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def digest(token: Column) -> Column:
    return F.sha2(token, 256)


def with_tenants(tenants: DataFrame, asked: DataFrame) -> DataFrame:
    """``(tenant_id, external_id)`` with a row for every external id asked for; known ones keep their id."""
    new = asked.where("external_id is not null").select("external_id").distinct().join(tenants, "external_id", "left_anti")
    return tenants.select("tenant_id", "external_id").unionByName(new.select(F.sha2("external_id", 256).substr(1, 32).alias("tenant_id"), "external_id"))


def with_keys(keys: DataFrame, issued: DataFrame, now: Column) -> DataFrame:
    """``keys`` (digest, tenant_id, label, created_at, revoked_at) and one for each issued ``(token, tenant_id, label)``."""
    rows = issued.select(digest(F.col("token")).alias("digest"), "tenant_id", "label", now.alias("created_at"), F.lit(None).cast("timestamp").alias("revoked_at"))
    return keys.unionByName(rows.join(keys, "digest", "left_anti"))


def revoked(keys: DataFrame, digests: DataFrame, now: Column) -> DataFrame:
    """``keys`` after the ``digests`` were revoked; what is revoked already keeps its time."""
    d = digests.select(F.col("digest").alias("_d")).distinct()
    return keys.join(d, keys["digest"] == d["_d"], "left").withColumn("revoked_at", F.when(F.col("_d").isNotNull() & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at"))).drop("_d")


def authenticated(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """``requests`` whose ``token`` is an active key, with its ``tenant_id``; the others have no row."""
    active = keys.where("revoked_at is null").select(F.col("digest").alias("_d"), "tenant_id")
    return requests.withColumn("_d", digest(F.col("token"))).join(active, "_d").drop("_d", "token")
