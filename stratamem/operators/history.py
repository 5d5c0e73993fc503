"""History of changing entity attributes.

Reports are an event-sourced change log per entity attribute. Versions of one attribute are
maximal runs of equal values in order of effect time; histories of several attributes of one
entity are combined by splitting at the union of their boundary dates and coalescing
neighbouring stretches that agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratamem.functions.keys import canonical_value, normalize_key, not_blank

KEY = ["tenant_id", "actor_id", "subject_key", "attribute_key"]
#: Width of a time slice within which a hot key's log is ordered on its own.
SLICE_US = 30 * 86_400_000_000


def _canonical(df: DataFrame, synonyms: DataFrame | None) -> DataFrame:
    if synonyms is None:
        return df
    names = synonyms.where("surface is not null and canonical is not null").groupBy("surface").agg(F.min("canonical").alias("canonical"))
    return df.join(names, df["attribute_key"] == names["surface"], "left").withColumn("attribute_key", F.coalesce("canonical", "attribute_key")).drop("surface", "canonical")


def reports(facts: DataFrame, effect: Column, synonyms: DataFrame | None = None) -> DataFrame:
    """Change-log rows ``KEY + (at_us, recorded_us, val)`` of single-valued facts.

    ``facts`` has ``tenant_id, actor_id, subject, attribute, value, single_valued,
    recorded_at``; ``effect`` is the time at which a report takes effect and falls back to
    ``recorded_at``. Rows with a blank subject, attribute or value, with a key that is empty
    once normalised, that are not single-valued, or that have neither time are left out.
    Null tenants and actors are keys like any other.
    """
    rows = facts.where(F.col("single_valued") & not_blank(F.col("subject")) & not_blank(F.col("attribute")) & not_blank(F.col("value"))).select(
        "tenant_id",
        "actor_id",
        normalize_key(F.col("subject")).alias("subject_key"),
        normalize_key(F.col("attribute")).alias("attribute_key"),
        F.unix_micros(F.coalesce(effect, F.col("recorded_at")).cast("timestamp")).alias("at_us"),
        F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("recorded_us"),
        canonical_value(F.col("value")).alias("val"),
    )
    return _canonical(rows, synonyms).where("subject_key <> '' and attribute_key <> '' and at_us is not null")


def versions(log: DataFrame, key: list[str] = KEY, slice_us: int = SLICE_US) -> DataFrame:
    """``key + (from_us, to_us, val)``: the versions of every key.

    Of several reports with one effect time the one recorded last counts (a null recording
    time is earliest; the greater value decides a tie). ``to_us`` is the start of the next
    version, -1 for the last one. Repeated reports change nothing; an empty log gives an
    empty result.

    Order is resolved in two levels, within (key, time slice) and over one summary row per
    slice, so a key that holds a large part of all reports spreads over its slices.
    """
    rank = F.struct(F.coalesce("recorded_us", F.lit(-(2**63))).alias("r"), F.col("val").alias("v"))
    one = log.groupBy(*key, "at_us").agg(F.max(rank)["v"].alias("val")).withColumn("slice", F.floor(F.col("at_us") / F.lit(slice_us)))
    inside = Window.partitionBy(*key, "slice").orderBy("at_us")
    marked = one.withColumn("prev", F.lag("val").over(inside))
    part = marked.groupBy(*key, "slice").agg(
        F.min("at_us").alias("first_at"),
        F.min_by("val", "at_us").alias("first_val"),
        F.max_by("val", "at_us").alias("last_val"),
        F.min(F.when(F.col("prev") != F.col("val"), F.col("at_us"))).alias("inner_start"),
    )
    slices = Window.partitionBy(*key).orderBy("slice")
    before = F.lag("last_val").over(slices)
    summary = (
        part.withColumn("opens", before.isNull() | (before != F.col("first_val")))
        .withColumn("start", F.when(F.col("opens"), F.col("first_at")).otherwise(F.col("inner_start")))
        .withColumn("later", F.min("start").over(slices.rowsBetween(1, Window.unboundedFollowing)))
        .select(*[F.col(k).alias(f"s_{k}") for k in key], F.col("slice").alias("s_slice"), "opens", "later")
    )
    starts = marked.where("prev is null or prev <> val")
    cond = starts["slice"] == summary["s_slice"]
    for k in key:
        cond = cond & starts[k].eqNullSafe(summary[f"s_{k}"])
    kept = starts.join(summary, cond).where("prev is not null or opens")
    return kept.select(*key, F.col("at_us").alias("from_us"), F.coalesce(F.lead("at_us").over(inside), F.col("later"), F.lit(-1)).alias("to_us"), "val")


def combined_history(vers: DataFrame, attributes: list[str], entity: list[str] = KEY[:3], slice_us: int = SLICE_US) -> DataFrame:
    """``entity + (from_us, to_us, state)``: the joint state of the listed attributes.

    Each attribute keeps its own intervals; periods are split at the union of their boundary
    dates, and neighbouring periods with equal state are coalesced into one. ``state`` is a
    JSON object of the attributes known by then, in the order listed. Other attributes and
    entities without a listed one are left out. Resolved by slices, as :func:`versions`.
    """
    cols = [f"v{i}" for i in range(len(attributes))]
    steps = (
        vers.where(F.col("attribute_key").isin(*attributes))
        .groupBy(*entity, "from_us")
        .agg(*[F.max(F.when(F.col("attribute_key") == a, F.col("val"))).alias(c) for a, c in zip(attributes, cols)])
        .withColumn("slice", F.floor(F.col("from_us") / F.lit(slice_us)))
    )
    last = steps.groupBy(*entity, "slice").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("from_us"))).alias(f"l_{c}") for c in cols])
    earlier = Window.partitionBy(*entity).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*[F.col(k).alias(f"s_{k}") for k in entity], F.col("slice").alias("s_slice"), *[F.last(f"l_{c}", ignorenulls=True).over(earlier).alias(f"c_{c}") for c in cols])
    cond = steps["slice"] == carried["s_slice"]
    for k in entity:
        cond = cond & steps[k].eqNullSafe(carried[f"s_{k}"])
    inside = Window.partitionBy(*entity, "slice").orderBy("from_us")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    full = steps.join(carried, cond).select(*entity, "slice", "from_us", *[F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"c_{c}")).alias(c) for c in cols])
    state = full.select(*entity, F.col("from_us").alias("at_us"), F.lit(0).cast("bigint").alias("recorded_us"), F.to_json(F.struct(*[F.col(c).alias(a) for a, c in zip(attributes, cols)])).alias("val"))
    return versions(state, entity, slice_us).withColumnRenamed("val", "state")
