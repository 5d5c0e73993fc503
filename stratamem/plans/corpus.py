"""The tables as the logical tables of the engine, for Spark and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stratamem.functions.keys import normalize_key
from stratamem.session import read_table

#: The tenant that queries of one tenant ask for.
TENANT = "d429b4ad-9599-5f7e-519e-48d83d82367b"
ACTOR = "user:0"
#: "Now", a parameter of every query.
NOW = "2025-01-01 00:00:00"
QUERY_TEXT = "keeps beside"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def memory(spark: SparkSession, d: str) -> DataFrame:
    """``candidates`` as memory rows; of a single-valued key the row that takes effect last is the current one."""
    c = read_table(spark, d, "candidates")
    kind = F.col("temporal_kind")
    start = F.when(kind == "as_of", F.col("as_of_ts")).when(kind == "range", F.col("range_from"))
    rows = c.select(
        F.col("cand_id").alias("id"),
        "tenant_id",
        "actor_id",
        "content",
        "subject",
        "attribute",
        "value",
        "single_valued",
        "mem_type",
        "confidence",
        "is_static",
        "forget_after",
        "recorded_at",
        F.col("request_id").alias("source_id"),
        F.coalesce(start, F.col("recorded_at")).alias("valid_from"),
        F.when((kind == "range") & (F.col("range_to") > F.coalesce(start, F.col("recorded_at"))), F.col("range_to")).alias("valid_to"),
        F.array("mem_type", "temporal_kind").alias("container_tags"),
        F.concat(F.lit('{"kind":"'), kind, F.lit('","tags":["'), F.col("mem_type"), F.lit('","'), kind, F.lit('"],"conf":'), F.round(F.col("confidence").cast("double") * 100).cast("int"), F.lit("}")).alias("metadata"),
        normalize_key(F.col("subject")).alias("s"),
        normalize_key(F.col("attribute")).alias("a"),
    )
    keyed = F.col("single_valued") & (F.coalesce("s", F.lit("")) != "") & (F.coalesce("a", F.lit("")) != "")
    key = F.when(keyed, F.concat_ws("\x01", "s", "a")).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))
    order = Window.partitionBy("tenant_id", "actor_id", "_key").orderBy(F.desc("valid_from"), F.desc("recorded_at"), F.desc("id"))
    latest = rows.withColumn("_key", key).withColumn("is_latest", F.row_number().over(order) == 1)
    return latest.withColumn("status", F.when(F.col("is_latest"), F.lit("active")).otherwise(F.lit("superseded"))).drop("_key", "s", "a")


def lifecycle_rows(mem: DataFrame) -> DataFrame:
    """Memory rows with the columns of versions and recording time."""
    none_id, none_ts = F.lit(None).cast("bigint"), F.lit(None).cast("timestamp")
    return mem.select("*", F.lit(1).alias("version"), none_id.alias("root_id"), none_id.alias("supersedes_id"), none_ts.alias("recorded_to"))


def usable_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    ok = v.isNotNull() & (F.size(v) == 64) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return read_table(spark, d, "embedding_data").where(ok).select("vec_id", "cand_id", "embedding")


def with_vectors(spark: SparkSession, d: str, mem: DataFrame) -> DataFrame:
    first = usable_vectors(spark, d).groupBy("cand_id").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return mem.join(first, mem["id"] == first["cand_id"], "left").drop("cand_id")


def query_vector(spark: SparkSession, d: str) -> Column:
    """The first usable vector, one row, as a literal."""
    row = usable_vectors(spark, d).orderBy("vec_id").limit(1).collect()
    return F.array(*[F.lit(float(x)) for x in row[0]["embedding"]]) if row else F.lit(None).cast("array<double>")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "doc_chunks").select(F.col("chunk_id").alias("id"), F.col("ingest_id").alias("document_id"), "ord", "content")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "ingest_requests").select(F.col("ingest_id").alias("document_id"), "tenant_id", "container_tag", "title", "metadata", "content", "received_at", "custom_id", "task_type")


def _norm(c: str) -> str:
    return rf"regexp_replace(trim(regexp_replace(lower({c}), '\s+', ' ', 'g')), '^[\s.:,;?!]+|[\s.:,;?!]+$', '', 'g')"


MEM = rf"""base as (
  select cand_id as id, tenant_id, actor_id, content, subject, attribute, value, single_valued, mem_type, confidence, is_static, forget_after, recorded_at,
         request_id as source_id, coalesce(case temporal_kind when 'as_of' then as_of_ts when 'range' then range_from end, recorded_at) as valid_from,
         case when temporal_kind = 'range' and range_to > coalesce(range_from, recorded_at) then range_to end as valid_to,
         [mem_type, temporal_kind] as container_tags,
         '{{"kind":"' || temporal_kind || '","tags":["' || mem_type || '","' || temporal_kind || '"],"conf":' || round(confidence::double * 100)::int || '}}' as metadata,
         case when single_valued and coalesce({_norm('subject')}, '') <> '' and coalesce({_norm('attribute')}, '') <> ''
              then {_norm('subject')} || chr(1) || {_norm('attribute')} else '#' || cand_id end as k
  from candidates
), mem as (
  select * exclude (k), row_number() over (partition by tenant_id, actor_id, k order by valid_from desc, recorded_at desc, id desc) = 1 as is_latest,
         case when row_number() over (partition by tenant_id, actor_id, k order by valid_from desc, recorded_at desc, id desc) = 1 then 'active' else 'superseded' end as status
  from base
)"""
VEC = """usable as (
  select vec_id, cand_id, embedding::double[] as v from embedding_data
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), q as (select v from usable order by vec_id limit 1)"""
SQL_NOW = f"timestamptz '{NOW}+00'"
LIVE = f"is_latest and status = 'active' and (forget_after is null or forget_after > {SQL_NOW})"
