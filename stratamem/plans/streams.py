"""Queries that run a stream to its end, and the stand-ins of the model services."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratamem.functions import providers
from stratamem.functions.keys import normalize_key
from stratamem.plans.writes import _EVENT_SEGMENTS, _FOLDED, _event_facts, _in_order
from stratamem.session import read_table, shared_dir
from stratamem.streaming.resolver import latest_rows, resolve_stream, run_available

KEY = ["tenant_id", "actor_id", "subject_key", "attribute_key"]


def _arriving(rows: DataFrame, at: Column, deliveries: int = 4) -> DataFrame:
    """``rows`` as a stream of so many deliveries, one after the other in order of ``at`` (microseconds)."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/arriving-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min(at), F.max(at)).first()
    width = ((high or 0) - (low or 0)) // deliveries + 1
    for k in range(deliveries):
        rows.where(F.floor((at - F.lit(low or 0)) / width) == k).write.parquet(f"{path}/delivery={k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
    return stream.parquet(f"{path}/*")


def stream_resolve_events(spark: SparkSession, d: str) -> DataFrame:
    """``events`` in several deliveries; facts in order of effect give the segments of the closed form."""
    source = _arriving(_event_facts(spark, d).where("val is not null").withColumn("single", F.lit(True)), F.col("at_us"))
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    changes = resolve_stream(source, ["user_id", "event_type"], "at_us", "at_us", "val", "event_id", "single")
    run_available(changes, f"{base}/changes", f"{base}/checkpoint")
    return _in_order(latest_rows(spark.read.schema(changes.schema).parquet(f"{base}/changes/*"), ["user_id", "event_type"]))


def stream_resolve(spark: SparkSession, d: str) -> DataFrame:
    """``candidates`` as a stream of files, resolved key by key in order of recording."""
    source = _arriving(read_table(spark, d, "candidates"), F.unix_micros("recorded_at"))
    kind = F.col("temporal_kind")
    start = F.coalesce(F.when(kind == "as_of", F.col("as_of_ts")).when(kind == "range", F.col("range_from")), F.col("recorded_at"))
    rows = source.select("tenant_id", "actor_id", normalize_key(F.col("subject")).alias("subject_key"), normalize_key(F.col("attribute")).alias("attribute_key"), "cand_id", "value", "single_valued", "recorded_at", F.unix_micros(start).alias("at_us"), F.unix_micros(F.when(kind == "range", F.col("range_to"))).alias("end_us"))
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    changes = resolve_stream(rows.where("subject_key <> '' and attribute_key <> ''"), KEY, "recorded_at", "at_us", "value", "cand_id", "single_valued", "end_us")
    run_available(changes, f"{base}/changes", f"{base}/checkpoint")
    return latest_rows(spark.read.schema(changes.schema).parquet(f"{base}/changes/*"), KEY).drop("version")


def mock_embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "doc_chunks")
    return rows.select("chunk_id", providers.embed(F.col("content"), providers.HashEmbedder(16)).alias("embedding"))


QUERIES = {"stream_resolve": stream_resolve, "stream_resolve_events": stream_resolve_events, "mock_embeddings": mock_embeddings}
ORACLES: dict[str, str] = {"stream_resolve_events": _EVENT_SEGMENTS + _FOLDED}
