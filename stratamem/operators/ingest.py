"""Taking in raw sources: idempotent inserts, the pending queue, documents and their chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratamem.functions.keys import normalize_key
from stratamem.functions.text import CHUNK_OVERLAP, CHUNK_SIZE, chunked
from stratamem.operators.resolve import CONFIDENCE, STATE, resolve_against

KEY = ["tenant_id", "actor_id", "subject", "attribute"]


def new_sources(incoming: DataFrame, existing: DataFrame | None, order: str, tie: str) -> DataFrame:
    """The incoming rows that are inserted: one per tenant and custom id, and none that is known.

    The first by ``order`` and ``tie`` wins. A null custom id never conflicts.
    """
    named = incoming.where("custom_id is not null")
    first = Window.partitionBy("tenant_id", "custom_id").orderBy(order, tie)
    once = named.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    if existing is not None:
        known = existing.where("custom_id is not null").select("tenant_id", "custom_id").distinct()
        once = once.join(known, ["tenant_id", "custom_id"], "left_anti").select(*incoming.columns)
    return once.unionByName(incoming.where("custom_id is null"))


def pending(sources: DataFrame, now: Column, lease_seconds: float, limit: int) -> DataFrame:
    """The oldest sources that wait for extraction and that nobody holds a fresh lease on."""
    lapsed = F.col("claimed_at").isNull() | (F.unix_micros("claimed_at") + F.lit(int(lease_seconds * 1e6)) < F.unix_micros(now))
    return sources.where(F.col("needs_extraction") & lapsed).orderBy("ingested_at", "id").limit(limit)


def completed(sources: DataFrame, done: DataFrame) -> DataFrame:
    """``sources`` after the claims in ``done`` (``id, claimed_at``); a claim that was taken over since does not count."""
    d = done.select(F.col("id").alias("_i"), F.col("claimed_at").alias("_c")).distinct()
    joined = sources.join(d, (sources["id"] == d["_i"]) & (sources["claimed_at"] == d["_c"]), "left")
    return joined.withColumn("needs_extraction", F.col("needs_extraction") & F.col("_i").isNull()).drop("_i", "_c")


def routed(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests to run now and those to queue (``dreaming`` says dynamic, in any case)."""
    later = F.coalesce(F.lower("dreaming") == "dynamic", F.lit(False))
    return requests.where(~later), requests.where(later)


def document_chunks(documents: DataFrame, content: str = "content", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Every document's columns but the text, with ``ord, chunk``; blank documents give none."""
    return chunked(documents, content, size, overlap)


_TRIPLE = ["subject", "attribute", "value"]


def extracted(sources: DataFrame, extractor: Callable[[str], Sequence[dict]]) -> DataFrame:
    """``(id, ord, content, confidence, error, subject, attribute, value, single_valued, from_us, to_us)``: facts that a callable finds in each source's text.

    Facts whose content is blank are dropped. A source whose extraction fails gives one row
    with the ``error`` and stays for later; it does not hold up the others.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for i, t in zip(pdf["id"], pdf["content"]):
                try:
                    found = [c for c in extractor(t) if (c.get("content") or "").strip()] if t is not None else []
                    out += [(i, k, c["content"], float(c.get("confidence", CONFIDENCE)), None, *(c.get(x) for x in _TRIPLE), bool(c.get("single_valued", False)), c.get("from_us"), c.get("to_us")) for k, c in enumerate(found)]
                except Exception as e:  # a poisoned source is reported, not raised
                    out.append((i, None, None, None, str(e)[:200], None, None, None, None, None, None))
            frame = pd.DataFrame(out, columns=["id", "ord", "content", "confidence", "error", *_TRIPLE, "single_valued", "from_us", "to_us"])
            for c, nullable in (("ord", "Int32"), ("from_us", "Int64"), ("to_us", "Int64"), ("single_valued", "boolean")):
                frame[c] = frame[c].astype(nullable)
            yield frame

    kind = sources.schema["id"].dataType.simpleString()
    return sources.select("id", "content").mapInPandas(run, f"id {kind}, ord int, content string, confidence double, error string, subject string, attribute string, value string, single_valued boolean, from_us bigint, to_us bigint")


MEMORY = f"tenant_id string, actor_id string, subject string, attribute string, {STATE}, content string, source_id bigint, recorded_us bigint"


def no_memory(spark) -> DataFrame:
    """A memory table without rows, with the columns that :func:`add` keeps."""
    return spark.createDataFrame([], MEMORY)


def add(memory: DataFrame, sources: DataFrame | None, requests: DataFrame, extractor: Callable[[str], Sequence[dict]], now_us: Column, synonyms: DataFrame | None = None) -> dict[str, DataFrame]:
    """Take in requests: ``memory`` and ``sources`` afterwards, what each source did, and the sources that failed.

    ``requests`` has ``id, tenant_id, actor_id, custom_id, content, as_of_us, received_at``.
    A custom id that is known is skipped. Facts are extracted, their keys brought to canonical
    form (a key that is empty then makes the fact unstructured), and those with a key resolved
    against the actor's rows in order of receipt and place; the others are added. A fact's own
    time stands before the request's ``as_of_us``, and that before ``now_us``. ``memory`` has
    the columns of ``MEMORY``; only rows of touched keys are read into a fold. ``actions``
    counts per source what was inserted; embeddings, profiles and relations follow from the
    new memory by their own operators.
    """
    fresh = new_sources(requests, sources, "received_at", "id")
    found = extracted(fresh, extractor)
    about = fresh.select(F.col("id").alias("source_id"), "tenant_id", "actor_id", "as_of_us", F.unix_micros("received_at").alias("recorded_us"))
    facts = found.where("error is null and content is not null").withColumnRenamed("id", "source_id").join(about, "source_id")
    subject, attribute = (F.when(normalize_key(F.col(c)) != "", normalize_key(F.col(c))) for c in ("subject", "attribute"))
    facts = facts.select(
        "tenant_id", "actor_id", subject.alias("subject"), attribute.alias("attribute"), "value", "single_valued", "content", "source_id", "recorded_us", "to_us",
        F.xxhash64("source_id", "ord").alias("fact_id"), F.coalesce("from_us", "as_of_us", now_us).alias("at_us"), F.struct("recorded_us", "source_id", "ord").alias("arrival_order"),
    )
    if synonyms is not None:
        names = synonyms.groupBy("surface").agg(F.min("canonical").alias("canonical"))
        facts = facts.join(names, facts["attribute"] == names["surface"], "left").withColumn("attribute", F.coalesce("canonical", "attribute")).drop("surface", "canonical")
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("arrival_order"))
    keyed = facts.where("subject is not null and attribute is not null").withColumn("arrival", place)
    rows = resolve_against(memory, keyed, KEY, "arrival", "at_us", "value", "fact_id", "single_valued", "to_us")
    texts = memory.select("fact_id", "content", "source_id", "recorded_us").unionByName(facts.select("fact_id", "content", "source_id", "recorded_us"))
    resolved = rows.join(texts, "fact_id").select(*memory.columns)
    same = [memory[c].eqNullSafe(F.col(f"_{c}")) for c in KEY]
    touched = keyed.select(*[F.col(c).alias(f"_{c}") for c in KEY]).distinct()
    untouched = memory.join(touched, same[0] & same[1] & same[2] & same[3], "left_anti").select(*memory.columns)
    loose = facts.where("subject is null or attribute is null").select(
        *KEY, "fact_id", "value", F.col("at_us").alias("valid_from"), F.when(F.col("to_us") > F.col("at_us"), F.col("to_us")).alias("valid_to"), F.lit(CONFIDENCE).alias("confidence"),
        F.lit(True).alias("is_latest"), F.lit("active").alias("status"), F.lit(None).cast("bigint").alias("supersedes_id"), F.lit(False).alias("overlaps"), "content", "source_id", "recorded_us",
    )
    after = untouched.unionByName(resolved).unionByName(loose)
    kept = after.select("fact_id", "status", "supersedes_id")
    actions = facts.select("source_id", "fact_id").join(kept, "fact_id", "left").groupBy("source_id").agg(
        F.count("status").alias("inserted"), F.sum(F.col("status").isNull().cast("bigint")).alias("deduped"), F.count("supersedes_id").alias("superseding")
    )
    return {"memory": after, "sources": fresh if sources is None else sources.unionByName(fresh, allowMissingColumns=True), "actions": actions, "failed": found.where("error is not null").select("id", "error")}


def enqueue(queue: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The queue after the requests were put into it, and ``(id, queued)``: false where the custom id is known."""
    fresh = new_sources(requests, queue, "received_at", "id")
    waiting = fresh.withColumn("needs_extraction", F.lit(True)).withColumn("claimed_at", F.lit(None).cast("timestamp")).withColumn("ingested_at", now)
    taken = requests.select("id").join(fresh.select("id", F.lit(True).alias("queued")), "id", "left").select("id", F.coalesce("queued", F.lit(False)).alias("queued"))
    return queue.unionByName(waiting.select(*queue.columns)), taken


def process_pending(queue: DataFrame, memory: DataFrame, extractor: Callable[[str], Sequence[dict]], now: Column, lease_seconds: float = 300, most: int = 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(queue, memory, failed)`` after the oldest waiting sources were leased and extracted.

    A source that fails keeps its lease and stays queued, so it waits until that lapses and
    does not hold up the others.
    """
    batch = pending(queue, now, max(1.0, lease_seconds), most)
    done = add(memory, None, batch.withColumn("custom_id", F.lit(None).cast("string")), extractor, F.unix_micros(now))
    ids = batch.select(F.col("id").alias("_i")).join(done["failed"].select(F.col("id").alias("_f")), F.col("_i") == F.col("_f"), "left")
    marked = queue.join(ids.withColumn("_hit", F.lit(True)), queue["id"] == F.col("_i"), "left")
    open_ = F.col("needs_extraction") & (F.col("_hit").isNull() | F.col("_f").isNotNull())
    after = marked.withColumn("claimed_at", F.when(F.col("_hit"), now).otherwise(F.col("claimed_at"))).withColumn("needs_extraction", open_)
    return after.select(*queue.columns), done["memory"], done["failed"]


def work_off(queue: DataFrame, memory: DataFrame, extractor: Callable[[str], Sequence[dict]], now: Column, cut: Callable[[DataFrame], DataFrame], lease_seconds: float = 300, most: int = 16, rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """:func:`process_pending` until nothing waits that is not leased; ``cut`` cuts the lineage between rounds."""
    for _ in range(rounds):
        if not pending(queue, now, lease_seconds, 1).take(1):
            break
        queue, memory, _ = process_pending(queue, memory, extractor, now, lease_seconds, most)
        queue, memory = cut(queue), cut(memory)
    return queue, memory
