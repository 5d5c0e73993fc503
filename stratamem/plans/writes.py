"""Queries of the write side: resolution, versions, forgetting, profiles, graph, ingest, evaluation."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stratamem.functions import scope, text
from stratamem.functions.keys import normalize_key
from stratamem.operators import evaluation, graph, ingest, lifecycle, resolve, tenancy
from stratamem.plans.corpus import ACTOR, LIVE, MEM, SQL_NOW, TENANT, documents, lifecycle_rows, memory, now
from stratamem.plans.retrieval import chunk_sql
from stratamem.session import materialize, read_table
from stratamem.sources.exports import actor_bundle, actor_export

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _event_facts(spark: SparkSession, d: str) -> DataFrame:
    """Events as facts: the actor is the user, the attribute the event type, the value one of three."""
    value = F.concat(F.lit("v"), F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(3)).cast("string"))
    return read_table(spark, d, "events").select("event_id", "user_id", "event_type", value.alias("val"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


_FACTS = "facts as (select event_id, user_id, event_type, 'v' || (json_extract_string(props::json, '$.k')::int % 3) as val, epoch_us(ts) as at_us from events where props is not null)"


def _segments_sql(facts: str, key: str) -> str:
    return f"""with {facts}, lagged as (
  select *, lag(val) over (partition by {key} order by at_us, tie) as prev from f where val is not null and at_us is not null
), runs as (select *, sum(case when prev is null or prev <> val then 1 else 0 end) over (partition by {key} order by at_us, tie) as run from lagged
), seg as (select {key}, run, min(at_us) as valid_from, any_value(val) as value, count(*) as n_reports, arg_min(tie, (at_us, tie)) as fact_id from runs group by {key}, run
), done as (select {key}, valid_from, lead(valid_from) over (partition by {key} order by run) as valid_to, value, n_reports,
       round(least(1.0::double, 0.5::double + 0.1::double * (n_reports - 1)), 6) as confidence, lead(valid_from) over (partition by {key} order by run) is null as is_latest,
       fact_id, lag(fact_id) over (partition by {key} order by run) as supersedes_id from seg)"""


_EVENT_SEGMENTS = _segments_sql(_FACTS + ", f as (select *, event_id as tie from facts)", "user_id, event_type")


@query(_EVENT_SEGMENTS + " select * from done")
def resolve_supersede(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_in_order(_event_facts(spark, d), ["user_id", "event_type"], "at_us", "val", "event_id")


@query(_EVENT_SEGMENTS + " select confidence, count(*) as n, sum(n_reports)::bigint as reports from done group by confidence")
def resolve_dedup_confidence(spark: SparkSession, d: str) -> DataFrame:
    return resolve_supersede(spark, d).groupBy("confidence").agg(F.count("*").alias("n"), F.sum("n_reports").alias("reports"))


@query(f"with {_FACTS} select user_id, event_type, val as value, min(at_us) as valid_from, count(*) as n_reports, arg_min(event_id, (at_us, event_id)) as fact_id, round(least(1.0::double, 0.5::double + 0.1::double * (count(*) - 1)), 6) as confidence from facts where val is not null group by all")
def resolve_multi_valued(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_multi_valued(_event_facts(spark, d), ["user_id", "event_type"], "at_us", "val", "event_id")


@query()
def resolve_late_arrival(spark: SparkSession, d: str) -> DataFrame:
    """Facts of ``candidates`` in the order they were recorded, which is not the order of their effect."""
    rows = memory(spark, d).select("tenant_id", "actor_id", normalize_key(F.col("subject")).alias("subject_key"), normalize_key(F.col("attribute")).alias("attribute_key"), "id", "value", "single_valued", "recorded_at", F.unix_micros("valid_from").alias("at_us"), F.unix_micros("valid_to").alias("end_us"))
    keyed = rows.where("subject_key <> '' and attribute_key <> ''")
    return resolve.resolve_by_fold(keyed, ["tenant_id", "actor_id", "subject_key", "attribute_key"], "recorded_at", "at_us", "value", "id", "single_valued", "end_us")


_FOLDED = " select user_id, event_type, valid_from, valid_to, value, confidence, is_latest, fact_id, supersedes_id from done"


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", "event_type", "valid_from", "valid_to", "value", "confidence", "is_latest", "fact_id", "supersedes_id")


@query(_EVENT_SEGMENTS + _FOLDED)
def resolve_fold(spark: SparkSession, d: str) -> DataFrame:
    """The fold over facts that arrive in order of effect gives the segments of the closed form."""
    facts = _event_facts(spark, d).where("val is not null").withColumn("single", F.lit(True))
    return _in_order(resolve.resolve_by_fold(facts, ["user_id", "event_type"], "at_us", "at_us", "val", "event_id", "single"))


def _told(content: str) -> list[dict]:
    """Stands in for an extractor: the request's text is the fact as JSON."""
    return [json.loads(content)]


_ADDED = _EVENT_SEGMENTS + """ select 'u' || user_id as actor_id, event_type as attribute, valid_from, valid_to, value, confidence, is_latest, n_reports > 0 as kept
from done"""


@query(_ADDED)
def ingest_add(spark: SparkSession, d: str) -> DataFrame:
    """Requests in two deliveries, the second against the memory that the first left."""
    fact = F.to_json(F.struct(F.concat(F.lit("is "), "val").alias("content"), F.lit("Self.").alias("subject"), F.initcap("event_type").alias("attribute"), F.col("val").alias("value"), F.lit(True).alias("single_valued"), F.col("at_us").alias("from_us")))
    requests = _event_facts(spark, d).where("val is not null").select(
        F.col("event_id").alias("id"), F.lit("t").alias("tenant_id"), F.concat(F.lit("u"), "user_id").alias("actor_id"), F.lit(None).cast("string").alias("custom_id"), fact.alias("content"), F.lit(None).cast("bigint").alias("as_of_us"), F.timestamp_micros("at_us").alias("received_at"),
    )
    half = F.lit("2024-07-01").cast("timestamp")
    first = ingest.add(ingest.no_memory(spark), None, requests.where(F.col("received_at") < half), _told, F.lit(0))
    kept = {k: materialize(first[k], "ingest") for k in ("memory", "sources")}
    after = ingest.add(kept["memory"], kept["sources"], requests.where(F.col("received_at") >= half), _told, F.lit(0))["memory"]
    return after.select("actor_id", "attribute", "valid_from", "valid_to", "value", "confidence", "is_latest", (F.col("status") != "conflict").alias("kept"))


@query(f"with {MEM} select m.id, r.request_id as source_id, epoch_us(r.received_at) as received_us from mem m join add_requests r on r.request_id = m.source_id where m.tenant_id = '{TENANT}'")
def memory_provenance(spark: SparkSession, d: str) -> DataFrame:
    mine = scope.tenant_scan(memory(spark, d), TENANT).select("id", "source_id")
    sources = read_table(spark, d, "add_requests").select(F.col("request_id").alias("source_id"), F.unix_micros("received_at").alias("received_us"))
    return mine.join(sources, "source_id").select("id", "source_id", "received_us")



@query(
    f"with {MEM}, e as (select tenant_id, id as from_id, lead(id) over (partition by tenant_id, actor_id order by id) as to_id from mem), gone as (select id from mem where status = 'active' and mem_type = 'episode') "
    "select tenant_id, count(*) as n from e where to_id is not null and from_id not in (select id from gone) and to_id not in (select id from gone) group by tenant_id"
)
def forget_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between each row and the next of its actor, after every current episode was forgotten."""
    rows = memory(spark, d)
    following = F.lead("id").over(Window.partitionBy("tenant_id", "actor_id").orderBy("id"))
    edges = rows.select("tenant_id", F.col("id").alias("from_id"), following.alias("to_id"), F.lit("extends").alias("relation")).where("to_id is not null")
    after = lifecycle.forget_by_id(lifecycle_rows(rows), rows.where("mem_type = 'episode'").select("actor_id", "id"), now())
    return lifecycle.edges_left(edges, after).groupBy("tenant_id").agg(F.count("*").alias("n"))


@query(
    f"with {MEM}, docs as (select ingest_id, received_at, row_number() over () as k from ingest_requests where tenant_id = '{TENANT}') select "
    f"(select count(*) from mem where tenant_id = '{TENANT}' and actor_id = '{ACTOR}') as memories, (select count(*) from add_requests where tenant_id = '{TENANT}' and container_tag = '{ACTOR}') as sources, "
    f"(select count(*) from ingest_requests where tenant_id = '{TENANT}' and container_tag = '{ACTOR}') as documents, (select count(*) from doc_chunks where ingest_id in (select ingest_id from ingest_requests where tenant_id = '{TENANT}' and container_tag = '{ACTOR}')) as chunks, "
    f"(select count(*) > 0 from mem where tenant_id = '{TENANT}' and actor_id = '{ACTOR}' and {LIVE}) as has_profile"
)
def export_bundle(spark: SparkSession, d: str) -> DataFrame:
    rows = memory(spark, d)
    asked = read_table(spark, d, "add_requests").withColumn("actor_id", F.col("container_tag"))
    docs = documents(spark, d).withColumn("actor_id", F.col("container_tag"))
    pieces = read_table(spark, d, "doc_chunks").withColumnRenamed("ingest_id", "document_id").join(docs.select("document_id", "tenant_id", "actor_id"), "document_id")
    tables = {"memories": (rows, "recorded_at", "id"), "sources": (asked, "received_at", "request_id"), "documents": (docs, "received_at", "document_id"), "chunks": (pieces, "document_id", "chunk_id")}
    out = actor_bundle(tables, lifecycle.profiles(rows, now()), TENANT, ACTOR, now())
    size = lambda c: F.size(F.from_json(c, "array<struct<tenant_id: string>>")).cast("bigint")
    return out.select(*[size(c).alias(c) for c in ("memories", "sources", "documents", "chunks")], F.col("profile").isNotNull().alias("has_profile"))


@query(
    "with k as (select tenant_id, sha256('sm_' || tenant_id) as digest, row_number() over (order by tenant_id) % 3 = 0 as revoked from (select distinct tenant_id from candidates)) "
    "select c.cand_id, k.tenant_id from candidates c join k on sha256('sm_' || c.tenant_id) = k.digest where not revoked"
)
def key_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every row asks with its tenant's key; every third tenant's keys were revoked."""
    rows = read_table(spark, d, "candidates")
    tenants = rows.select("tenant_id").distinct()
    none = spark.createDataFrame([], "digest string, tenant_id string, label string, created_at timestamp, revoked_at timestamp")
    issued = tenants.select(F.concat(F.lit("sm_"), "tenant_id").alias("token"), "tenant_id", F.lit(None).cast("string").alias("label"))
    keys = tenancy.with_keys(none, issued, now())
    third = keys.join(tenants.withColumn("k", F.row_number().over(Window.orderBy("tenant_id"))).where("k % 3 = 0").select("tenant_id"), "tenant_id")  # one row a tenant
    active = tenancy.revoked(keys, third.select("digest"), now())
    return tenancy.authenticated(rows.select("cand_id", F.concat(F.lit("sm_"), "tenant_id").alias("token")), active).select("cand_id", "tenant_id")


@query("select count(*) as n, count(distinct external_id) as ids from (select tenant_id as external_id from candidates union select container_tag from add_requests where container_tag is not null)")
def tenant_upsert(spark: SparkSession, d: str) -> DataFrame:
    known = read_table(spark, d, "candidates").select("tenant_id", F.col("tenant_id").alias("external_id")).distinct()
    asked = read_table(spark, d, "add_requests").select(F.col("container_tag").alias("external_id")).union(known.select("external_id"))
    return tenancy.with_tenants(known, asked).agg(F.count("*").alias("n"), F.countDistinct("external_id").alias("ids"))


@query("select doc_id, epoch_us(uploaded_at) as at_us from documents")
def event_dates(spark: SparkSession, d: str) -> DataFrame:
    """Upload times written as RFC 3339 text in an offset of their own and read again."""
    text_ = F.date_format(F.col("uploaded_at") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")
    return read_table(spark, d, "documents").select("doc_id", F.unix_micros(scope.event_date(F.array(text_))).alias("at_us"))


@query("select cand_id, epoch_us(case when range_to > coalesce(range_from, recorded_at) then range_to end) as end_us from candidates where temporal_kind = 'range'")
def interval_ends(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "candidates").where("temporal_kind = 'range'")
    return rows.select("cand_id", F.unix_micros(scope.interval_end(F.coalesce("range_from", "recorded_at"), F.col("range_to"))).alias("end_us"))


_LINES = "f as (select l_partkey, l_returnflag as val, epoch_us(l_shipdate) as at_us, l_orderkey * 10 + l_linenumber as tie from lineitem)"


@query(_segments_sql(_LINES, "l_partkey") + " select l_partkey, valid_from, valid_to, value, n_reports, fact_id from done")
def supersede_scale(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem").select("l_partkey", "l_returnflag", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("at_us"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    return resolve.resolve_in_order(rows, ["l_partkey"], "at_us", "l_returnflag", "tie").select("l_partkey", "valid_from", "valid_to", "value", "n_reports", "fact_id")


@query(_EVENT_SEGMENTS + ", o as (select a.valid_from from done a join done b on a.user_id = b.user_id and a.event_type = b.event_type and a.fact_id <> b.fact_id and b.valid_from <= a.valid_from and (b.valid_to is null or a.valid_from < b.valid_to) and (b.valid_from < a.valid_from)) select count(*) as n from o")
def overlap_audit(spark: SparkSession, d: str) -> DataFrame:
    return resolve.overlapping(resolve_supersede(spark, d), ["user_id", "event_type"]).agg(F.count("*").alias("n"))


def _edits(spark: SparkSession, d: str) -> DataFrame:
    """Every current preference is reworded."""
    rows = memory(spark, d).where("is_latest and mem_type = 'preference'")
    return rows.select("id", (-F.col("id")).alias("new_id"), F.concat(F.lit("Edited: "), F.coalesce("content", F.lit(""))).alias("content"), F.lit('{"edited":true}').alias("metadata"))


@query(
    f"""with {MEM}, edited as (select * from mem where is_latest and mem_type = 'preference')
select id, status, is_latest, 1 as version, null::bigint as supersedes_id, md5(coalesce(content, '')) as content, null::bigint as closed_us from mem where id not in (select id from edited)
union all select id, 'superseded', false, 1, null, md5(coalesce(content, '')), epoch_us({SQL_NOW}) from edited
union all select -id, 'active', true, 2, id, md5('Edited: ' || coalesce(content, '')), null from edited"""
)
def versioned_update(spark: SparkSession, d: str) -> DataFrame:
    out = lifecycle.versioned_update(lifecycle_rows(memory(spark, d)), _edits(spark, d), now())
    return out.select("id", "status", "is_latest", "version", "supersedes_id", F.md5(F.coalesce("content", F.lit(""))).alias("content"), F.unix_micros("recorded_to").alias("closed_us"))


@query(f"with {MEM}, e as (select id from mem where is_latest and mem_type = 'preference') select id, -id as other_id, 2 as version, false as is_parent from e union all select -id, id, 1, true from e")
def version_chain(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.version_chain(lifecycle.versioned_update(lifecycle_rows(memory(spark, d)), _edits(spark, d), now()))


_GONE = f"select status, count(*) as n, count(*) filter (closed) as closed from (select case when hit then 'forgotten' else status end as status, hit and recorded_at < {SQL_NOW} as closed from t) group by status"


def _by_status(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n"), F.count("recorded_to").alias("closed"))


@query(f"with {MEM}, t as (select *, status = 'active' and coalesce(source_id in (select request_id from add_requests where custom_id is not null), false) as hit from mem) {_GONE}")
def forget_by_source(spark: SparkSession, d: str) -> DataFrame:
    gone = read_table(spark, d, "add_requests").where("custom_id is not null").select(F.col("request_id").alias("source_id"))
    return _by_status(lifecycle.forget_by_source(lifecycle_rows(memory(spark, d)), gone, now()))


@query(f"with {MEM}, t as (select *, status = 'active' and mem_type = 'episode' as hit from mem) {_GONE}")
def forget_by_id(spark: SparkSession, d: str) -> DataFrame:
    rows = memory(spark, d)
    return _by_status(lifecycle.forget_by_id(lifecycle_rows(rows), rows.where("mem_type = 'episode'").select("actor_id", "id"), now()))


_N = r"regexp_replace(trim(regexp_replace(lower({}), '\s+', ' ', 'g')), '^[\s.:,;?!]+|[\s.:,;?!]+$', '', 'g')"


@query(
    f"""with {MEM}, want as (select distinct tenant_id, actor_id, {_N.format('subject')} as s, {_N.format('attribute')} as a, lower(trim(value)) as v from existing_matches),
t as (select m.*, coalesce(is_latest and status = 'active' and exists (select 1 from want w where w.tenant_id = m.tenant_id and w.actor_id = m.actor_id and w.s <> '' and w.a <> ''
  and w.s = {_N.format('m.subject')} and w.a = {_N.format('m.attribute')} and (coalesce(w.v, '') = '' or w.v = coalesce(lower(trim(m.value)), ''))), false) as hit from mem m) {_GONE}"""
)
def forget_by_content(spark: SparkSession, d: str) -> DataFrame:
    return _by_status(lifecycle.forget_by_content(lifecycle_rows(memory(spark, d)), read_table(spark, d, "existing_matches"), now()))


@query(
    f"select 'memory' as t, count(*) filter (tenant_id = '{TENANT}' and actor_id = '{ACTOR}') as purged, count(*) filter (not (tenant_id = '{TENANT}' and actor_id = '{ACTOR}')) as kept from candidates "
    f"union all select 'matches', count(*) filter (tenant_id = '{TENANT}' and actor_id = '{ACTOR}'), count(*) filter (not (tenant_id = '{TENANT}' and actor_id = '{ACTOR}')) from existing_matches"
)
def purge_counts(spark: SparkSession, d: str) -> DataFrame:
    tables = {"memory": memory(spark, d), "matches": read_table(spark, d, "existing_matches")}
    kept = lifecycle.without_actor(tables, TENANT, ACTOR)
    parts = []
    for name, df in tables.items():
        before, after = df.agg(F.count("*").alias("a")), kept[name].agg(F.count("*").alias("kept"))
        parts.append(before.join(F.broadcast(after)).select(F.lit(name).alias("t"), (F.col("a") - F.col("kept")).alias("purged"), "kept"))
    return parts[0].union(parts[1])


@query(f"select count(*) as n, md5(string_agg(cand_id::varchar, ',' order by recorded_at, cand_id)) as ids from candidates where tenant_id = '{TENANT}' and actor_id = '{ACTOR}'")
def export_actor(spark: SparkSession, d: str) -> DataFrame:
    out = actor_export(memory(spark, d), TENANT, ACTOR, "recorded_at")
    ids = F.from_json("rows", "array<struct<id: bigint>>")
    return out.select(F.size(ids).cast("bigint").alias("n"), F.md5(F.array_join(F.transform(ids, lambda x: x["id"].cast("string")), ",")).alias("ids"))


_TXT = "case when attribute is not null then attribute || coalesce(': ' || value, '') else content end"
_STATIC = "(forget_after is null and (is_static or round(confidence::double, 6) >= 0.8))"


@query(
    f"""with {MEM}, l as (select *, {_TXT} as txt, {_STATIC} as st from mem where {LIVE}),
s as (select tenant_id, actor_id, txt, row_number() over (partition by tenant_id, actor_id order by confidence desc, recorded_at desc, id desc) as rn from l where st),
y as (select tenant_id, actor_id, txt, row_number() over (partition by tenant_id, actor_id order by recorded_at desc, id desc) as rn from l),
sa as (select tenant_id, actor_id, string_agg(txt, '|' order by rn) as x from s where rn <= 50 group by all), ya as (select tenant_id, actor_id, string_agg(txt, '|' order by rn) as x from y where rn <= 20 group by all)
select coalesce(sa.tenant_id, ya.tenant_id) as tenant_id, coalesce(sa.actor_id, ya.actor_id) as actor_id, md5(coalesce(sa.x, '')) as static_facts, md5(coalesce(ya.x, '')) as dynamic_ctx
from sa full join ya on sa.tenant_id = ya.tenant_id and sa.actor_id = ya.actor_id"""
)
def profile_static_dynamic(spark: SparkSession, d: str) -> DataFrame:
    out = lifecycle.profiles(memory(spark, d), now())
    return out.select("tenant_id", "actor_id", *[F.md5(F.array_join(c, "|")).alias(c) for c in ("static_facts", "dynamic_ctx")])


_NEAR = f"""{MEM}, cur as (select * from mem where is_latest and status = 'active' and subject is not null and content is not null),
near as (select a.id, b.id as other_id, row_number() over (partition by a.id order by b.recorded_at desc nulls last, b.id desc)::int as rank from cur a join cur b on a.tenant_id = b.tenant_id and a.actor_id = b.actor_id and a.subject = b.subject and a.id <> b.id)"""


@query(f"with {_NEAR} select id, other_id, rank from near where rank <= 10")
def subject_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(memory(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    first = graph.neighbours(memory(spark, d), 1)
    rows = read_table(spark, d, "candidates").select("cand_id", "tenant_id")
    return first.join(rows, F.col("id") == F.col("cand_id")).select("tenant_id", F.col("id").alias("from_id"), F.col("other_id").alias("to_id"), F.lit("extends").alias("relation"))


@query(f"with {_NEAR}, e as (select id as from_id, other_id as to_id from near where rank = 1) select from_id as id, to_id as other_id, 'extends' as relation, true as outgoing, content from e join mem m on m.id = to_id where is_latest union all select to_id, from_id, 'extends', false, content from e join mem m on m.id = from_id where is_latest")
def relation_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.endpoints(_edges(spark, d), memory(spark, d))


@query(f"with {_NEAR} select count(*) as n from near where rank = 1")
def relation_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    self_edges = e.withColumn("to_id", F.col("from_id"))
    return graph.add_edges(e, e.union(self_edges)).agg(F.count("*").alias("n"))


@query()
def relation_classified(spark: SparkSession, d: str) -> DataFrame:
    rows = memory(spark, d)
    return graph.classify_relations(graph.neighbours(rows), rows, lambda content, others: [(0, "extends")] if others else [])


_SAID = f"""{MEM}, said as (select distinct tenant_id, actor_id, id, unnest(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda t: length(t) >= 4 and regexp_matches(t, '[a-z]'))) as surface from mem where is_latest and status = 'active' and content is not null)"""


@query(f"with {_SAID}, c as (select tenant_id, actor_id, surface, count(*) as mentions from said group by all) select tenant_id, actor_id, surface, mentions from (select *, row_number() over (partition by tenant_id, actor_id order by mentions desc, surface) as rn from c) where rn <= 50")
def actor_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.entities(graph.mentions(memory(spark, d).where("is_latest")))


@query(f"with {_SAID}, seed as (select min(id) as id from mem where is_latest and tenant_id = '{TENANT}'), c as (select b.id as other_id, count(*) as shared from said a join said b on a.tenant_id = b.tenant_id and a.actor_id = b.actor_id and a.surface = b.surface and a.id <> b.id where a.id = (select id from seed) group by all) select (select id from seed) as id, other_id, shared from c order by shared desc, other_id limit 10")
def related_memories(spark: SparkSession, d: str) -> DataFrame:
    rows = memory(spark, d).where("is_latest")
    seed = rows.where(F.col("tenant_id") == TENANT).agg(F.min("id").alias("id"))
    return graph.related(seed, graph.mentions(rows))


@query(
    f"with p as (select *, string_split(container_tag, ':') as p from ingest_requests where tenant_id = '{TENANT}') select ingest_id as document_id, title, epoch_us(received_at) as received_us from p "
    f"where case when len(p) > 1 and p[-2] = 'user' then 'user:' || p[-1] else p[-1] end = '{ACTOR}' order by received_at desc nulls last, ingest_id desc"
)
def actor_documents(spark: SparkSession, d: str) -> DataFrame:
    return graph.actor_documents(documents(spark, d), TENANT, ACTOR).select("document_id", "title", F.unix_micros("received_at").alias("received_us"))


@query()
def aggregate_context(spark: SparkSession, d: str) -> DataFrame:
    """Around the tenant's ten newest current rows, after every preference was edited."""
    rows = lifecycle.versioned_update(lifecycle_rows(memory(spark, d)), _edits(spark, d), now())
    hits = rows.where(scope.current() & (F.col("tenant_id") == TENANT)).orderBy(F.desc("recorded_at"), "id").limit(10)
    sources = read_table(spark, d, "add_requests").select(F.col("request_id").alias("source_id"))
    return graph.aggregate_context(hits, rows, _edges(spark, d), graph.mentions(rows.where(scope.current())), sources)


@query(
    "with once as (select ingest_id from (select *, row_number() over (partition by tenant_id, custom_id order by received_at, ingest_id) as rn from ingest_requests where custom_id is not null) where rn = 1) "
    "select ingest_id, custom_id is not null as named from ingest_requests where custom_id is null or ingest_id in (select ingest_id from once)"
)
def idempotent_ingest(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "ingest_requests")
    return ingest.new_sources(rows, None, "received_at", "ingest_id").select("ingest_id", F.col("custom_id").isNotNull().alias("named"))


@query("select request_id as id, epoch_us(received_at) as at_us from add_requests where lower(dreaming) = 'dynamic' order by received_at, request_id limit 16")
def pending_claim(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "add_requests").select(F.col("request_id").alias("id"), F.col("received_at").alias("ingested_at"), F.coalesce(F.lower("dreaming") == "dynamic", F.lit(False)).alias("needs_extraction"), F.lit(None).cast("timestamp").alias("claimed_at"))
    return ingest.pending(rows, now(), 300, 16).select("id", F.unix_micros("ingested_at").alias("at_us"))


@query("select coalesce(lower(dreaming) = 'dynamic', false) as queued, count(*) as n from add_requests group by all")
def request_routing(spark: SparkSession, d: str) -> DataFrame:
    run, later = ingest.routed(read_table(spark, d, "add_requests"))
    return run.select(F.lit(False).alias("queued")).union(later.select(F.lit(True))).groupBy("queued").agg(F.count("*").alias("n"))


@query(chunk_sql("(select * from ingest_requests where coalesce(task_type, 'superrag') = 'superrag')", "document_id, (select tenant_id from docs where docs.document_id = marked.document_id) as tenant_id"))
def document_ingest(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).where("coalesce(task_type, 'superrag') = 'superrag'")
    return ingest.document_chunks(docs.select("document_id", "tenant_id", "content"))


@query()
def extraction(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "add_requests").select(F.col("request_id").alias("id"), "content")
    return ingest.extracted(rows, lambda t: [{"content": t}])


_RESULTS = """res as (
  select 'echo' as backend, item_id as case_id, 0 as question_index, contains(lower(text), lower(answer)) as correct, abstention, question_type as category, length(text) // 4 as toks from eval_items
  union all select 'last', item_id, 0, contains(lower(text), lower(rtrim(string_split(question, ' ')[-1], '?'))), abstention, question_type, length(text) // 4 from eval_items)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Two backends answer with the whole passage; one judge looks for the answer, the other for the question's last word."""
    items = read_table(spark, d, "eval_items")
    low = F.lower("text")
    parts = []
    for name, want in (("echo", F.col("answer")), ("last", F.regexp_replace(F.element_at(F.split("question", " "), -1), r"\?+$", ""))):
        parts.append(items.select(F.lit(name).alias("backend"), F.col("item_id").alias("case_id"), F.lit(0).alias("question_index"), low.contains(F.lower(want)).alias("correct"), "abstention", F.col("question_type").alias("category"), text.token_estimate(F.col("text")).alias("recalled_context_tokens"), F.lit(0.0).alias("query_latency_ms")))
    return parts[0].union(parts[1])


@query(f"with {_RESULTS} select count(*) as n, round(coalesce(avg(correct::int), 0), 6) as accuracy, round(coalesce(avg(toks), 0), 6) as avg_tokens from res")
def eval_memscore(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.memory_score(_results(spark, d)).select("n", "accuracy", "avg_tokens")


@query(f"with {_RESULTS} select case when abstention then 'abstention' else coalesce(category, 'untyped') end as question_type, count(*) as n, round(avg(correct::int), 6) as accuracy from res group by 1")
def eval_by_type(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.score_by_type(_results(spark, d))


@query(f"with {_RESULTS} select case_id, question_index, sum(correct::int)::bigint as n_correct, count(*) as n from res group by all having min(correct::int) <> max(correct::int)")
def eval_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.disagreements(_results(spark, d))


@query(f"with {_RESULTS} select case_id, question_index, bool_or(correct) filter (backend = 'echo') as echo, bool_or(correct) filter (backend = 'last') as last from res group by all")
def eval_aligned(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.aligned(_results(spark, d), ["echo", "last"])
