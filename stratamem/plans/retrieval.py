"""Queries of the read side: scans, gates, filters, recall, chunk search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratamem.functions import metafilter, scope, text, vectors
from stratamem.functions.keys import normalize_key
from stratamem.functions.providers import HashEmbedder, embed
from stratamem.operators import recall as R
from stratamem.plans.corpus import ACTOR, LIVE, MEM, NOW, QUERY_TEXT, SQL_NOW, TENANT, VEC, chunks, documents, memory, now, query_vector, usable_vectors, with_vectors
from stratamem.session import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"select actor_id, count(*) as n from candidates where tenant_id = '{TENANT}' group by actor_id")
def tenant_scan(spark: SparkSession, d: str) -> DataFrame:
    return scope.tenant_table(spark, d, "candidates", TENANT).groupBy("actor_id").agg(F.count("*").alias("n"))


@query("select 0::bigint as n")
def tenant_scan_unset(spark: SparkSession, d: str) -> DataFrame:
    return scope.tenant_table(spark, d, "candidates", None).agg(F.count("*").alias("n"))


@query("select distinct tenant_id from candidates order by tenant_id")
def tenant_registry(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "candidates").select("tenant_id").distinct().orderBy("tenant_id")


@query(f"with {MEM} select tenant_id, count(*) as n from mem where {LIVE} group by tenant_id")
def live_gate(spark: SparkSession, d: str) -> DataFrame:
    return memory(spark, d).where(scope.live(now())).groupBy("tenant_id").agg(F.count("*").alias("n"))


@query(f"with {MEM}, f as (select * replace (case when forget_after <= {SQL_NOW} then 'forgotten' else status end as status) from mem) select status, count(*) as n from f where ({LIVE}) or status = 'forgotten' group by status")
def forgotten_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = memory(spark, d).withColumn("status", F.when(F.col("forget_after") <= now(), "forgotten").otherwise(F.col("status")))
    return rows.where(scope.live_or_forgotten(now())).groupBy("status").agg(F.count("*").alias("n"))


@query(f"with {MEM} select id from mem where list_has_all(container_tags, ['preference', 'range'])")
def container_all_of(spark: SparkSession, d: str) -> DataFrame:
    return memory(spark, d).where(scope.has_all_tags(["preference", "range"])).select("id")


@query(f"with {MEM} select id, epoch_us(valid_from) as from_us from mem where valid_from <= {SQL_NOW} and (valid_to is null or {SQL_NOW} < valid_to)")
def valid_at(spark: SparkSession, d: str) -> DataFrame:
    return memory(spark, d).where(scope.valid_at(now())).select("id", F.unix_micros("valid_from").alias("from_us"))


FILTERS = {
    "equality": {"key": "channel", "value": "chat"},
    "equality_ci": {"key": "channel", "value": "CHAT", "ignoreCase": "true"},
    "numeric": {"key": "level", "value": "5", "filterType": "numeric", "numericOperator": ">"},
    "string_contains": {"key": "channel", "value": "oi", "filterType": "string_contains"},
    "negate_missing": {"key": "level", "value": "7", "negate": True},
    "nested": {"AND": [{"OR": [{"key": "channel", "value": "chat"}, {"key": "channel", "value": "mail"}]}, {"key": "level", "value": "3", "filterType": "numeric", "numericOperator": "<=", "negate": "true"}]},
    "empty_or": {"OR": []},
}


def _filter_query(tree: dict):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return read_table(spark, d, "add_requests").where(metafilter.to_column(tree, F.col("metadata"))).select("request_id")

    return run


for _name, _tree in FILTERS.items():
    QUERIES[f"filter_{_name}"] = _filter_query(_tree)
    ORACLES[f"filter_{_name}"] = f"select request_id from add_requests where {metafilter.to_sql(_tree, 'metadata')}"

_TAGGED = {"key": "tags", "value": "episode", "filterType": "array_contains"}


@query(f"with {MEM} select id from mem where {metafilter.to_sql(_TAGGED, 'metadata')}")
def filter_array_contains(spark: SparkSession, d: str) -> DataFrame:
    return memory(spark, d).where(metafilter.to_column(_TAGGED, F.col("metadata"))).select("id")


@query(f"with {VEC}, s as (select vec_id, round(1 - list_cosine_similarity(usable.v, q.v), 9) as dist from usable, q) select vec_id as id, round(dist, 6) as dist, row_number() over (order by dist, vec_id)::int as rnk from s order by dist, vec_id limit 50")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    rows = usable_vectors(spark, d).withColumnRenamed("vec_id", "id")
    return R.vector_leg(rows, query_vector(spark, d), R.FAN_OUT).withColumn("dist", F.round("dist", 6))


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: case when x is null or isnan(x) or isinf(x) then 0 else x::double end)), 5) as total, len(embedding)::int as dim from embedding_data where embedding is not null and len(embedding) > 0")
def vector_coercion(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embedding_data").where("embedding is not null and size(embedding) > 0")
    clean = vectors.finite(F.col("embedding"))
    return rows.select("vec_id", F.round(F.aggregate(clean, F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.size("embedding").alias("dim"))


_TOKS = "list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '')"
_ASKED = text.query_tokens(QUERY_TEXT)
_IN = ", ".join(f"'{t}'" for t in _ASKED)


def _lexical_sql(rows: str, where: str = "true", limit: int = 50) -> str:
    return f"(select id, len(list_filter(toks, lambda t: t in ({_IN}))) as lr from (select id, {_TOKS} as toks from {rows} where {where}) where list_has_all(toks, [{_IN}]) order by lr desc, id limit {limit})"


@query(f"with {MEM} select id, lr::int as lr, row_number() over (order by lr desc, id)::int as rnk from {_lexical_sql('mem', LIVE)}")
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.lexical_leg(memory(spark, d).where(scope.live(now())), QUERY_TEXT, R.FAN_OUT)


_MV = f"{MEM}, {VEC}, emb as (select cand_id, arg_min(v, vec_id) as v from usable group by cand_id), memv as (select mem.*, emb.v from mem left join emb on emb.cand_id = mem.id)"


def _fused_sql(where: str) -> str:
    return f"""{_MV}, vleg as (
  select id, row_number() over (order by dist, id) as rnk from (
    select id, round(1 - list_cosine_similarity(memv.v, q.v), 9) as dist from memv, q where memv.v is not null and {where} order by dist, id limit 50)
), lleg as (select id, row_number() over (order by lr desc, id) as rnk from {_lexical_sql('memv', where)}
), fused as (select id, sum(1.0::double / (60 + rnk)) as rrf from (select * from vleg union all select * from lleg) group by id)"""


def _recall_sql(where: str, as_of: str = SQL_NOW, limit: int = 10, then: str = "") -> str:
    score = f"round(rrf * coalesce(exp(-greatest(0.0::double, (epoch_us({as_of}) - epoch_us(valid_from)) / 1e6::double) / 2592000.0::double), 1.0) * (0.5::double + 0.5::double * confidence::double), 9)"
    return f"with {_fused_sql(where)}, hits as (select memv.id, memv.content, {score} as score, memv.recorded_at from memv join fused using (id) order by score desc, recorded_at desc nulls last, id limit {limit}) select id, content, score from hits {then}"


_MINE = f"tenant_id = '{TENANT}' and {LIVE}"


def _recall(spark: SparkSession, d: str, **more) -> DataFrame:
    rows = with_vectors(spark, d, scope.tenant_scan(memory(spark, d), TENANT))
    return R.recall(rows, now(), query_vector(spark, d), QUERY_TEXT, **more).select("id", "content", "score")


@query(f"with {_fused_sql(_MINE)} select id, round(rrf, 9) as rrf from fused")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    rows = with_vectors(spark, d, scope.tenant_scan(memory(spark, d), TENANT)).where(scope.live(now()))
    return R.fuse(R.vector_leg(rows, query_vector(spark, d), 50), R.lexical_leg(rows, QUERY_TEXT, 50)).withColumn("rrf", F.round("rrf", 9))


@query(_recall_sql(_MINE))
def recall_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d)


@query(_recall_sql(_MINE, as_of="timestamptz '2023-06-01 00:00:00+00'"))
def recall_asof(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, as_of=F.lit("2023-06-01 00:00:00").cast("timestamp"))


_CONF = {"AND": [{"key": "conf", "value": "60", "filterType": "numeric", "numericOperator": ">="}, {"key": "kind", "value": "none", "negate": True}]}


@query(_recall_sql(f"{_MINE} and {metafilter.to_sql(_CONF, 'metadata')}"))
def recall_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, where=metafilter.to_column(_CONF, F.col("metadata")))


@query(_recall_sql(f"{_MINE} and list_has_all(container_tags, ['fact'])"))
def recall_tagged(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, tags=["fact"])


@query(_recall_sql(f"{_MINE} and actor_id = '{ACTOR}'", limit=20))
def recall_actor(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, actor=ACTOR, limit=20)


@query(_recall_sql(_MINE, as_of="timestamptz '2023-06-01 00:00:00+00'", limit=40, then="where (select max(score) from hits) <= 0 or score / (select max(score) from hits) >= 0.7 order by score desc, recorded_at desc nulls last, id limit 10"))
def recall_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, as_of=F.lit("2023-06-01 00:00:00").cast("timestamp"), threshold=0.7)


@query()
def rerank_reorder(spark: SparkSession, d: str) -> DataFrame:
    return R.rerank(_recall(spark, d), QUERY_TEXT, lambda q, docs: sorted(((i, -float(len(t))) for i, t in enumerate(docs)), key=lambda x: x[1]), 10)


@query(_recall_sql(_MINE))
def rewrite_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = with_vectors(spark, d, scope.tenant_scan(memory(spark, d), TENANT))
    return R.recall(rows, now(), query_vector(spark, d), "what keeps what", rewriter=lambda q: QUERY_TEXT).select("id", "content", "score")


@query()
def profile_query(spark: SparkSession, d: str) -> DataFrame:
    rows = with_vectors(spark, d, scope.tenant_scan(memory(spark, d), TENANT))
    own, found = R.profile_with_query(rows, TENANT, ACTOR, now(), QUERY_TEXT, query_vector(spark, d))
    lines = [own.select(F.lit(part).alias("part"), F.posexplode(part).alias("pos", "content")) for part in ("static_facts", "dynamic_ctx")]
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), (-F.unix_micros("recorded_at")).alias("r"), "id", "content")))
    hits = found.agg(order.alias("hits")).select(F.lit("relevant"), F.posexplode(F.transform("hits", lambda h: h["content"])))
    return lines[0].unionAll(lines[1]).unionAll(hits)


_CHUNK = "(select chunk_id as id, ingest_id as document_id, content from doc_chunks)"


def _chunk_sql(rows: str = _CHUNK, limit: int = 10) -> str:
    return f"(select c.id, c.document_id, c.content, round(1.0::double / (60 + rnk), 9) as score from {rows} c join (select id, row_number() over (order by lr desc, id) as rnk from {_lexical_sql(rows + ' r', limit=max(50, limit))}) using (id) order by score desc, id limit {limit})"


@query(f"select id, document_id, score from {_chunk_sql()}")
def chunk_search(spark: SparkSession, d: str) -> DataFrame:
    return R.search_chunks(chunks(spark, d), QUERY_TEXT, limit=10).select("id", "document_id", "score")


_TEAM = {"key": "team", "value": "infra"}
_TEAM_CHUNK = f"(select chunk_id as id, ingest_id as document_id, content from doc_chunks where ingest_id in (select ingest_id from ingest_requests where {metafilter.to_sql(_TEAM, 'metadata')}))"


@query(f"select id, document_id, score from {_chunk_sql(_TEAM_CHUNK)}")
def chunk_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).where(metafilter.to_column(_TEAM, F.col("metadata")))
    return R.search_chunks(chunks(spark, d), QUERY_TEXT, limit=10, documents=docs).select("id", "document_id", "score")


@query(f"with h as (select *, row_number() over (order by score desc, id) as pos from {_chunk_sql(limit=80)}) select document_id, max(score) as score, min(pos)::int as pos, md5(string_agg(content, '|' order by pos)) as chunks from h group by document_id order by pos limit 10")
def document_search_grouped(spark: SparkSession, d: str) -> DataFrame:
    hits = R.search_chunks(chunks(spark, d), QUERY_TEXT, limit=R.chunk_budget(10))
    return R.group_by_document(hits, 10).withColumn("chunks", F.md5(F.array_join("chunks", "|")))


@query(f"with m as ({_recall_sql(_MINE)}), c as (select * from {_chunk_sql()}) select 0 as src_ord, row_number() over (order by score desc, id)::int as pos, id::varchar as id, content, score from m union all select 1, row_number() over (order by score desc, id)::int, id::varchar, content, score from c")
def hybrid_mode_concat(spark: SparkSession, d: str) -> DataFrame:
    return R.concat_modes(_recall(spark, d), R.search_chunks(chunks(spark, d), QUERY_TEXT, limit=10))


def _embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).withColumn("embedding", embed(F.col("content"), HashEmbedder()))


def _embedded_query() -> Column:
    return F.array(*[F.lit(float(x)) for x in HashEmbedder()([QUERY_TEXT])[0]])


@query()
def chunk_search_fused(spark: SparkSession, d: str) -> DataFrame:
    return R.search_chunks(_embedded_chunks(spark, d), QUERY_TEXT, _embedded_query(), limit=10).select("id", "document_id", "score")


@query()
def chunk_search_filtered_fused(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).where(metafilter.to_column(_TEAM, F.col("metadata")))
    return R.search_chunks(_embedded_chunks(spark, d), QUERY_TEXT, _embedded_query(), limit=10, documents=docs).select("id", "document_id", "score")


@query()
def document_search_grouped_fused(spark: SparkSession, d: str) -> DataFrame:
    hits = R.search_chunks(_embedded_chunks(spark, d), QUERY_TEXT, _embedded_query(), limit=R.chunk_budget(10))
    return R.group_by_document(hits, 10).withColumn("chunks", F.md5(F.array_join("chunks", "|")))


@query()
def hybrid_mode_concat_fused(spark: SparkSession, d: str) -> DataFrame:
    return R.concat_modes(_recall(spark, d), R.search_chunks(_embedded_chunks(spark, d), QUERY_TEXT, _embedded_query(), limit=10))


_GAP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def chunk_sql(rows: str, columns: str) -> str:
    """Windows of 1,000 with an overlap of 100, one step after the other."""
    stop = f"case when b + 1000 >= n or length(regexp_extract(substr(t, b + 1, 1000), '(?s)^(.*){_GAP}', 1)) = 0 then b + 1000 else b + length(regexp_extract(substr(t, b + 1, 1000), '(?s)^(.*){_GAP}', 1)) end"
    return f"""with recursive docs as (select ingest_id as document_id, *, content as t, length(content) as n from {rows} where content is not null and length(content) > 0),
walk as (select document_id, b, {stop} as e from (select document_id, t, n, 0::bigint as b from docs)
  union all select document_id, b, {stop} from (select w.document_id, d.t, d.n, case when w.e - 100 > w.b then w.e - 100 else w.e end as b from walk w join docs d using (document_id) where w.e < d.n)),
pieces as (select document_id, b, regexp_replace(substr(t, b + 1, e - b), '^{_GAP}+|{_GAP}+$', '', 'g') as chunk from walk join docs using (document_id)),
marked as (select *, lag(chunk) over (partition by document_id order by b) as prev from pieces where chunk <> '')
select {columns}, (row_number() over (partition by document_id order by b) - 1)::int as ord, chunk from marked where prev is null or prev <> chunk"""


@query(chunk_sql("ingest_requests", "document_id"))
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return text.chunked(documents(spark, d).select("document_id", "content"))


@query(
    r"select cand_id, regexp_replace(trim(regexp_replace(lower(subject), '\s+', ' ', 'g')), '^[\s.:,;?!]+|[\s.:,;?!]+$', '', 'g') as subject_key, coalesce(s.canonical, a) as attribute_key "
    r"from (select *, regexp_replace(trim(regexp_replace(lower(attribute), '\s+', ' ', 'g')), '^[\s.:,;?!]+|[\s.:,;?!]+$', '', 'g') as a from candidates) c left join attribute_synonyms s on s.surface = c.a"
)
def canonical_key(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "candidates").select("cand_id", normalize_key(F.col("subject")).alias("subject_key"), normalize_key(F.col("attribute")).alias("a"))
    syn = read_table(spark, d, "attribute_synonyms")
    return rows.join(syn, rows["a"] == syn["surface"], "left").select("cand_id", "subject_key", F.coalesce("canonical", "a").alias("attribute_key"))


@query(
    "with p as (select request_id, container_tag, string_split(container_tag, ':') as p from add_requests) select request_id, case when len(p) > 1 and p[-2] = 'user' then 'user:' || p[-1] else p[-1] end as actor, "
    "case when len(p) = 1 then '' when p[-2] = 'user' then coalesce(array_to_string(list_transform(range(0, len(p) - 2, 2), lambda i: array_to_string(p[i + 1 : least(i + 2, len(p) - 2)], ':')), ','), '') else array_to_string(p[1 : len(p) - 1], ',') end as tags from p"
)
def container_tag_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "add_requests")
    tag = F.col("container_tag")
    return rows.select("request_id", scope.container_actor(tag).alias("actor"), F.array_join(scope.container_tags(tag), ",").alias("tags"))


@query("select case_id, session_no, md5(string_agg(role || ': ' || coalesce(content, ''), chr(10) order by turn_no, role || ': ' || coalesce(content, ''))) as conversation, count(*) as n_turns from turns group by all")
def conversation_text(spark: SparkSession, d: str) -> DataFrame:
    out = text.conversation_text(read_table(spark, d, "turns"), ["case_id", "session_no"], "turn_no")
    return out.withColumn("conversation", F.md5("conversation"))


@query(
    "select case_id, session_no, sum(length(content) // 4)::bigint as tokens, left(rtrim(string_split(list(content order by turn_no, turn_id)[1], chr(10))[1], chr(13)), 80) "
    "|| case when count(*) > 1 then ' (+' || (count(*) - 1) || ' more)' else '' end as preview from turns where content is not null group by all"
)
def text_previews(spark: SparkSession, d: str) -> DataFrame:
    """Each session's turns as recalled snippets, and their estimated tokens."""
    rows = read_table(spark, d, "turns").where("content is not null")
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "turn_id", "content"))), lambda x: x["content"])
    return rows.groupBy("case_id", "session_no").agg(F.sum(text.token_estimate(F.col("content"))).alias("tokens"), text.preview(said).alias("preview"))


@query(
    f"with {MEM} select tag from (select unnest(container_tags) as tag from mem where tenant_id = '{TENANT}' and is_latest and status = 'active' "
    f"union select r.container_tag from doc_chunks c join ingest_requests r on r.ingest_id = c.ingest_id where r.tenant_id = '{TENANT}') where tag <> '' order by tag"
)
def container_tags_list(spark: SparkSession, d: str) -> DataFrame:
    """Tags of the tenant's current memories and of its chunks."""
    kept = scope.tenant_scan(memory(spark, d), TENANT).where(scope.current()).select(F.explode("container_tags").alias("tag"))
    docs = scope.tenant_scan(documents(spark, d), TENANT).select("document_id", F.col("container_tag").alias("tag"))
    cut = docs.join(chunks(spark, d).select("document_id").distinct(), "document_id", "left_semi").select("tag")
    return kept.union(cut).where("tag <> ''").distinct().orderBy("tag")


_STEMS = (
    "list_transform(list_filter({toks}, lambda x: x not in ({stop})), lambda t: regexp_replace(regexp_replace(regexp_replace(t, '(..)ies$', '\\1y'), '(..(?:s|x|z|ch|sh))es$', '\\1'), '([a-z][^su])s$', '\\1'))"
).replace("{stop}", ", ".join(f"'{w}'" for w in text.STOP_WORDS))
_BM25_QUERY = "the keepers besides a cooler"


@query(
    f"""with {MEM}, docs as (select id, {_STEMS.replace('{toks}', _TOKS)} as toks from mem where {LIVE} and content is not null),
asked as (select unnest(list_distinct({_STEMS.replace('{toks}', "list_filter(regexp_split_to_array('" + _BM25_QUERY + "', '[^a-z0-9]+'), lambda x: x <> '')")})) as term),
tf as (select id, len(toks) as len, term, len(list_filter(toks, lambda t: t = term)) as tf from docs, asked), hit as (select * from tf where tf > 0),
df as (select term, count(*) as df from hit group by term), size as (select count(*) as n, avg(len(toks)) as mean from docs),
scored as (select id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / mean))), 6) as bm25 from hit join df using (term), size group by id)
select id, bm25, row_number() over (order by bm25 desc, id)::int as rnk from scored order by bm25 desc, id limit 50"""
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25_leg(memory(spark, d).where(scope.live(now())), _BM25_QUERY, R.FAN_OUT)


@query(f"with {MEM} select k as mode, count(*) as n from (select unnest(['memories', 'documents', 'hybrid', 'hybrid']) as k, unnest([1, 2, 1, 2]) as src) m join (select 1 as src from ({_recall_sql(_MINE)}) union all select 2 from {_chunk_sql()}) h on m.src = h.src group by k")
def search_modes(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for mode in ("memories", "documents", "hybrid"):
        hits = R.search(mode, lambda: _recall(spark, d), lambda: R.search_chunks(chunks(spark, d), QUERY_TEXT, limit=10))
        part = hits.select(F.lit(mode).alias("mode"))
        out = part if out is None else out.unionAll(part)
    return out.groupBy("mode").agg(F.count("*").alias("n"))
