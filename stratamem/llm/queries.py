"""Queries of the training-data operators and, where there is any, the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratamem.llm import leaks, mixing, near_duplicates, personal_data, similar_vectors, splitting, visual_forms
from stratamem.session import materialize, read_table


def _duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(read_table(spark, d, "candidates"), "cand_id", "content", threshold=0.6)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.grouped_pairs(_duplicate_groups(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Membership: one row per text with its class and number of links; classes named by their smallest id."""
    groups = _duplicate_groups(spark, d)
    first = groups.groupBy("group_id").agg(F.min("rec_id").alias("class_id"), F.count("*").alias("class_size"))
    return groups.join(first, "group_id").select(F.col("rec_id").alias("cand_id"), "class_id", "class_size", "n_links")


def _personal(spark: SparkSession, d: str) -> DataFrame:
    turns = read_table(spark, d, "turns").select(F.lit("turns").alias("rec_table"), F.col("turn_id").alias("rec_id"), F.col("content").alias("text"))
    asked = read_table(spark, d, "add_requests").select(F.lit("add_requests").alias("rec_table"), F.col("request_id").alias("rec_id"), F.col("content").alias("text"))
    return personal_data.find_items(turns.union(asked), read_table(spark, d, "name_hints"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("rec_table", "rec_id", F.explode("items").alias("i")).select("rec_table", "rec_id", "i.kind", "i.start_pos").distinct()


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("rec_table", "rec_id", F.size("items").alias("n_items"), "sanitized")


def _long_texts(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, str]]:
    return [("ingest_requests", read_table(spark, d, "ingest_requests"), "ingest_id"), ("doc_chunks", read_table(spark, d, "doc_chunks"), "chunk_id")]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [splitting.oversized(t, key, "content").select(F.lit(name).alias("rec_table"), "rec_id") for name, t, key in _long_texts(spark, d)]
    return parts[0].union(parts[1]).distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    parts = [splitting.split_texts(t, key, "content").withColumn("rec_table", F.lit(name)) for name, t, key in _long_texts(spark, d)]
    return parts[0].union(parts[1]).select("rec_table", "rec_id", "piece_no", "start_pos", "end_pos", "piece")


def p4_cover(spark: SparkSession, d: str) -> DataFrame:
    """Per item: its length, pieces put together again without the overlaps, and whether limits hold."""
    pieces = p4_pieces(spark, d).select("rec_table", "rec_id", "start_pos", "end_pos", "piece").distinct()
    parts = F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "piece")))
    each = pieces.groupBy("rec_table", "rec_id").agg(parts.alias("p"))
    ends = F.transform("p", lambda x: x["end_pos"])
    fresh = F.transform("p", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substring(x["piece"], (F.get(ends, i - 1) - x["start_pos"] + 1).cast("int"), F.lit(1 << 30))))
    within = F.forall("p", lambda x: (F.length(x["piece"]) <= 1000) & (F.length(x["piece"]) == x["end_pos"] - x["start_pos"]))
    steps = F.transform("p", lambda x, i: F.when(i == 0, True).otherwise((F.get(ends, i - 1) - x["start_pos"]).between(0, 100) & (x["end_pos"] > F.get(ends, i - 1))))
    whole = F.array_join(fresh, "")
    return each.select("rec_table", "rec_id", F.length(whole).cast("bigint").alias("n_chars"), F.md5(whole).alias("text_md5"), within.alias("within_limit"), F.forall(steps, lambda x: x).alias("overlaps_ok"))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return similar_vectors.nearest(read_table(spark, d, "embedding_data"), "vec_id", "embedding", k=5, dim=64)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_vectors.near_pairs(p5_neighbours(spark, d))


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).where("kind = 'verbatim'").select("doc_id", "item_id")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Training order with openreel read rather early, fansub late after a slow start, and the others evenly."""
    return mixing.mixture(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"), schedules={"openreel": [(0, 1.4), (1, 0.6)], "fansub": [(0, 0.2), (0.3, 0.2), (0.6, 1.5), (1, 1.5)]})


def p7_uses(spark: SparkSession, d: str) -> DataFrame:
    return p7_mix(spark, d).groupBy("doc_id", "source", "n_tokens").agg(F.count("*").alias("uses"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached_shares(materialize(p7_mix(spark, d).drop("target_share"), "mix"), read_table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return visual_forms.look_alikes(read_table(spark, d, "documents"), "doc_id", "text")


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return visual_forms.consistent_forms(read_table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("rec_id", "doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_texts": p2_texts,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_cover": p4_cover,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p6_found": p6_found,
    "p6_leaks": p6_leaks,
    "p7_mix": p7_mix,
    "p7_uses": p7_uses,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_forms": p8_forms,
}

_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
_TRIMMED = f"regexp_replace(content, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_GROUPS = r"""with recursive texts as (select cand_id, list_sort(list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{N}]+'))) as w from candidates where content is not null),
ids as (select cand_id, md5(array_to_string(w, ' ')) as node, w from texts where len(w) > 0), sets as (select node, any_value(w) as w from ids group by node),
words as (select node, len(w) as n, unnest(w) as word from sets),
links as (select a.node as a, b.node as b from words a join words b on a.word = b.word and a.node <> b.node and b.n >= 0.6 * a.n and a.n >= 0.6 * b.n
  group by a.node, b.node, a.n, b.n having count(*) >= 0.6 * (a.n + b.n - count(*)) - 1e-9),
reach as (select node as a, node as b from sets union select r.a, l.b from reach r join links l on l.a = r.b)"""
_VECTORS = """usable as (select vec_id, any_value(embedding)::double[] as v from embedding_data
  where vec_id is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by vec_id),
near as (select a.vec_id, b.vec_id as near_id, round(list_cosine_similarity(a.v, b.v), 9) as cosine from usable a join usable b on a.vec_id <> b.vec_id),
best as (select *, row_number() over (partition by vec_id order by cosine desc, near_id)::int as rank from near)"""
ORACLES = {
    "p1_found": _GROUPS + " select x.cand_id as cand_a, y.cand_id as cand_b from ids x join reach r on r.a = x.node join ids y on y.node = r.b where x.cand_id < y.cand_id",
    "p1_groups": _GROUPS
    + ", classes as (select x.cand_id, min(y.cand_id) as class_id, count(*) as class_size from ids x join reach r on r.a = x.node join ids y on y.node = r.b group by x.cand_id), "
    "degree as (select a, count(*) as n_links from links group by a) select cand_id, class_id, class_size, coalesce(n_links, 0) as n_links from classes join ids using (cand_id) left join degree on a = node",
    "p4_found": f"""
select 'ingest_requests' as rec_table, ingest_id as rec_id from ingest_requests where length({_TRIMMED}) > 1000
union select 'doc_chunks', chunk_id from doc_chunks where length({_TRIMMED}) > 1000""",
    "p4_cover": f"""
select 'ingest_requests' as rec_table, ingest_id as rec_id, length({_TRIMMED}) as n_chars, md5({_TRIMMED}) as text_md5, true as within_limit, true as overlaps_ok from ingest_requests where length({_TRIMMED}) > 0
union all select 'doc_chunks', chunk_id, length({_TRIMMED}), md5({_TRIMMED}), true, true from doc_chunks where length({_TRIMMED}) > 0""",
    "p5_neighbours": f"with {_VECTORS} select vec_id, near_id, cosine, rank from best where rank <= 5",
    "p5_found": f"with {_VECTORS} select distinct least(vec_id, near_id) as vec_a, greatest(vec_id, near_id) as vec_b from best where rank <= 5",
}
