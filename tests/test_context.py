from datetime import datetime

from pyspark.sql import functions as F

from stratamem.operators import graph, recall

T0 = datetime(2025, 1, 1)
COLS = "id long, tenant_id string, actor_id string, content string, version int, root_id long, source_id long, is_latest boolean, status string"


def test_aggregate_context_has_all_lanes(spark):
    rows = spark.createDataFrame(
        [
            (1, "t", "a", "walks beside rivers", 1, None, None, False, "superseded"),
            (2, "t", "a", "walks beside canals", 2, 1, 70, True, "active"),
            (3, "t", "a", "swims in canals", 1, None, 71, True, "active"),
            (4, "t", "a", "likes tea", 1, None, None, True, "active"),
            (5, "t", "b", "walks beside canals", 1, None, None, True, "active"),
            (6, "u", "a", "walks beside canals", 1, None, None, True, "active"),
        ],
        COLS,
    )
    edges = spark.createDataFrame([("t", 2, 4, "extends"), ("t", 3, 2, "derives"), ("t", 2, 5, "extends"), ("t", 3, 4, "extends")], "tenant_id string, from_id long, to_id long, relation string")
    sources = spark.createDataFrame([(70,), (71,)], "source_id long")
    got = graph.aggregate_context(rows.where("id = 2"), rows, edges, graph.mentions(rows.where("is_latest")), sources).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(2, "parent", "version", 1, 1), (2, "parent", "extends", 4, None), (2, "child", "derives", 3, None), (2, "related", "entity", 3, 1), (2, "source", "source", 70, None)], key=str
    )


def test_actor_documents_newest_first(spark):
    docs = spark.createDataFrame(
        [(1, "t", "x:user:0", "old", T0), (2, "t", "x:user:0", "new", datetime(2025, 2, 1)), (3, "t", "x:user:1", "other", T0), (4, "u", "x:user:0", "foreign", T0), (5, "t", "x:user:0", "undated", None)],
        "document_id long, tenant_id string, container_tag string, title string, received_at timestamp",
    )
    assert [r["document_id"] for r in graph.actor_documents(docs, "t", "user:0").collect()] == [2, 1, 5]


def test_profile_with_query_bounds_only_the_recall(spark):
    rows = spark.createDataFrame(
        [(k, "t", "a", f"likes tea {k}", None, None, None, "fact", 0.9, k % 2 == 0, None, T0, T0, ["x"], True, "active", None) for k in range(6)] + [(9, "t", "b", "likes tea", None, None, None, "fact", 0.9, True, None, T0, T0, ["x"], True, "active", None)],
        "id long, tenant_id string, actor_id string, content string, subject string, attribute string, value string, mem_type string, confidence float, is_static boolean, forget_after timestamp, "
        "recorded_at timestamp, valid_from timestamp, container_tags array<string>, is_latest boolean, status string, embedding array<float>",
    )
    now = F.lit(T0)
    own, none = recall.profile_with_query(rows, "t", "a", now, "  ")
    assert none is None and sum(len(r["static_facts"]) + len(r["dynamic_ctx"]) for r in own.collect()) == 12
    own, found = recall.profile_with_query(rows, "t", "a", now, "tea", limit=2)
    assert found.count() == 2 and sum(len(r["static_facts"]) + len(r["dynamic_ctx"]) for r in own.collect()) == 12
