import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratamem.operators import components, evaluation, graph, history, ingest, lifecycle, recall, resolve, tenancy

T0 = datetime(2025, 1, 1)


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 160)] + [(5, 5), (None, 3)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            parent[find(a)] = find(b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert set(got) == nodes
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in nodes for b in nodes)
    assert all(got[x] <= x for x in nodes)


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def _log(spark, rows):
    return spark.createDataFrame([("t", "a", "s", k, at, rec, v) for k, at, rec, v in rows], "tenant_id string, actor_id string, subject_key string, attribute_key string, at_us long, recorded_us long, val string")


def _brute(rows):
    out = set()
    for k in {r[0] for r in rows}:
        best = {}
        for _, at, rec, v in (r for r in rows if r[0] == k):
            best[at] = max(best.get(at, (-(2**63), "")), (-(2**63) if rec is None else rec, v))
        runs = []
        for at in sorted(best):
            if not runs or runs[-1][1] != best[at][1]:
                runs.append((at, best[at][1]))
        out |= {(k, at, runs[i + 1][0] if i + 1 < len(runs) else -1, v) for i, (at, v) in enumerate(runs)}
    return out


@pytest.mark.parametrize("width", [1, 7, 10**9])
def test_versions_match_brute_force(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("kl"), rng.randrange(40), rng.choice([None, 1, 2, 3]), rng.choice("xyz")) for _ in range(150)]
    got = {(r["attribute_key"], r["from_us"], r["to_us"], r["val"]) for r in history.versions(_log(spark, rows + rows[:20]), slice_us=width).collect()}
    assert got == _brute(rows)


def test_combined_history(spark):
    rows = [("p", 1, 1, "a"), ("q", 3, 1, "b"), ("p", 5, 1, "c"), ("q", 5, 2, "b"), ("r", 6, 1, "z")]
    for width in (2, 100):
        out = history.combined_history(history.versions(_log(spark, rows), slice_us=width), ["p", "q"], slice_us=width)
        got = sorted((r["from_us"], r["to_us"], r["state"]) for r in out.collect())
        assert got == [(1, 3, '{"p":"a"}'), (3, 5, '{"p":"a","q":"b"}'), (5, -1, '{"p":"c","q":"b"}')]


def test_reports_edge_cases(spark):
    cols = "tenant_id string, actor_id string, subject string, attribute string, value string, single_valued boolean, recorded_at timestamp, eff timestamp, surface string, canonical string"
    rows = [
        ("t", None, " Sub ", "Lives in?", " New  York ", True, T0, None, "clash", "clash"),
        (None, "a", "x", "city", "Rome", True, None, T0, None, None),
        ("t", "a", "?!", "city", "Rome", True, T0, T0, None, None),
        ("t", "a", "x", "city", "  ", True, T0, T0, None, None),
        ("t", "a", None, "city", "Rome", True, T0, T0, None, None),
        ("t", "a", "x", "city", "Rome", False, T0, T0, None, None),
        ("t", "a", "x", "city", "Rome", None, T0, T0, None, None),
        ("t", "a", "x", "city", "Rome", True, None, None, None, None),
    ]
    syn = spark.createDataFrame([("lives in", "home"), ("lives in", "home"), (None, "x")], "surface string, canonical string")
    got = history.reports(spark.createDataFrame(rows, cols), F.col("eff"), syn)
    found = sorted((r["tenant_id"] or "", r["subject_key"], r["attribute_key"], r["val"]) for r in got.collect())
    assert found == [("", "x", "city", "rome"), ("t", "sub", "home", "new york")]
    vers = history.versions(got)
    assert {r["to_us"] for r in vers.collect()} == {-1} and vers.count() == 2
    assert history.versions(got.limit(0)).count() == 0


STEPS = [
    # fact, start, end, value, single-valued
    (1, 1, None, "oak", True),
    (2, 2, None, "elm", True),
    (3, 0, None, "fir", True),
    (4, 3, None, "elm", True),
]


def test_fold_script():
    rows = {r["fact_id"]: r for r in resolve.fold(STEPS)}
    assert set(rows) == {1, 2, 3}
    assert [i for i, r in rows.items() if r["is_latest"]] == [2]
    assert rows[2]["supersedes_id"] == 1 and rows[2]["confidence"] == 0.6
    assert rows[1]["valid_to"] == 2 and rows[1]["status"] == "superseded"
    assert rows[3]["valid_to"] == 1 and rows[3]["status"] == "active" and not rows[3]["is_latest"]
    assert sum(r["valid_from"] <= 1 and (r["valid_to"] is None or 1 < r["valid_to"]) for r in rows.values()) == 1


def test_fold_multi_valued_and_conflict():
    both = resolve.fold([(1, 1, None, "red", False), (2, 1, None, "blue", False)])
    assert all(r["is_latest"] for r in both)
    clash = resolve.fold([(1, 1, None, "a", True), (2, 1, None, "b", True)])
    assert [r["status"] for r in clash] == ["active", "conflict"]
    assert resolve.decide("x", True, []) == ("insert", []) and resolve.decide(None, True, [(1, "a")]) == ("supersede", [1])


def test_fold_keeps_ends():
    rows = {r["fact_id"]: r for r in resolve.fold([(1, 10, 20, "a", True), (2, 30, 25, "b", True), (3, 2, 4, "c", True), (4, 5, 99, "d", True)])}
    assert (rows[1]["valid_from"], rows[1]["valid_to"], rows[1]["status"]) == (10, 30, "superseded")
    assert rows[2]["valid_to"] is None and rows[2]["is_latest"]  # an end before the start is none
    assert rows[3]["valid_to"] == 4 and rows[4]["valid_to"] == 10
    assert resolve.fold([(5, 40, None, "e", True)], list(rows.values()))[1]["status"] == "superseded" and rows[2]["status"] == "active"


def _requests(spark, rows):
    cols = "id long, tenant_id string, actor_id string, custom_id string, content string, as_of_us long, received_at timestamp, extra string"
    return spark.createDataFrame([(i, "t", a, c, None if f is None else json.dumps(f), at, T0 + timedelta(seconds=i), "x") for i, a, c, f, at in rows], cols)


def _extractor():
    def heard(content):
        facts = json.loads(content)
        if facts == "poison":
            raise ValueError("cannot read")
        return [{"content": " ".join(map(str, f)), "subject": "me", "attribute": f[0], "value": f[1], "single_valued": f[2], **(f[3] if len(f) > 3 else {})} for f in facts]

    return heard  # workers cannot import this module, so the callable is one of its own


def test_ingest_add_script(spark):
    synonyms = spark.createDataFrame([("lives in", "home"), ("current city", "home")], "surface string, canonical string")
    rows = [
        (1, "u", None, [["lives in", "Oslo", True]], 100),
        (2, "u", None, [["Current  City.", "Rome", True]], 200),
        (3, "u", None, [["home", "Bonn", True]], 50),
        (4, "u", None, [["speaks", "Norse", False], ["speaks", "Latin", False]], 100),
        (5, "u", None, [["home", "Rome", True]], 300),
        (6, "u", "same", [["tool", "saw", True]], 100),
        (7, "u", "same", [["tool", "axe", True]], 200),
        (8, "u", None, [["role", "cook", True, {"from_us": 500, "to_us": 400}]], None),
        (9, "u", None, [["?", "odd", True]], None),
        (10, "v", None, "poison", None),
        (11, "v", None, None, None),
    ]
    none = ingest.no_memory(spark)
    out = ingest.add(none, None, _requests(spark, rows[:2]), _extractor(), F.lit(900), synonyms)
    memory = spark.createDataFrame(out["memory"].collect(), out["memory"].schema)
    known = spark.createDataFrame(out["sources"].collect(), out["sources"].schema)
    out = ingest.add(memory, known, _requests(spark, rows[2:]), _extractor(), F.lit(900), synonyms)
    got = {(r["attribute"], r["value"]): r for r in out["memory"].collect()}
    assert len(got) == 8 and out["memory"].columns == memory.columns
    assert [k for k, r in got.items() if k[0] == "home" and r["is_latest"]] == [("home", "Rome")]
    assert got["home", "Oslo"]["valid_to"] == 200 and got["home", "Bonn"]["valid_to"] == 100 and got["home", "Rome"]["confidence"] == 0.6
    assert got["speaks", "Norse"]["is_latest"] and got["speaks", "Latin"]["is_latest"] and ("tool", "axe") not in got
    assert got["role", "cook"]["valid_to"] is None and got[None, "odd"]["valid_from"] == 900
    assert [(r["id"], r["error"]) for r in out["failed"].collect()] == [(10, "cannot read")]
    assert {r["source_id"]: (r["inserted"], r["deduped"]) for r in out["actions"].collect()}[5] == (0, 1)
    assert out["sources"].count() == 10
    assert ingest.add(memory, known, _requests(spark, rows).limit(0), _extractor(), F.lit(0))["memory"].count() == memory.count()


def test_queue(spark):
    rows = _requests(spark, [(1, "u", "a", [["home", "Oslo", True]], 1), (2, "u", "a", [["home", "Rome", True]], 2), (3, "u", None, "poison", None), (4, "u", None, [["pet", "cat", True]], 3)])
    empty = rows.limit(0).selectExpr("*", "false as needs_extraction", "timestamp(null) as claimed_at", "timestamp(null) as ingested_at")
    queue, taken = ingest.enqueue(empty, rows, _now())
    assert {r["id"]: r["queued"] for r in taken.collect()} == {1: True, 2: False, 3: True, 4: True}
    cut = lambda df: spark.createDataFrame(df.collect(), df.schema)
    after, memory = ingest.work_off(cut(queue), ingest.no_memory(spark), _extractor(), _now(), cut, most=2)
    assert {r["id"]: r["needs_extraction"] for r in after.collect()} == {1: False, 3: True, 4: False}
    assert sorted(r["value"] for r in memory.collect()) == ["Oslo", "cat"]
    later = _now() + F.expr("interval 1 hour")
    assert [r["id"] for r in ingest.pending(after, later, 300, 10).collect()] == [3]


def test_keys(spark):
    none = spark.createDataFrame([], "digest string, tenant_id string, label string, created_at timestamp, revoked_at timestamp")
    keys = tenancy.with_keys(none, spark.createDataFrame([("k1", "t", None), ("k2", "t", "two")], "token string, tenant_id string, label string"), _now())
    asked = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, "no"), (4, None)], "q long, token string")
    assert {r["q"] for r in tenancy.authenticated(asked, keys).collect()} == {1, 2}
    gone = tenancy.revoked(keys, keys.where("label = 'two'").select("digest"), _now())
    assert [r["q"] for r in tenancy.authenticated(asked, gone).collect()] == [1]
    known = spark.createDataFrame([("t1", "acme")], "tenant_id string, external_id string")
    assert tenancy.with_tenants(known, spark.createDataFrame([("acme",), ("new",), ("new",), (None,)], "external_id string")).count() == 2


def test_forgetting_leaves_no_edge(spark):
    edges = spark.createDataFrame([("t", 1, 2, "extends"), ("t", 2, 3, "extends"), ("x", 1, 3, "extends")], "tenant_id string, from_id long, to_id long, relation string")
    mem = _mem(spark, dict(id=1, status="forgotten", is_latest=False), dict(id=2), dict(id=3))
    assert {(r["tenant_id"], r["from_id"]) for r in lifecycle.edges_left(edges, mem).collect()} == {("t", 2), ("x", 1)}


def test_recognised_entities(spark):
    mem = _mem(spark, dict(id=1, content="Ann met Bo"), dict(id=2, content="boom"))
    found = graph.recognised(mem, lambda t: 1 / 0 if t == "boom" else ["Ann", " Bo ", ""])
    assert {(r["id"], r["surface"]) for r in found.collect()} == {(1, "ann"), (1, "bo")}


def test_three_repeats_reach_the_bar():
    rows = resolve.fold([(i, i, None, "a", True) for i in range(4)])
    assert rows[0]["confidence"] >= resolve.BAR


def test_closed_form_equals_fold_in_order(spark):
    rng = random.Random(9)
    facts = [(i, rng.choice("kl"), i * 10, rng.choice("abc")) for i in range(120)]
    df = spark.createDataFrame(facts, "id long, key string, at long, val string").withColumn("single", F.lit(True))
    a = resolve.resolve_in_order(df, ["key"], "at", "val", "id").select("key", "fact_id", "value", "valid_from", "valid_to", "confidence", "is_latest", "supersedes_id")
    b = resolve.resolve_by_fold(df, ["key"], "id", "at", "val", "id", "single").select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert resolve.overlapping(a, ["key"]).count() == 0


def test_overlap_is_found(spark):
    df = spark.createDataFrame([("k", 1, 10), ("k", 5, 6), ("k", 10, None)], "key string, valid_from long, valid_to long")
    assert [r["valid_from"] for r in resolve.overlapping(df, ["key"]).collect()] == [5]


MEM = "id long, tenant_id string, actor_id string, content string, subject string, attribute string, value string, single_valued boolean, mem_type string, confidence float, is_static boolean, forget_after timestamp, recorded_at timestamp, source_id long, valid_from timestamp, valid_to timestamp, container_tags array<string>, metadata string, is_latest boolean, status string, version int, root_id long, supersedes_id long, recorded_to timestamp, embedding array<float>"


def _mem(spark, *rows):
    base = dict(tenant_id="t", actor_id="u", single_valued=False, mem_type="fact", confidence=0.5, is_static=False, recorded_at=T0, valid_from=T0, container_tags=[], metadata="{}", is_latest=True, status="active", version=1)
    names = [c.split(" ")[0] for c in MEM.split(", ")]
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], MEM)


def _now():
    return F.lit(T0 + timedelta(days=30)).cast("timestamp")


def test_recall_ranks_and_hides(spark):
    mem = _mem(
        spark,
        dict(id=1, content="likes green tea", embedding=[1.0, 0.0]),
        dict(id=2, content="likes black coffee", embedding=[0.0, 1.0]),
        dict(id=3, content="green note", forget_after=T0, embedding=[1.0, 0.0]),
        dict(id=4, content="green old", is_latest=False, status="superseded", embedding=[1.0, 0.0]),
        dict(id=5, content=None, embedding=[0.9, 0.1], container_tags=["a", "b"]),
        dict(id=6, content="green gone", is_latest=False, status="forgotten", forget_after=T0),
    )
    q = F.array(F.lit(1.0), F.lit(0.0))
    ids = [r["id"] for r in recall.recall(mem, _now(), q, "green").collect()]
    assert ids[0] == 1 and set(ids) == {1, 2, 5}
    assert [r["id"] for r in recall.recall(mem, _now(), query_text="green", include_forgotten=True).collect()] == [1, 6]
    assert [r["id"] for r in recall.recall(mem, _now(), q, "green", tags=["a", "b"]).collect()] == [5]
    assert [r["id"] for r in recall.recall(mem, _now(), query_text="?").collect()] == []
    assert recall.recall(mem.limit(0), _now(), q, "green").count() == 0
    with pytest.raises(ValueError):
        recall.recall(mem, _now())


def test_recency_and_future(spark):
    old, new, future = T0 - timedelta(days=730), T0 - timedelta(days=1), T0 + timedelta(days=365)
    mem = _mem(spark, dict(id=1, content="same", valid_from=old), dict(id=2, content="same", valid_from=new), dict(id=3, content="same", valid_from=future))
    now = F.lit(T0).cast("timestamp")
    score = {r["id"]: r["score"] for r in recall.recall(mem, now, query_text="same").collect()}
    assert score[1] < 1e-6 and score[3] <= 1.1 * score[2]
    then = {r["id"]: r["score"] for r in recall.recall(mem, now, query_text="same", as_of=F.lit(old + timedelta(days=5)).cast("timestamp")).collect()}
    assert then[1] > 100 * max(score[1], 1e-9)


def test_threshold_rerank_rewrite(spark):
    mem = _mem(spark, dict(id=1, content="a tea"), dict(id=2, content="b tea tea"), dict(id=3, content="c tea"))
    hits = recall.recall(mem, _now(), query_text="what", rewriter=lambda q: "tea")
    assert [r["id"] for r in hits.collect()] == [2, 1, 3]
    assert recall.relative_threshold(hits, 0.99).count() == 1
    back = recall.rerank(hits, "tea", lambda q, docs: [(2, 1.0), (2, 1.0), (9, 1.0)], 3)
    assert [r["id"] for r in back.collect()] == [3, 2, 1]

    def broken(q, docs):
        raise OSError

    assert [r["id"] for r in recall.rerank(hits, "tea", broken, 2).collect()] == [2, 1]


def test_update_and_chain(spark):
    mem = _mem(spark, dict(id=1, content="old", subject="s", attribute="a", value="v", container_tags=["x"]), dict(id=2, content="else"))
    edits = spark.createDataFrame([(1, 10, "new", None), (99, 11, "none", None)], "id long, new_id long, content string, metadata string")
    out = lifecycle.versioned_update(mem, edits, _now())
    rows = {r["id"]: r for r in out.collect()}
    assert set(rows) == {1, 2, 10}
    assert rows[1]["status"] == "superseded" and rows[1]["valid_to"] is None and rows[1]["recorded_to"]
    new = rows[10]
    assert (new["version"], new["root_id"], new["supersedes_id"], new["subject"], new["container_tags"], new["metadata"]) == (2, 1, 1, None, ["x"], "{}")
    again = lifecycle.versioned_update(out, spark.createDataFrame([(10, 20, "newer", "{}")], "id long, new_id long, content string, metadata string"), _now())
    chain = {(r["id"], r["other_id"], r["is_parent"]) for r in lifecycle.version_chain(again).collect()}
    assert {(20, 1, True), (20, 10, True), (1, 20, False)} <= chain and len(chain) == 6


def test_forgetting(spark):
    mem = _mem(spark, dict(id=1, source_id=7, subject="Me", attribute="Employer", value="Acme "), dict(id=2, source_id=8, actor_id="other"), dict(id=3))
    by_source = lifecycle.forget_by_source(mem, spark.createDataFrame([(7,), (7,), (None,)], "source_id long"), _now())
    assert {r["id"]: r["status"] for r in by_source.collect()} == {1: "forgotten", 2: "active", 3: "active"}
    assert by_source.exceptAll(lifecycle.forget_by_source(by_source, spark.createDataFrame([(7,)], "source_id long"), _now())).count() == 0
    by_id = lifecycle.forget_by_id(mem, spark.createDataFrame([("u", 2), ("u", 3)], "actor_id string, id long"), _now())
    assert {r["id"]: r["status"] for r in by_id.collect()} == {1: "active", 2: "active", 3: "forgotten"}

    def by_content(value):
        asked = spark.createDataFrame([("t", "u", "me.", "employer", value)], "tenant_id string, actor_id string, subject string, attribute string, value string")
        return {r["id"]: r["status"] for r in lifecycle.forget_by_content(mem, asked, _now()).collect()}[1]

    assert by_content("ACME") == "forgotten" and by_content("  ") == "forgotten" and by_content(None) == "forgotten" and by_content("Other") == "active"


def test_purge(spark):
    mem = _mem(spark, dict(id=1), dict(id=2, actor_id="other", supersedes_id=1), dict(id=3, actor_id=None))
    edges = spark.createDataFrame([("t", 1, 2, "extends"), ("t", 2, 3, "derives")], "tenant_id string, from_id long, to_id long, relation string")
    out = lifecycle.without_actor({"memory": mem, "edges": edges}, "t", "u", edges="edges")
    assert {r["id"]: r["supersedes_id"] for r in out["memory"].collect()} == {2: None, 3: None}
    assert [r["from_id"] for r in out["edges"].collect()] == [2]


def test_profiles(spark):
    mem = _mem(
        spark,
        dict(id=1, attribute="city", value="Rome", confidence=0.9),
        dict(id=2, content="note", confidence=0.5),
        dict(id=3, content="passing", confidence=0.95, forget_after=T0 + timedelta(days=90)),
        dict(id=4, content="expired", forget_after=T0),
        dict(id=5, content="set", is_static=True),
        dict(id=6, actor_id="quiet", content="gone", status="forgotten", is_latest=False),
    )
    got = lifecycle.profiles(mem, _now()).collect()
    assert [(r["actor_id"], r["static_facts"], r["dynamic_ctx"]) for r in got] == [("u", ["city: Rome", "set"], ["set", "passing", "note", "city: Rome"])]
    assert "- set" in evaluation.profile_markdown(got[0]["static_facts"], [])


def test_graph(spark):
    mem = _mem(spark, dict(id=1, content="zebra crossing", subject="s"), dict(id=2, content="zebra only", subject="s", recorded_at=T0 + timedelta(1)), dict(id=3, content="none"), dict(id=4, content="zebra", tenant_id="x"))
    said = graph.mentions(mem)
    got = graph.related(spark.createDataFrame([(1,)], "id long"), said).collect()
    assert [(r["other_id"], r["shared"]) for r in got] == [(2, 1)]
    assert graph.entities(said, 1).count() == 2
    near = graph.neighbours(mem)
    assert {(r["id"], r["other_id"]) for r in near.collect()} == {(1, 2), (2, 1)}
    edges = graph.classify_relations(near, mem, lambda c, others: [(0, "extends"), (5, "extends"), (0, "odd")])
    assert edges.count() == 2
    e = edges.select(F.lit("t").alias("tenant_id"), "from_id", "to_id", "relation")
    assert graph.add_edges(e, e.union(e)).count() == 2
    assert {(r["id"], r["other_id"], r["outgoing"]) for r in graph.endpoints(e.where("from_id = 1"), mem).collect()} == {(1, 2, True), (2, 1, False)}


def test_ingest(spark):
    rows = spark.createDataFrame([(1, "t", "c", T0), (2, "t", "c", T0), (3, "t", None, T0), (4, "t", None, T0), (5, "x", "c", T0)], "id long, tenant_id string, custom_id string, received_at timestamp")
    assert sorted(r["id"] for r in ingest.new_sources(rows, None, "received_at", "id").collect()) == [1, 3, 4, 5]
    known = spark.createDataFrame([("t", "c")], "tenant_id string, custom_id string")
    assert sorted(r["id"] for r in ingest.new_sources(rows, known, "received_at", "id").collect()) == [3, 4, 5]
    queue = spark.createDataFrame([(1, T0, True, None), (2, T0, True, T0), (3, T0, False, None), (4, T0 - timedelta(1), True, T0 - timedelta(9))], "id long, ingested_at timestamp, needs_extraction boolean, claimed_at timestamp")
    soon = F.lit(T0 + timedelta(seconds=10)).cast("timestamp")
    assert [r["id"] for r in ingest.pending(queue, soon, 300, 10).collect()] == [4, 1]
    done = ingest.completed(queue, spark.createDataFrame([(2, T0), (4, T0)], "id long, claimed_at timestamp"))
    assert {r["id"]: r["needs_extraction"] for r in done.collect()} == {1: True, 2: False, 3: False, 4: True}

    def extractor(t):
        if "poison" in t:
            raise ValueError("bad")
        return [{"content": t}, {"content": "  "}]

    src = spark.createDataFrame([(1, "good"), (2, "poison"), (3, None)], "id long, content string")
    assert {(r["id"], r["content"], r["error"]) for r in ingest.extracted(src, extractor).collect()} == {(1, "good", None), (2, None, "bad")}
    docs = ingest.document_chunks(spark.createDataFrame([(1, "a b"), (2, " ")], "document_id long, content string"))
    assert [(r["document_id"], r["ord"], r["chunk"]) for r in docs.collect()] == [(1, 0, "a b")]


def test_evaluation(spark):
    cols = "backend string, case_id string, question_index int, correct boolean, abstention boolean, category string, query_latency_ms double, recalled_context_tokens long"
    rows = [("a", "c1", 0, True, False, "x", 10.0, 4), ("b", "c1", 0, False, False, "x", 20.0, 2), ("a", "c2", 0, True, True, None, 0.0, 0), ("a", "c3", 0, False, False, None, 0.0, 0)]
    df = spark.createDataFrame(rows, cols)
    assert evaluation.memory_score(df.limit(0)).first().asDict() == {"n": 0, "accuracy": 0.0, "avg_latency_ms": 0.0, "avg_tokens": 0.0}
    assert {r["question_type"]: r["accuracy"] for r in evaluation.score_by_type(df).collect()} == {"x": 0.5, "abstention": 1.0, "untyped": 0.0}
    assert [r["case_id"] for r in evaluation.disagreements(df).collect()] == ["c1"]
    assert evaluation.aligned(df, ["a", "b"]).count() == 1
    assert {(r["case_id"], r["backend"]) for r in evaluation.missing(df, ["a", "b"]).collect()} == {("c2", "b"), ("c3", "b")}
    assert "| a | 3 |" in evaluation.comparison_markdown({"a": {"n": 3, "accuracy": 0.6, "avg_latency_ms": 1, "avg_tokens": 1}}, [("c1", 0)])
