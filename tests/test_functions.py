import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stratamem.functions import keys, metafilter, providers, scope, text, vectors


def _one(spark, column, **values):
    row = {k: v for k, v in values.items()}
    return spark.createDataFrame([row], ", ".join(f"{k} string" for k in row)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("  Lives\t in ", "lives in"), ("City?", "city"), (" .,: ", ""), ("a.b", "a.b"), ("!Home  Base;", "home base"), ("", "")])
def test_normalize_key(spark, raw, want):
    assert _one(spark, keys.normalize_key(F.col("c")), c=raw) == want


def test_blank_is_any_whitespace(spark):
    assert _one(spark, keys.not_blank(F.col("c")), c="  \t") is False


FILTER_ROWS = [
    ('{"team": "infra", "level": "7", "tags": ["a", "b"]}', 1),
    ('{"team": "Infra", "level": 3, "tags": [7]}', 2),
    ('{"level": " 5", "team": null}', 3),
    ("{}", 4),
    (None, 5),
    ('{"team": {"x": 1}}', 6),
    ("not json", 7),
]


@pytest.mark.parametrize(
    ("tree", "want"),
    [
        ({"key": "team", "value": "infra"}, {1}),
        ({"key": "team", "value": "INFRA", "ignoreCase": "true"}, {1, 2}),
        ({"key": "team", "value": "infra", "negate": True}, {2, 3, 4, 5, 6, 7}),
        ({"key": "level", "value": "3", "filterType": "numeric", "numericOperator": ">"}, {1}),
        ({"key": "level", "value": "3", "filterType": "numeric", "numericOperator": "="}, {2}),
        ({"key": "level", "value": "inf", "filterType": "numeric", "numericOperator": "<"}, set()),
        ({"key": "level", "value": "3", "filterType": "numeric"}, set()),
        ({"key": "tags", "value": "a", "filterType": "array_contains"}, {1}),
        ({"key": "tags", "value": "7", "filterType": "array_contains"}, set()),
        ({"key": "team", "value": "nfr", "filterType": "string_contains"}, {1, 2}),
        ({"OR": []}, {1, 2, 3, 4, 5, 6, 7}),
        ({"AND": []}, {1, 2, 3, 4, 5, 6, 7}),
        ({"AND": [{"key": "team", "value": "infra", "ignoreCase": True}, {"key": "level", "value": "3"}]}, {2}),
    ],
)
def test_filters(spark, tree, want):
    df = spark.createDataFrame(FILTER_ROWS, "metadata string, id int")
    assert {r["id"] for r in df.where(metafilter.to_column(tree, F.col("metadata"))).collect()} == want


def test_deep_filters_are_false(spark):
    tree = {"key": "a", "value": "b", "negate": True}
    for _ in range(16):
        tree = {"AND": [tree]}
    df = spark.createDataFrame(FILTER_ROWS, "metadata string, id int")
    assert df.where(metafilter.to_column(json.dumps(tree), F.col("metadata"))).count() == 0


@pytest.mark.parametrize(("tag", "want"), [("user:kim", ("user:kim", [])), ("team:blue:user:kim", ("user:kim", ["team:blue"])), ("solo", ("solo", [])), ("shelf:book", ("book", ["shelf"])), ("z:team:4:user:5", ("user:5", ["z:team", "4"]))])
def test_container_tags(spark, tag, want):
    assert scope.parse_container_tag(tag) == want
    row = spark.createDataFrame([(tag,)], "t string").select(scope.container_actor(F.col("t")).alias("a"), scope.container_tags(F.col("t")).alias("g")).first()
    assert (row["a"], row["g"]) == want


def test_tag_validation():
    assert scope.validate_tags(tags=["a:b"]) == "a:b"
    for bad in (dict(tag="a b"), dict(tags=["a", "b"]), dict(tag=""), dict(tag="x" * 101)):
        with pytest.raises(ValueError):
            scope.validate_tags(**bad)


def test_no_tenant_sees_nothing(spark):
    df = spark.createDataFrame([("t1", 1), ("t2", 2), (None, 3)], "tenant_id string, x int")
    assert scope.tenant_scan(df, None).count() == 0
    assert scope.tenant_scan(df, "").count() == 0
    assert [r["x"] for r in scope.tenant_scan(df, "t1").collect()] == [1]


def test_every_tenant_scan_is_pushed_down(spark, tmp_path):
    spark.createDataFrame([("t1", 1)], "tenant_id string, x int").write.parquet(f"{tmp_path}/t.parquet")
    plan = scope.tenant_table(spark, str(tmp_path), "t", "t1")._jdf.queryExecution().toString()
    assert "EqualTo(tenant_id,t1)" in plan


def test_windows():
    assert text.windows("", 20, 6) == [] and text.windows("  \n", 20, 6) == []
    assert text.windows("short", 20, 6) == ["short"]
    assert text.windows("one two three four", 9, 2) == ["one two", "wo three", "ee four"]
    # an unbroken run behind a short word is not walked through letter by letter
    assert [len(p) for p in text.windows("a" * 90 + " " + "b" * 1500)] == [90, 999, 601]
    assert text.windows("c" * 25, 10, 99) == ["c" * 10] and text.windows(" " * 30 + "d", 10, 2) == ["d"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=120), st.integers(1, 20), st.integers(0, 30))
def test_windows_go_forward_and_lose_no_word(t, size, overlap):
    parts = text.windows(t, size, overlap)
    assert all(0 < len(p) <= size for p in parts)
    assert all(a != b for a, b in zip(parts, parts[1:]))
    assert set("".join(parts)) - set(" \n") == set(t) - set(" \n")


def test_lexical(spark):
    df = spark.createDataFrame([("The red fox, red!",), ("red",), ("",), (None,)], "c string")
    toks = text.tokens(F.col("c"))
    q = text.query_tokens("Fox RED")
    got = df.select(text.lexical_match(toks, q).alias("m"), text.lexical_rank(toks, q).alias("r")).collect()
    assert [g["m"] for g in got] == [True, False, False, None] and got[0]["r"] == 3
    assert df.where(text.lexical_match(toks, text.query_tokens("?!"))).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])], "a array<float>, b array<float>")
    got = [r["d"] for r in df.select(F.round(vectors.cosine_distance(F.col("a"), F.col("b")), 9).alias("d")).collect()]
    assert got == [1.0, 0.0, None, None, None]
    bad = spark.createDataFrame([([float("nan"), 1.0, float("inf")],)], "a array<float>")
    assert bad.select(vectors.finite(F.col("a")).alias("v")).first()["v"] == [0.0, 1.0, 0.0]
    with pytest.raises(Exception, match="expected 2"):
        bad.select(vectors.check_dim(F.col("a"), 2)).collect()


def test_providers(spark):
    e = providers.HashEmbedder(4)
    assert e(["a"]) == e(["a"]) != e(["b"])
    df = spark.createDataFrame([("a",), (None,)], "t string").select(providers.embed(F.col("t"), e).alias("v"))
    got = [r["v"] for r in df.collect()]
    assert len(got[0]) == 4 and got[1] is None
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return 5

    assert providers.retried(call, lambda e: 503, sleep=lambda s: None) == 5
    with pytest.raises(OSError):
        providers.retried(lambda: (_ for _ in ()).throw(OSError()), lambda e: 400, sleep=lambda s: None)
    now = [0.0]
    bucket = providers.TokenBucket(2, clock=lambda: now[0])
    assert [bucket.admit("k") for _ in range(3)] == [True, True, False]
    now[0] = 30.0
    assert bucket.admit("k") and providers.TokenBucket(0).admit("k")


def test_preview_counts_other_snippets(spark):
    df = spark.createDataFrame([(["one\r\ntwo"],), (["x" * 90, "b", "c"],), ([],), (None,)], "s array<string>")
    assert [r["p"] for r in df.select(text.preview(F.col("s")).alias("p")).collect()] == ["one", "x" * 80 + " (+2 more)", "(none)", "(none)"]


def test_stems(spark):
    df = spark.createDataFrame([("The boxes of parties and glasses pass; cats' status",), (None,)], "t string")
    got = [r["s"] for r in df.select(text.stems(F.col("t")).alias("s")).collect()]
    assert got == [["box", "party", "glass", "pass", "cat", "status"], None]


def test_rfc3339(spark):
    df = spark.createDataFrame([("2024-02-03T04:05:06+02:00", 1), ("2024-02-03T02:05:06.5Z", 2), (None, 3), ("soon", 4), ("2024-02-31T00:00:00Z", 5)], "t string, k int")
    at = scope.rfc3339(F.col("t"), "date")
    assert [str(r["a"]) for r in df.where("k < 4").orderBy("k").select(at.alias("a")).collect()] == ["2024-02-03 02:05:06", "2024-02-03 02:05:06.500000", "None"]
    for k in (4, 5):
        with pytest.raises(Exception, match="date is not a valid"):
            df.where(f"k = {k}").select(at).collect()
